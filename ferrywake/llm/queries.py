"""Queries of problems 2, 4, 8, 9 and 10 over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrywake.llm.linkage import link
from ferrywake.llm.mixing import mix
from ferrywake.llm.mojibake import garbled_documents
from ferrywake.llm.packing import fill_report, pack
from ferrywake.llm.repeats import position_runs
from ferrywake.llm.tokens import with_tokens
from ferrywake.session import materialize, table


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    fixes = table(spark, d, "bus_fixes").select("fix_id", "id", "lat", "lon", "recorded_at")
    return position_runs(fixes, "id", "lat", "lon", F.unix_micros("recorded_at"), "fix_id", min_count=least)


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 1)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 3).select("id", F.expr("start_us div 1000").alias("start_ms"), F.expr("end_us div 1000").alias("end_ms"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    stations = table(spark, d, "stations")
    district = table(spark, d, "district").select(F.col("properties.id").alias("id"), F.col("properties.name").alias("name"), F.try_element_at("coordinates", F.lit(2)).alias("lat"), F.try_element_at("coordinates", F.lit(1)).alias("lon"))
    return link(district, "id", "name", "lat", "lon", stations, "crs", "name", "lat", "lon")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("id", "crs")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(with_tokens(table(spark, d, "documents"), "doc_id", "text"))
    return pack(sizes, table(spark, d, "containers"), "doc_id", "tokens", "container", "capacity_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_pack(spark, d), table(spark, d, "containers"), "container", "capacity_tokens")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per container: documents packed, tokens lost or gained, bins filled over their capacity, documents split that fit; the last three must be 0."""
    sizes = materialize(with_tokens(table(spark, d, "documents"), "doc_id", "text"))
    kinds = table(spark, d, "containers")
    packed = materialize(pack(sizes, kinds, "doc_id", "tokens", "container", "capacity_tokens"))
    size = kinds.select("container", "capacity_tokens").distinct()
    over = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("t")).join(size, "container").groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_full"))
    item = packed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts")).join(size, "container").join(sizes.select("doc_id", "tokens"), "doc_id")
    kept = item.groupBy("container").agg(F.count("*").alias("documents"), F.sum(F.abs(F.col("t") - F.col("tokens"))).alias("lost"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_though_fitting"))
    return kept.join(over, "container")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per targeted source: documents used more often than allowed (must be 0) and the most a document may be used."""
    targets = table(spark, d, "mix_targets")
    used = _mix(spark, d)[0].join(targets.select("source", "max_repeats"), "source")
    broken = used.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("overused"))
    return targets.select("source", "max_repeats").join(broken, "source", "left").select("source", "max_repeats", F.coalesce("overused", F.lit(0)).cast("long").alias("overused"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(with_tokens(table(spark, d, "documents"), "doc_id", "text", ["source"]))
    return mix(sizes, table(spark, d, "mix_targets"), "doc_id", "source", "tokens", "source", "target_share", "max_repeats")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return garbled_documents(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_runs, p2_found, p4_links, p4_found, p8_pack, p8_report, p8_invariants, p9_invariants, p9_mix, p9_shares, p10_repaired, p10_found)}

_RUNS = """
with one as (select id, recorded_at, arg_min(lat, fix_id) as lat, arg_min(lon, fix_id) as lon from bus_fixes
  where id is not null and lat is not null and lon is not null and recorded_at is not null group by id, recorded_at),
gap as (select *, case when epoch_us(recorded_at) - epoch_us(lag(recorded_at) over w) <= 1800000000
    and 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - lag(lat) over w) / 2), 2)
      + cos(radians(lag(lat) over w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) over w) / 2), 2)))) <= 10 then 0 else 1 end as fresh
  from one window w as (partition by id order by recorded_at)),
run as (select *, sum(fresh) over (partition by id order by recorded_at rows unbounded preceding) as r from gap)
"""

SQL = {
    "p8_invariants": "select container, (select count(*) from documents where text <> '') as documents, 0 as lost, 0 as over_full, 0 as split_though_fitting from containers",
    "p9_invariants": "select source, max_repeats, 0 as overused from mix_targets",
    "p2_found": _RUNS + "select id, epoch_ms(min(recorded_at)) as start_ms, epoch_ms(max(recorded_at)) as end_ms from run group by id, r having count(*) >= 3",
    "p2_runs": _RUNS + "select id, epoch_us(min(recorded_at)) as start_us, epoch_us(max(recorded_at)) as end_us, count(*) as n, (epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1e6 as duration_s from run group by id, r",
}
