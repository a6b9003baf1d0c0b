"""Queries of the general problems (1, 3, 5, 6, 7) over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrywake.operators.delivery import keep_first_delivery, new_messages, repeated_deliveries
from ferrywake.operators.grid import iso_micros, regular_grid
from ferrywake.operators.proximity import within_distance
from ferrywake.operators.spikes import BUS_LAT, TIDE_LEVEL, VESSEL_SOG, implausible
from ferrywake.operators.trips import stops_and_trips
from ferrywake.session import table


def _grid(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "tide_readings").select("ref", "reading_at", "level_m", "reading_id").withColumn("us", iso_micros(F.col("reading_at")))
    return regular_grid(readings, "ref", "us", "level_m", "reading_id")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("mean", F.round("mean", 5) + F.lit(0.0)).withColumn("coverage", F.round("coverage", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("n_readings = 0").select("ref", "slot_s")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_deliveries(table(spark, d, "bus_wire"), ["i", "t"], "delivery_id")


def p3_once(spark: SparkSession, d: str) -> DataFrame:
    return keep_first_delivery(table(spark, d, "bus_wire"), ["i", "t"], "delivery_id")


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches before the middle of the poll numbers are stored, all others arrive: only messages not stored yet, each once."""
    wire = table(spark, d, "bus_wire")
    middle = wire.agg(F.expr("(min(batch_no) + max(batch_no)) div 2")).first()[0]
    stored = F.coalesce(F.col("batch_no") <= F.lit(middle), F.lit(False))
    return new_messages(wire.where(stored), wire.where(~stored), ["i", "t"], "delivery_id").select("delivery_id", "i", "t")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    bus = table(spark, d, "bus_fixes").select("fix_id", "id", "lat", "lon", F.unix_micros(F.coalesce("recorded_at", "polled_at")).alias("us"))
    vessel = table(spark, d, "vessels").select("report_id", "mmsi", "sog", (F.col("last_seen") * 1000).alias("us"))
    tide = table(spark, d, "tide_readings").select("reading_id", "ref", "level_m", F.coalesce(iso_micros(F.col("reading_at")), F.unix_micros("polled_at")).alias("us"))
    parts = (
        ("bus_fixes", "fix_id", implausible(bus, "fix_id", F.col("id"), F.col("us"), F.col("lat"), BUS_LAT, F.col("lon"))),
        ("vessels", "report_id", implausible(vessel, "report_id", F.col("mmsi"), F.col("us"), F.col("sog"), VESSEL_SOG)),
        ("tide_readings", "reading_id", implausible(tide, "reading_id", F.col("ref"), F.col("us"), F.col("level_m"), TIDE_LEVEL)),
    )
    out = None
    for name, row_id, found in parts:
        part = found.select(F.lit(name).alias("tbl"), F.col(row_id).alias("row_id"), "reason")
        out = part if out is None else out.unionByName(part)
    return out


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("tbl", "row_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    near = within_distance(table(spark, d, "vessels"), "report_id", "lat", "lon", table(spark, d, "bike_stations"), "i", "y", "x", 250.0)
    return near.withColumn("distance_m", F.round("distance_m", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_near(spark, d).select("report_id", "i")


def p7_trips(spark: SparkSession, d: str) -> DataFrame:
    fixes = table(spark, d, "bus_fixes").select("id", "recorded_at", "lat", "lon")
    return stops_and_trips(fixes, "id", F.unix_micros("recorded_at"), F.col("lat"), F.col("lon"), BUS_LAT)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_trips(spark, d).select("id", "kind", F.expr("start_us div 1000").alias("start_ms"), F.expr("end_us div 1000").alias("end_ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_grid, p1_found, p3_found, p3_once, p3_batches, p5_reasons, p5_found, p6_near, p6_found, p7_trips, p7_found)}

_USABLE = """
with usable as (
  select ref, reading_id, level_m, try_cast(reading_at as timestamptz) as tm from tide_readings
  where level_m is not null and regexp_matches(reading_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') and ref is not null),
slots as (select ref, cast(floor(epoch(tm) / 900) as bigint) as s from usable where tm is not null)
"""

_CELL = "least(fin, (c + 1) * 900000000) - greatest(us, c * 900000000)"

SQL = {
    "p1_grid": _USABLE + f""", once as (select ref, epoch_us(tm) as us, arg_min(level_m, reading_id) as v from usable where tm is not null group by 1, 2),
iv as (select *, least(us + 3600000000, coalesce(lead(us) over (partition by ref order by us), us + 3600000000)) as fin from once),
cell as (select *, unnest(range(cast(floor(us / 900000000.0) as bigint), cast(floor((fin - 1) / 900000000.0) as bigint) + 1)) as c from iv),
agg as (select ref, c, count(*) filter (where us >= c * 900000000) as n, sum(v * cast({_CELL} as double)) as vw, sum(cast({_CELL} as double)) as w from cell group by ref, c),
span as (select ref, cast(floor(min(us) / 900000000.0) as bigint) as lo, cast(floor(max(us) / 900000000.0) as bigint) as hi from once group by ref),
grid as (select ref, unnest(range(lo, hi + 1)) as c from span)
select ref, c * 900 as slot_s, coalesce(n, 0) as n_readings, round(vw / w, 5) + 0.0 as mean, round(coalesce(w, 0) / 900000000.0, 6) as coverage,
  case when coalesce(n, 0) > 0 then 'read' when w > 0 then 'filled' else 'missing' end as state from grid left join agg using (ref, c)""",
    "p1_found": _USABLE + """, span as (select ref, min(s) as lo, max(s) as hi from slots group by ref),
all_slots as (select ref, unnest(range(lo, hi + 1)) as s from span)
select ref, cast(s * 900 as bigint) as slot_s from all_slots anti join (select distinct ref, s from slots) using (ref, s)""",
    "p3_found": """select delivery_id from (select delivery_id, row_number() over (partition by i, t order by delivery_id) as n
from bus_wire where i is not null and t is not null) where n > 1""",
    "p3_once": """select delivery_id, batch_no, i, l, o, r, d, x, y, b, t from (select *, row_number() over (partition by i, t order by delivery_id) as n
from bus_wire) where n = 1 or i is null or t is null""",
    "p3_batches": """with m as (select (min(batch_no) + max(batch_no)) // 2 as middle from bus_wire), parted as (select *, coalesce(batch_no <= (select middle from m), false) as stored from bus_wire)
select delivery_id, i, t from (select *, row_number() over (partition by i, t order by delivery_id) as n from parted where not stored) as w
where (i is null or t is null) or (n = 1 and not exists (select 1 from parted as s where s.stored and s.i = w.i and s.t = w.t))""",
    "p6_found": """select distinct v.report_id, s.i from vessels as v join (select distinct i, x, y from bike_stations where i is not null and x between -180 and 180 and y between -90 and 90) as s
on v.lat between s.y - 0.0023 and s.y + 0.0023 and v.lon between -180 and 180
where 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.y - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(s.y)) * pow(sin(radians(s.x - v.lon) / 2), 2)))) <= 250""",
    "p6_near": """select v.report_id, s.i, round(min(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.y - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(s.y)) * pow(sin(radians(s.x - v.lon) / 2), 2))))), 3) as distance_m from vessels as v join (select distinct i, x, y from bike_stations where i is not null and x between -180 and 180 and y between -90 and 90) as s
on v.lat between s.y - 0.0023 and s.y + 0.0023 and v.lon between -180 and 180
where 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.y - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(s.y)) * pow(sin(radians(s.x - v.lon) / 2), 2)))) <= 250 group by 1, 2""",
}
