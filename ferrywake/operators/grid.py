"""Irregular readings onto a regular grid (problem 1): step-function validity intervals cut by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.series import floor_div, with_halo
from ferrywake.session import materialize

SPAN_CELLS = 10_000


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO 8601 time with a zone; null for anything else (blank, 'n/a', no zone)."""
    trimmed = F.trim(text)
    plain = trimmed.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")  # the usual form needs no rewriting
    iso = trimmed.rlike(r"^[+-]?\d{4,6}-?\d{2}-?\d{2}[Tt ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)$")
    basic = F.regexp_replace(trimmed, r"^(\d{4})(\d{2})(\d{2})[Tt ]", "$1-$2-$3T")
    clock = F.regexp_replace(F.regexp_replace(basic, r"[Tt ](\d{2})(\d{2})(\d{2})", "T$1:$2:$3"), r"[Tt ](\d{2}):?(\d{2})\s*([Zz]|[+-])", "T$1:$2:00$3")
    zone = F.regexp_replace(F.regexp_replace(F.regexp_replace(clock, r"\s*[zZ]$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:[.,]\d+)?)\s*([+-]\d{2})$", "$1$2:00")
    return F.when(plain, F.unix_micros(trimmed.try_cast("timestamp"))).when(iso, F.unix_micros(F.regexp_replace(zone, ",", ".").try_cast("timestamp")))


def regular_grid(readings: DataFrame, key: str, us: str, value: str, tie: str, step_s: int = 900, hold_s: int = 3600, chunk_s: int = 7 * 86_400) -> DataFrame:
    """One row per ``key`` and period of ``step_s`` seconds between the periods of its first and last reading.

    A reading is valid from its time to the next one, at most ``hold_s`` seconds. Columns: ``key``,
    ``slot_s`` (start of the period, epoch seconds), ``n_readings`` (readings whose time lies in the
    period), ``mean`` (time-weighted mean over what is covered, null if nothing is), ``coverage`` (covered
    fraction of the period) and ``state``: 'read', 'filled' (no reading, but an earlier one still holds)
    or 'missing'.

    Rows with a null key, time (``us``, epoch microseconds) or value don't count; readings with equal key and time
    count once, the one with the smallest ``tie`` giving the value. A key without usable readings has no rows.
    """
    step, hold = step_s * 1_000_000, hold_s * 1_000_000
    usable = readings.select(F.col(key).alias("_key"), F.col(us).alias("_us"), F.col(value).cast("double").alias("_v"), F.col(tie).alias("_tie"))
    usable = usable.where("_key is not null and _us is not null and _v is not null and not isnan(_v)")
    once = usable.groupBy("_key", "_us").agg(F.min_by("_v", "_tie").alias("_v"))
    pieces = with_halo(once, "_us", chunk_s * 1_000_000, 0, hold)
    until = F.least(F.col("_us") + F.lit(hold), F.coalesce(F.lead("_us").over(Window.partitionBy("_key", "chunk").orderBy("_us")), F.col("_us") + F.lit(hold)))
    interval = pieces.withColumn("_until", until).where("core").drop("core", "chunk")
    cell = interval.withColumn("_cell", F.explode(F.sequence(floor_div(F.col("_us"), step), floor_div(F.col("_until") - F.lit(1), step))))
    start = F.col("_cell") * F.lit(step)
    covered = F.least(F.col("_until"), start + F.lit(step)) - F.greatest(F.col("_us"), start)
    by_cell = materialize(
        cell.withColumn("_covered", covered.cast("double"))
        .groupBy("_key", "_cell")
        .agg(F.sum(F.when(F.col("_us") >= start, 1).otherwise(0)).cast("long").alias("n"), F.sum(F.col("_v") * F.col("_covered")).alias("vw"), F.sum("_covered").alias("w"))
    )
    # read again from what was written, so the readings are parsed once; a span is cut before it is spelled out, so that no row holds a whole span
    span = by_cell.where("n > 0").groupBy("_key").agg(F.min("_cell").alias("lo"), F.max("_cell").alias("hi"))
    pieces = span.withColumn("_piece", F.explode(F.sequence(floor_div(F.col("lo"), SPAN_CELLS), floor_div(F.col("hi"), SPAN_CELLS))))
    bounds = pieces.select("_key", F.greatest("lo", F.col("_piece") * SPAN_CELLS).alias("lo"), F.least("hi", F.col("_piece") * SPAN_CELLS + (SPAN_CELLS - 1)).alias("hi"))
    slots = bounds.select("_key", F.explode(F.sequence("lo", "hi")).alias("_cell"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return slots.join(by_cell, ["_key", "_cell"], "left").select(
        F.col("_key").alias(key),
        (F.col("_cell") * F.lit(step_s)).alias("slot_s"),
        n.alias("n_readings"),
        F.try_divide("vw", "w").alias("mean"),
        (F.coalesce("w", F.lit(0.0)) / F.lit(float(step))).alias("coverage"),
        F.when(n > 0, "read").when(F.col("w") > 0, "filled").otherwise("missing").alias("state"),
    )
