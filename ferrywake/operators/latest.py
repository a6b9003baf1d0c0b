"""Latest-state tables and keyed event-time rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.series import floor_div
from ferrywake.operators.trips import lag_across


def latest_per_key(df: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """The row with the latest ``time`` of each key, the first in ``order`` of equal ones (S2, R4): one aggregate with map-side combine, so
    a key with a third of all rows is no problem. Rows without key or time don't count."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(F.col(time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    picked = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(time), -F.col(order))).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def fresh(df: DataFrame, time_ms: str, now_ms: Column, ttl_ms: int) -> DataFrame:
    return df.where(now_ms - F.col(time_ms) <= ttl_ms)  # P3


def carried_forward(df: DataFrame, key: str, time_us: str, order: list[str], columns: list[str], chunk_us: int = 7 * 86_400_000_000) -> DataFrame:
    """``columns`` filled with the last non-null value of the same key, in order of time (S3), over chunk bounds."""
    base = df.withColumn("_chunk", floor_div(F.col(time_us), chunk_us))
    w = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = base.groupBy(key, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "_chunk", *[F.last(c, ignorenulls=True).over(earlier).alias("_b_" + c) for c in columns])
    filled = base.select("*", *[F.last(c, ignorenulls=True).over(w).alias("_f_" + c) for c in columns]).join(before, [key, "_chunk"], "left")
    return filled.select(*[F.coalesce("_f_" + c, "_b_" + c).alias(c) if c in columns else F.col(c) for c in df.columns])


def changed(df: DataFrame, key: str, order: str, value: str, chunk: Column) -> DataFrame:
    """Rows whose ``value`` differs from the previous row's of the key (D3); A, B, A keeps all three (T10). ``chunk`` must not decrease with ``order``."""
    lagged = lag_across(df.withColumn("_chunk", chunk).withColumn("_has", F.lit(True)), [key], "_chunk", [order], [value, "_has"])
    return lagged.where(F.col("prev__has").isNull() | ~F.col(value).eqNullSafe(F.col("prev_" + value))).select(*df.columns)


def absent(states: DataFrame, poll: DataFrame, key: str) -> DataFrame:
    return states.join(poll.select(key).where(F.col(key).isNotNull()), key, "left_anti")  # D6


def tide_trend(readings: DataFrame, key: str, time_s: str, value: str, now_s: Column, window_s: int = 3000, least_m: float = 0.03) -> DataFrame:
    """'rising', 'falling' or 'steady' from the newest and the oldest value of the last 50 minutes (W3); fewer than two values are steady."""
    recent = readings.where(F.col(time_s).between(now_s - window_s, now_s) & F.col(value).isNotNull())
    both = recent.groupBy(key).agg(F.min_by(value, time_s).alias("oldest"), F.max_by(value, time_s).alias("newest"), F.count("*").alias("n"))
    delta = F.col("newest") - F.col("oldest")
    return both.select(key, F.when((F.col("n") >= 2) & (delta > least_m), "rising").when((F.col("n") >= 2) & (delta < -least_m), "falling").otherwise("steady").alias("trend"), "n")


def per_place(df: DataFrame, lat: str, lon: str, time: str, order: str, places: int = 4) -> DataFrame:
    """The latest row of each rounded coordinate."""
    key = F.concat_ws(",", *[F.format_string(f"%.{places}f", F.col(c)) for c in (lat, lon)])
    return latest_per_key(df.withColumn("_place", key), ["_place"], time, order).drop("_place")


def without_repeats(stops: Column, field: str) -> Column:
    """Array of structs without consecutive repeats of ``field``."""
    return F.filter(stops, lambda s, i: (i == 0) | ~s[field].eqNullSafe(F.get(stops, i - 1)[field]))


def interchanges(stops: DataFrame, station: str, line: str, name: str, order: str) -> DataFrame:
    """Lines per station as a sorted list, and whether there are two or more."""
    per = stops.groupBy(station).agg(F.array_sort(F.collect_set(line)).alias("_lines"), F.min_by(name, order).alias(name))
    return per.select(station, name, F.size("_lines").cast("long").alias("n_lines"), F.array_join("_lines", ",").alias("lines"), (F.size("_lines") >= 2).alias("interchange"))


def longest(df: DataFrame, keys: list[str], measure: str, order: str, smallest: bool = False) -> DataFrame:
    """The row with the largest (A17) or smallest (A18) ``measure`` of each key, first in ``order`` of equal ones."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((-F.col(measure) if smallest else F.col(measure)).alias("m"), (-F.col(order)).alias("o"))
    return df.where(F.col(measure).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def trailing_count(df: DataFrame, key: str, time_ms: str, window_ms: int) -> DataFrame:
    """Calls in the trailing window, this one included (R14). A key's calls are bounded by what its upstream takes."""
    w = Window.partitionBy(key).orderBy(time_ms).rangeBetween(-window_ms + 1, 0)
    return df.withColumn("calls", F.count("*").over(w))


def admitted(df: DataFrame, key: str, time_ms: str, order: str, limit: int, window_ms: int) -> DataFrame:
    """Sliding-window admission (R14): a call passes if fewer than ``limit`` admitted calls lie in the window before it; ``order`` (arrival) decides between equal times.

    The rule is recursive, so each key is scanned in order; only the last ``limit`` admitted times are held.
    """
    import pyarrow as pa

    from ferrywake.operators.series import scan_in_order

    def step(recent: list, row: dict) -> tuple[list, tuple]:
        recent = [ms for ms in recent if row[time_ms] - ms < window_ms]
        ok = len(recent) < limit
        return (recent + [row[time_ms]] if ok else recent), (ok,)

    rest = [c for c in df.columns if c not in (key, time_ms, order)]
    return scan_in_order(df.where(F.col(key).isNotNull() & F.col(time_ms).isNotNull()), [key], [time_ms, order], list, step, [("admitted", pa.bool_())], rest)
