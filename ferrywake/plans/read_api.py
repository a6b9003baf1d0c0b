"""The read API (K8) as functions that return DataFrames: what a map asks the engine for. Parameters are validated first and refused with ValueError."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ferrywake.functions import text
from ferrywake.functions.geo import Box
from ferrywake.operators import latest, leaderboard, lookups

PERIODS = ("day", "week", "month")


def buses(fixes: DataFrame, now_ms: Column, box: Box | None = None, lines: str | None = None, ttl_ms: int = 300_000) -> DataFrame:
    """Live buses: the newest fix of each, not older than five minutes, in the viewport and of the lines asked for (R4, P3, P10, P11). ``fixes``: id, line, lat, lon, t_ms, ord."""
    live = latest.fresh(latest.latest_per_key(fixes, ["id"], "t_ms", "ord"), "t_ms", now_ms, ttl_ms)
    if box is not None:
        live = live.where(box.with_margin().holds(F.col("lon"), F.col("lat")))
    if lines is not None:
        live = live.where(text.line_label(F.col("line")).isin([x.strip().upper() for x in lines.split(",")]))
    return live


def arrivals(predictions: DataFrame, lines: str) -> DataFrame:
    """Predictions of the lines asked for, in feed order."""
    return predictions.where(F.col("line_id").isin(text.valid_lines(lines))).orderBy("ord")


def stop_arrivals(predictions: DataFrame, naptan: str, n: int = 8) -> DataFrame:
    """The next departures of one stop (L2)."""
    import re

    if not re.fullmatch(text.PARAMETERS["naptan"], naptan):
        raise ValueError(f"no stop id: {naptan!r}")
    return lookups.departures(predictions.where(F.col("naptan_id") == naptan), ["naptan_id"], "time_to_station", "ord", n)


def board(facts: DataFrame, period: str, bucket: str, mode: str, n: int = leaderboard.TOP) -> DataFrame:
    """The top of one board."""
    if period not in PERIODS or mode not in leaderboard.SPEED_CAPS:
        raise ValueError(f"no board: {period!r}, {mode!r}")
    return leaderboard.top(facts.where((F.col("period") == period) & (F.col("bucket") == bucket) & (F.col("mode") == mode)), n)


def rank(facts: DataFrame, bucket: str, vehicle: str) -> DataFrame:
    """One vehicle's place of the day and its label."""
    ranked = leaderboard.ranked(facts.where((F.col("period") == "day") & (F.col("bucket") == bucket)))
    return ranked.where(F.col("id") == vehicle).select("id", "rank", "total", "m", text.rank_line(F.col("rank"), F.col("total"), F.col("mode")).alias("label"))


def health(tables: dict[str, DataFrame], time_ms: str, now_ms: int) -> DataFrame:
    """Rows and age of the newest row of each live table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), (F.lit(now_ms) - F.max(time_ms)).alias("age_ms"))
        out = one if out is None else out.unionByName(one)
    return out
