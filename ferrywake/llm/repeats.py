"""Runs of near-identical consecutive events (problem 2), found by pointer doubling.

Each event that matches its predecessor points to it. A round replaces every pointer by the pointer's own
pointer with one self-join, so after ceil(log2(longest run)) rounds all point to the start of their run. Events whose
pointer has reached a start leave the probe side. Rounds are written to the shared folder, which bounds lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.series import haversine, with_halo
from ferrywake.session import discard, materialize


def run_starts(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, start`` for every node of ``links`` (``node``, ``ptr`` to its predecessor; a start has no row).

    The links form chains: a node has at most one predecessor and is the predecessor of at most one node, so no
    join key repeats on either side and no partition can be skewed.
    """
    spark = links.sparkSession
    linked = links.select(F.col("node").alias("ptr"), F.lit(True).alias("goes_on"))
    state = materialize(links.join(linked, "ptr", "left").select("node", "ptr", F.col("goes_on").isNull().alias("done")))
    for _ in range(max_rounds):
        if state.where("not done").isEmpty():
            break
        hop = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("done").alias("next_done"))
        moved = state.where("not done").join(hop, "ptr").select("node", F.col("next").alias("ptr"), F.col("next_done").alias("done"))
        new = materialize(state.where("done").unionByName(moved))
        discard(spark, state)
        state = new
    return state.select("node", F.col("ptr").alias("start"))


def position_runs(fixes: DataFrame, key: str, lat: str, lon: str, us: Column, tie: str, radius_m: float = 10.0, gap_s: int = 1800, min_count: int = 1, chunk_s: int = 86_400) -> DataFrame:
    """One row per longest run of neighbouring fixes at most ``radius_m`` and ``gap_s`` apart: ``key, start_us, end_us, n, duration_s``.

    Rows with a null key, position, time or ``tie`` (a unique bigint) are skipped; fixes with equal key and time count once, the
    smallest ``tie`` giving the position. Runs of fewer than ``min_count`` fixes are left out; with 1, a fix without
    neighbours is a run of its own. Both bounds are inclusive. Empty input gives no rows, other columns are ignored.
    """
    base = fixes.select(F.col(key).cast("string").alias("k"), us.alias("us"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"), F.col(tie).cast("long").alias("node"))
    base = base.where("k is not null and us is not null and la is not null and lo is not null and node is not null")
    once = base.groupBy("k", "us").agg(F.min_by("la", "node").alias("la"), F.min_by("lo", "node").alias("lo"), F.min("node").alias("node"))
    # the predecessor lies at most gap_s back, so a chunk with that halo holds it: no window over a whole source
    w = Window.partitionBy("k", "chunk").orderBy("us")
    seen = with_halo(once, "us", chunk_s * 1_000_000, gap_s * 1_000_000)
    apart = haversine(F.lag("la").over(w), F.lag("lo").over(w), F.col("la"), F.col("lo"))
    matches = (F.col("us") - F.lag("us").over(w) <= gap_s * 1_000_000) & (apart <= radius_m)
    events = materialize(seen.select("k", "us", "node", "core", F.when(matches, F.lag("node").over(w)).alias("ptr")).where("core").drop("core"))
    starts = run_starts(events.where("ptr is not null").select("node", "ptr"))
    placed = events.select("k", "us", "node").join(starts, "node", "left").withColumn("start", F.coalesce("start", "node"))
    runs = placed.groupBy("k", "start").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= min_count).select(F.col("k").alias(key), "start_us", "end_us", "n", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"))
