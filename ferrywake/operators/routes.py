"""Bus routes learned from traces.

Journeys are split with windows over (vehicle, chunk); projections, corridors and vertex means are aggregates over all fixes of a
key, spread over tasks. Only matching fixes to a seed polyline runs in numpy, on whatever part of a key a task holds, so a key with a third of all
fixes is no problem: its fixes are shuffled by (key, vehicle, journey), never by key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.functions import polyline
from ferrywake.functions.geo import M_PER_DEG_LAT, metres_per_lon
from ferrywake.operators.series import floor_div
from ferrywake.operators.trips import lag_across, running_across
from ferrywake.session import materialize

# What makes a journey, and the learner's distances.
SPLIT_S, MIN_FIXES, MIN_DURATION_S, MIN_LENGTH_M, MIN_JOURNEYS = 600, 15, 480, 2000.0, 5
SPACING_M, CORRIDOR_M, CORRIDOR_CAP_M, FAR_M = 25.0, 30.0, 60.0, 100.0
TRIM, SUPPORT, ANCHOR_M, ANCHOR_PULL, MOST_RESIDUAL_M = 0.2, 4, 40.0, 0.5, 35.0
CHUNK_S = 7 * 86_400


def journeys(traces: DataFrame, gap_s: int = SPLIT_S, chunk_s: int = CHUNK_S) -> DataFrame:
    """Traces with ``journey``, the time of its first fix, and ``step_m`` (W4, W5). ``traces``: k, i, x lon, y lat, t epoch seconds.

    A gap of more than ``gap_s`` starts a journey; of fixes with equal time the first (smallest x, y) counts. Rows with nulls don't count.
    """
    good = traces.where("k is not null and i is not null and x is not null and y is not null and t is not null")
    once = good.groupBy("k", "i", "t").agg(F.min(F.struct("x", "y")).alias("p")).select("k", "i", "t", "p.x", "p.y", floor_div(F.col("t").cast("long"), chunk_s).alias("chunk"))
    lagged = lag_across(once, ["k", "i"], "chunk", ["t"], ["t", "x", "y"])
    fresh = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > gap_s)
    step = F.hypot((F.col("x") - F.col("prev_x")) * metres_per_lon(), (F.col("y") - F.col("prev_y")) * M_PER_DEG_LAT)
    marked = lagged.withColumn("fresh", fresh).withColumn("step_m", F.when(fresh, 0.0).otherwise(step)).select("k", "i", "t", "x", "y", "chunk", "fresh", "step_m")
    return running_across(marked, ["k", "i"], "chunk", ["t"], {"journey": F.col("fresh").cast("long")}).drop("fresh")


def journey_summary(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("k", "i", "journey").agg(F.count("*").alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.sum("step_m").alias("length_m"))


def complete(summary: DataFrame, min_fixes: int = MIN_FIXES, min_s: int = MIN_DURATION_S, min_m: float = MIN_LENGTH_M) -> DataFrame:
    return summary.where((F.col("n") >= min_fixes) & (F.col("end_t") - F.col("start_t") >= min_s) & (F.col("length_m") >= min_m))


def floor_quantile(values: Column, q: float) -> Column:
    """sorted[min(n-1, floor(q*n))] of an array (A9); with q = 0.5 the upper median."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * q).cast("int")))


def trimmed_mean(df: DataFrame, keys: list[str], order: list[str], values: list[str], trim: float = TRIM, support: int = SUPPORT) -> DataFrame:
    """Mean of the ``ceil((1-trim)*n)``, at least ``support``, rows nearest in ``order`` (A10); groups below ``support`` have none."""
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = df.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    keep = F.greatest(F.lit(support), F.ceil(F.col("_n") * (1 - trim)))
    return placed.where((F.col("_n") >= support) & (F.col("_r") <= keep)).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("used"))


def smoothed(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """1-2-1 smoothing, ends unchanged."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*[c for c in df.columns if c not in values], *[F.coalesce(0.25 * F.lag(v).over(w) + 0.5 * F.col(v) + 0.25 * F.lead(v).over(w), F.col(v)).alias(v) for v in values])


def _seeds(fixes: DataFrame, kept: DataFrame, priors: DataFrame | None) -> DataFrame:
    """Resampled seed polyline in metres per key: the prior's, else the journey of median length."""
    w = Window.partitionBy("k").orderBy("length_m", "i", "journey")
    n = F.count("*").over(Window.partitionBy("k"))
    median = kept.withColumn("_r", F.row_number().over(w)).withColumn("_n", n).where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("k", "i", "journey")
    own = fixes.join(median, ["k", "i", "journey"]).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", F.col("x").alias("lon"), F.col("y").alias("lat")))).alias("pts"))
    own = own.select("k", F.transform("pts", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("pts"))
    if priors is not None:
        usable = priors.where(F.size("poly") >= 2).select(F.col("key").alias("k"), F.col("poly").alias("prior")).dropDuplicates(["k"])
        own = own.join(usable, "k", "left").select("k", F.coalesce("prior", "pts").alias("pts"))

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, pts in zip(f["k"], f["pts"]):
                s = polyline.resample(polyline.to_m([(p["lon"], p["lat"]) for p in pts]), SPACING_M)
                if len(s) >= 2:
                    out.append((k, s[:, 0].tolist(), s[:, 1].tolist()))
            yield pd.DataFrame(out, columns=["k", "sx", "sy"])

    return own.mapInPandas(seed, "k string, sx array<double>, sy array<double>")


def _matched(fixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Projection of each fix onto the polyline of its key (J11), at most 100 m away. Grouped by (key, vehicle, journey, week) with the line beside each group."""

    def match(key, f: pd.DataFrame, line: pd.DataFrame) -> pd.DataFrame:
        if not len(line) or not len(f):
            return pd.DataFrame({"k": [], "px": [], "py": [], "vertex": [], "dist": []})
        xy = np.column_stack([line["sx"].iloc[0], line["sy"].iloc[0]])
        pts = polyline.to_m(f[["x", "y"]].to_numpy())
        seg, u, d = polyline.project(xy, pts)
        ok = d <= FAR_M
        return pd.DataFrame({"k": f["k"][ok].to_numpy(), "px": pts[ok, 0], "py": pts[ok, 1], "vertex": seg[ok] + (u[ok] >= 0.5), "dist": d[ok]})  # T20

    group = ["k", "i", "journey", "chunk"]
    left = fixes.select(*group).distinct()
    pieces = left.toDF(*[f"_{c}" for c in group]).join(lines, F.col("_k") == F.col("k")).select(*[F.col(f"_{c}").alias(c) for c in group], "sx", "sy")
    schema = "k string, px double, py double, vertex int, dist double"
    return fixes.groupBy(*group).cogroup(pieces.groupBy(*group)).applyInPandas(match, schema)


def learn_routes(traces: DataFrame, priors: DataFrame | None = None, min_journeys: int = MIN_JOURNEYS, min_fixes: int = MIN_FIXES, min_s: int = MIN_DURATION_S, min_m: float = MIN_LENGTH_M, most_residual_m: float = MOST_RESIDUAL_M) -> DataFrame:
    """Learned polyline per key (G5): ``key, outcome, poly, journeys, mean_residual_m``; outcome 'learned', 'insufficient' or 'bad-geometry'.

    Keys that end in ':unknown' never learn (T16). Quantiles use the floor index over all residuals, from exact counts per residual decimetre.
    """
    fixes = materialize(journeys(traces.where(~F.col("k").endswith(":unknown"))))
    kept = materialize(complete(journey_summary(fixes), min_fixes, min_s, min_m))
    counts = fixes.select("k").distinct().join(kept.groupBy("k").agg(F.count("*").alias("journeys")), "k", "left").withColumn("journeys", F.coalesce("journeys", F.lit(0).cast("long")))
    enough = kept.join(counts.where(F.col("journeys") >= min_journeys).select("k"), "k")
    mine = fixes.join(enough.select("k", "i", "journey"), ["k", "i", "journey"])
    seeds = materialize(_seeds(mine, enough, priors))
    matched = materialize(_matched(mine.select("k", "i", "journey", "chunk", "x", "y"), seeds))
    # corridor: the 90 % residual between 30 and 60 m; decimetre counts bound the group to 1,000 rows per key
    w = Window.partitionBy("k").orderBy("dm")
    hist = matched.groupBy("k", F.floor(F.col("dist") * 10).alias("dm")).agg(F.count("*").alias("c"), F.max("dist").alias("d"))
    cum = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("k")))
    corridor = cum.where(F.col("upto") > F.floor(F.col("n") * 0.9)).groupBy("k").agg(F.least(F.lit(CORRIDOR_CAP_M), F.greatest(F.lit(CORRIDOR_M), F.min("d"))).alias("corridor"))
    near = matched.join(corridor, "k").where(F.col("dist") <= F.col("corridor"))
    mean = trimmed_mean(near, ["k", "vertex"], ["dist", "px", "py"], ["px", "py"])
    vertices = seeds.select("k", F.posexplode(F.arrays_zip("sx", "sy")).alias("vertex", "s")).select("k", "vertex", "s.sx", "s.sy")
    learned = vertices.join(mean, ["k", "vertex"], "left").select("k", "vertex", F.coalesce("px", "sx").alias("x"), F.coalesce("py", "sy").alias("y"))
    if priors is not None:
        learned = _anchored(learned, priors)
    smooth = smoothed(learned, ["k"], "vertex", ["x", "y"])
    lines = smooth.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y"))).alias("v")).select("k", F.col("v.x").alias("sx"), F.col("v.y").alias("sy"))
    lines = materialize(lines)
    residual = _matched(mine.select("k", "i", "journey", "chunk", "x", "y"), lines).groupBy("k").agg(F.avg("dist").alias("mean_residual_m"))
    poly = F.transform(F.arrays_zip("sx", "sy"), lambda p: F.struct(F.round(p["sx"] / metres_per_lon(), 6).alias("lon"), F.round(p["sy"] / M_PER_DEG_LAT, 6).alias("lat")))
    done = counts.join(lines, "k", "left").join(residual, "k", "left")
    outcome = F.when(F.col("journeys") < min_journeys, "insufficient").when(F.col("mean_residual_m") <= most_residual_m, "learned").otherwise("bad-geometry")
    return done.select(F.col("k").alias("key"), outcome.alias("outcome"), F.when(outcome == "learned", poly).alias("poly"), "journeys", F.round("mean_residual_m", 1).alias("mean_residual_m"))


def _anchored(learned: DataFrame, priors: DataFrame) -> DataFrame:
    """Pull the vertex nearest to each stop, within 40 m, half-way towards it. ``priors`` has ``stops``, an array of (lon, lat)."""
    stops = priors.select(F.col("key").alias("k"), F.posexplode("stops").alias("n", "s")).select("k", "n", (F.col("s.lon") * metres_per_lon()).alias("ax"), (F.col("s.lat") * M_PER_DEG_LAT).alias("ay"))
    d = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    nearest = learned.join(stops, "k").groupBy("k", "n", "ax", "ay").agg(F.min(F.struct(d.alias("d"), "vertex")).alias("b")).where(F.col("b.d") <= ANCHOR_M)
    # stops that share a vertex pull one after the other: each halves what is left
    pulls = nearest.groupBy("k", F.col("b.vertex").alias("vertex")).agg(F.array_sort(F.collect_list(F.struct("n", "ax", "ay"))).alias("p"))
    pull = lambda c, a: F.aggregate(F.coalesce("p", F.array().cast("array<struct<n:int,ax:double,ay:double>>")), F.col(c), lambda v, s: v + (s[a] - v) * ANCHOR_PULL)
    return learned.join(pulls, ["k", "vertex"], "left").select("k", "vertex", pull("x", "ax").alias("x"), pull("y", "ay").alias("y"))


def learner_report(routes: DataFrame) -> DataFrame:
    """Counts of outcomes and the mean residual of what was learned."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return routes.agg(is_("learned").alias("learned"), is_("insufficient").alias("insufficient"), is_("bad-geometry").alias("bad_geometry"), F.avg(F.when(F.col("outcome") == "learned", F.col("mean_residual_m"))).alias("mean_residual_m"))
