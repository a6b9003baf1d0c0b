"""Train positions from arrival countdowns.

The stages are joins and aggregates over one poll: owners of shared stock, blocks with an identified train, leading edges, collapse to one
prediction per train, candidate branches, handoff at the platform. Only the placement on a polyline is a (vectorised) Python function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ferrywake.functions import polyline
from ferrywake.functions.geo import planar_m
from ferrywake.functions.text import live_identity, live_location, location_arm, segment_key
from ferrywake.session import materialize

# Horizons and bounds in seconds, and lines that share rolling stock.
HORIZON_S, AT_PLATFORM_S, DEPARTED_MARGIN_S, DWELL_S = 480, 15, 20, 30
LEAST_RUN_S, MOST_RUN_S, CRUISE_MS, NEAR_FRACTION = 45.0, 300.0, 12.0, 0.85
STOCK_GROUPS = {"district": "sub", "circle": "sub", "hammersmith-city": "sub", "metropolitan": "sub", "mildmay": "og", "windrush": "og", "weaver": "og", "lioness": "og", "suffragette": "og", "liberty": "og"}


def group_owner(preds: DataFrame, group: str, vehicle: str, line: str, tts: str, order: str) -> DataFrame:
    """The line on which a shared vehicle is due first, first in feed order of equal ones (A5)."""
    return preds.groupBy(group, vehicle).agg(F.min_by(line, F.struct(tts, order)).alias("owner"))


def leading_edges(preds: DataFrame, previous: DataFrame, same: list[str], stop: str, tts: str) -> DataFrame:
    """Rows (``same`` + stop, least ``tts``) that no previous stop of the same train precedes with a smaller time (J5). ``previous``: direction, stop, prev_stop."""
    least = preds.groupBy(*same, stop).agg(F.min(tts).alias("t"))
    echo = least.join(previous, [same[0], stop]).withColumnRenamed(stop, "_stop").withColumnRenamed("t", "_t").withColumnRenamed("prev_stop", stop)
    ahead = echo.join(least, [*same, stop]).where(F.col("t") < F.col("_t")).select(*same, F.col("_stop").alias(stop)).distinct()
    return least.join(ahead, [*same, stop], "left_anti")


def run_time(scheduled, length_m):
    """Seconds a segment takes."""
    return F.when(scheduled >= 20, F.least(F.lit(MOST_RUN_S), scheduled + float(DWELL_S))).otherwise(F.greatest(F.lit(LEAST_RUN_S), F.least(F.lit(MOST_RUN_S), length_m / CRUISE_MS)))


def line_length(segment):
    """Metres of an array of (lon, lat) structs."""
    steps = F.zip_with(F.slice(segment, F.lit(1), F.greatest(F.size(segment) - 1, F.lit(0))), F.slice(segment, F.lit(2), F.greatest(F.size(segment) - 1, F.lit(0))), lambda a, b: planar_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def collapse(preds: DataFrame, branches: DataFrame) -> DataFrame:
    """Predictions that belong to a train, with its ``key`` and whether that is ``synthetic``."""
    groups = F.create_map(*[F.lit(x) for kv in STOCK_GROUPS.items() for x in kv])
    p = preds.withColumn("has_id", live_identity(F.col("vehicle_id"))).withColumn("has_loc", live_location(F.col("current_location")))
    p = p.withColumn("stock", F.try_element_at(groups, F.col("line_id"))).withColumn("dir", F.coalesce("direction", F.lit("")))
    owners = group_owner(p.where("has_id and stock is not null"), "stock", "vehicle_id", "line_id", "time_to_station", "ord")
    p = p.join(owners, ["stock", "vehicle_id"], "left")
    owned = p.where("has_id and has_loc").select("line_id", "current_location").distinct().withColumn("owned", F.lit(True))
    ways = p.where("not has_id and has_loc and dir <> ''").groupBy("line_id", "current_location").agg(F.count_distinct("dir").alias("ways"))
    p = p.join(owned, ["line_id", "current_location"], "left").join(ways, ["line_id", "current_location"], "left")
    # stop order of the branches of lines without ids and locations
    stops = branches.select("line_id", F.col("direction").alias("dir"), F.posexplode("stops").alias("i", "s"), "stops").where("i > 0")
    previous = stops.where("line_id = 'dlr'").select("dir", F.col("s.id").alias("naptan_id"), F.get("stops", F.col("i") - 1)["id"].alias("prev_stop")).distinct()
    dlr = p.where("line_id = 'dlr' and not has_id and not has_loc").withColumn("dest", F.coalesce("destination_name", F.lit("")))
    leads = leading_edges(dlr.where(F.col("time_to_station") <= HORIZON_S), previous, ["dir", "dest"], "naptan_id", "time_to_station").select("dir", "dest", "naptan_id", F.lit(True).alias("leads"))
    p = p.withColumn("dest", F.coalesce("destination_name", F.lit(""))).join(leads, ["dir", "dest", "naptan_id"], "left")
    block = F.concat_ws("|", "line_id", "current_location")
    key = (
        F.when(F.col("has_id"), F.when(F.col("owner").isNull() | (F.col("owner") == F.col("line_id")), F.concat_ws(":", "line_id", "vehicle_id")))
        .when(F.col("has_loc"), F.when(F.col("owned"), None).when(F.col("ways") >= 2, F.when(F.col("dir") != "", F.concat_ws("|", block, "dir"))).otherwise(block))
        .when(F.col("line_id") == "dlr", F.when(F.col("leads"), F.concat(F.lit("dlr:"), F.concat_ws("|", "dir", "dest", "naptan_id"))))
        .when(F.col("time_to_station") <= HORIZON_S, F.concat_ws(":", "line_id", F.lit("tt"), "dest", "naptan_id"))
    )
    return p.withColumn("key", key).where("key is not null").withColumn("synthetic", ~F.col("has_id"))


def candidates(preds: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches that a prediction's stop lies on, in its direction if it has one (J3), with the first index of the stop. ``branch_ord`` is the order of the branches."""
    stops = branches.select("line_id", "branch_id", F.col("direction").alias("b_dir"), "branch_ord", F.posexplode("stops").alias("i", "s"), F.size("stops").alias("n_stops"), F.element_at("stops", -1)["name"].alias("terminus"))
    first = stops.groupBy("line_id", "branch_id", "b_dir", "branch_ord", "n_stops", "terminus", F.col("s.id").alias("naptan_id")).agg(F.min("i").alias("stop_index"))
    return preds.join(first, ["line_id", "naptan_id"]).where((F.coalesce("direction", F.lit("")) == "") | (F.col("direction") == F.col("b_dir")))


def chosen(cands: DataFrame, per: list[str], prev_branch: str = "prev_branch", prev_dir: str = "prev_dir") -> DataFrame:
    """One candidate each (J4): the branch it had before, else the one that ends at the stated destination, else the first mid-branch, else the first."""
    dest = F.lower(F.coalesce("destination_name", "towards", F.lit("")))
    last = F.lower("terminus")
    bare = F.regexp_replace(dest, " (underground|rail|dlr) station$", "")
    fits = (dest != "") & (F.contains(dest, last) | F.contains(last, bare))
    sticky = F.col(prev_branch).eqNullSafe(F.col("branch_id")) & F.col(prev_dir).eqNullSafe(F.col("b_dir"))
    prio = F.when(sticky, 0).when(fits, 1).when(F.col("stop_index") > 0, 2).otherwise(3)
    w = Window.partitionBy(*per).orderBy(prio, "branch_ord")
    return cands.withColumn("_c", F.row_number().over(w)).where("_c = 1").drop("_c")


def infer_trains(preds: DataFrame, branches: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Positioned trains of one poll.

    ``preds``: line_id, line_name, vehicle_id, naptan_id, station_name, time_to_station, current_location, platform_name, direction, destination_name,
    destination_naptan_id, towards, ord. ``branches``: line_id, branch_id, direction, stops, segments, run_times (branch order = branch_id). ``previous``: key, segment_key of the last poll (R5).
    """
    branches = branches.withColumn("branch_ord", F.col("branch_id"))
    kept = materialize(collapse(preds, branches))
    order = F.struct("time_to_station", "ord")
    row = F.struct(*[c for c in kept.columns if c != "key"])
    best = kept.groupBy("key").agg(F.min_by(row, order).alias("r")).select("key", "r.*").where(F.col("has_loc") | (F.col("time_to_station") <= HORIZON_S))  # A4, P5
    at_stop = kept.groupBy("key", "naptan_id").agg(F.min_by(F.struct("time_to_station", "current_location", "platform_name", "direction", "destination_name", "destination_naptan_id", "towards"), order).alias("next"))
    if previous is not None:
        parts = F.split("segment_key", ":")
        before = previous.select("key", F.get(parts, F.lit(1)).cast("int").alias("prev_branch"), F.get(parts, F.lit(2)).alias("prev_dir"))
        best = best.join(before, "key", "left")
    else:
        best = best.withColumn("prev_branch", F.lit(None).cast("int")).withColumn("prev_dir", F.lit(None).cast("string"))
    picked = chosen(candidates(best, branches), ["key"]).join(branches.select("line_id", "branch_id", F.col("direction").alias("b_dir"), "stops", "segments", "run_times"), ["line_id", "branch_id", "b_dir"])
    here = F.get("stops", F.col("stop_index"))
    waiting = (F.col("time_to_station") <= AT_PLATFORM_S) | F.coalesce(location_arm(F.col("current_location"), here["name"]) == "at", F.lit(False))
    # handoff: at the platform, the successor stop's countdown tells more
    onward = picked.withColumn("succ", F.when(waiting, F.get("stops", F.col("stop_index") + 1)["id"]))
    onward = onward.join(at_stop.withColumnRenamed("naptan_id", "succ"), ["key", "succ"], "left")
    moved = F.col("next").isNotNull()
    own_dir = F.nullif(F.col("direction"), F.lit(""))
    placed = onward.select(
        "key", "line_id", "line_name", "vehicle_id", "has_id", "synthetic", "branch_id", "b_dir", "stops", "segments", "run_times", (F.col("stop_index") + moved.cast("int")).alias("stop_index"),
        *[F.when(moved, F.col("next")[c]).otherwise(F.col(c)).alias(c) for c in ("time_to_station", "current_location", "platform_name", "destination_name", "destination_naptan_id", "towards")],
        F.when(moved, F.coalesce(own_dir, F.col("next")["direction"])).otherwise(F.col("direction")).alias("direction"),
    )
    stop = F.get("stops", F.col("stop_index"))
    placed = placed.withColumn("stop", stop).withColumn("arm", location_arm(F.col("current_location"), stop["name"]))
    placed = placed.withColumn("arrived", (F.col("stop_index") == 0) | (F.col("time_to_station") <= AT_PLATFORM_S) | F.coalesce(F.col("arm") == "at", F.lit(False)))
    placed = placed.withColumn("segment", F.when(F.col("stop_index") > 0, F.get("segments", F.col("stop_index") - 1)).otherwise(F.get("segments", F.lit(0)))).where("arrived or segment is not null")
    base = run_time(F.get("run_times", F.col("stop_index") - 1), line_length(F.coalesce("segment", F.array().cast("array<struct<lon:double,lat:double>>"))))
    left = F.coalesce(F.col("current_location").rlike("(?i)^(between|left) "), F.lit(False))
    stretched = F.when(left & (F.col("time_to_station") + DEPARTED_MARGIN_S > base), (F.col("time_to_station") + DEPARTED_MARGIN_S).cast("double")).otherwise(base)
    placed = placed.withColumn("run_time_s", F.when(~F.col("arrived"), stretched))
    raw = 1.0 - F.least(F.lit(1.0), F.col("time_to_station") / F.col("run_time_s"))
    moving = F.when(F.coalesce(F.col("arm") == "approaching", F.lit(False)), F.greatest(raw, F.lit(NEAR_FRACTION))).otherwise(raw)
    placed = placed.withColumn("segment_frac", F.when(F.col("arrived"), 1.0).otherwise(moving))
    at = F.when(F.col("arrived") & (F.col("stop_index") == 0), 0.0).otherwise(F.col("segment_frac"))
    out = placed.withColumn("at", polyline.point_at_fraction("segment", at))
    return out.select(
        "key", "line_id", F.coalesce("line_name", "line_id").alias("line_name"), F.when(F.col("has_id"), F.col("vehicle_id")).alias("vehicle_id"), F.col("stop.id").alias("next_stop_id"), F.col("stop.name").alias("next_stop_name"), "time_to_station",
        F.when(F.col("arrived"), F.col("stop.lon")).otherwise(F.col("at.lon")).alias("lon"), F.when(F.col("arrived"), F.col("stop.lat")).otherwise(F.col("at.lat")).alias("lat"), F.coalesce("at.bearing", F.lit(0.0)).alias("bearing"), "synthetic",
        F.when(F.col("stop_index") > 0, F.col("segment")).alias("segment"), "segment_frac", "run_time_s", F.when(F.col("stop_index") > 0, segment_key(F.col("line_id"), F.col("branch_id"), F.col("b_dir"), F.col("stop_index"))).otherwise("").alias("segment_key"),
        F.coalesce("direction", "b_dir").alias("direction"), F.coalesce("destination_name", "towards", F.lit("")).alias("destination"), F.col("destination_naptan_id").alias("destination_id"),
    )
