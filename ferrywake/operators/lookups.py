"""Catalogue, preference and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.functions.text import safe_key
from ferrywake.operators.proximity import BITS, cover_level, point_code, within_distance
from ferrywake.session import discard, materialize


def bike_status(status: DataFrame, info: DataFrame, now_ms: Column, stale_ms: int = 1_800_000) -> DataFrame:
    """Bike status with its catalogue entry (J1): unknown stations are dropped, a station not reported for half an hour isn't renting.

    ``status``: station_id, bikes, docks, is_renting, is_installed, reported_ms (null if it can't be told, T17). ``info``: station_id, name, lon, lat, capacity.
    """
    stale = F.coalesce(now_ms - F.col("reported_ms") > stale_ms, F.lit(False))
    renting = F.coalesce("is_renting", F.lit(True)) & F.coalesce("is_installed", F.lit(True)) & ~stale
    return status.join(info, "station_id").select("station_id", "name", "lon", "lat", F.coalesce("bikes", F.lit(0)).alias("bikes"), F.coalesce("docks", F.lit(0)).alias("docks"), "capacity", renting.alias("renting"))


def preferred(left: DataFrame, right: DataFrame, on: list[str], per: list[str], preference: list[Column]) -> DataFrame:
    """Inner join that keeps each ``per`` group's best match by ``preference`` (J2), by a rank that Spark cuts inside partitions before the shuffle."""
    joined = left.join(right, on)
    w = Window.partitionBy(*per).orderBy(*preference)
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _halvings(spots: DataFrame, sites: DataFrame, radius_m: float) -> int:
    """How often to halve a radius so that a spot has a handful of sites within it on average: by the levels of cells, whose height goes with the radius."""
    level = cover_level(radius_m)

    def counts(df: DataFrame, n: str) -> DataFrame:
        fine = df.groupBy(point_code(F.col("lat"), F.col("lon")).alias("code")).agg(F.count("*").alias("c"))
        by_level = fine.withColumn("level", F.explode(F.sequence(F.lit(level), F.lit(BITS)))).withColumn("cell", F.expr(f"shiftright(code, 2 * ({BITS} - level))"))
        return by_level.groupBy("level", "cell").agg(F.sum(F.col("c").cast("double")).alias(n))

    met = counts(spots, "a").join(counts(sites, "b"), ["level", "cell"]).groupBy("level").agg((F.sum(F.col("a") * F.col("b")) / F.sum("a")).alias("mean"))
    mean = {r["level"]: r["mean"] for r in met.collect()}
    return next((n - level for n in range(level, BITS) if mean.get(n, 0.0) <= 4.0), BITS - level)


def nearest_within(points: DataFrame, pid: str, plat: str, plon: str, sites: DataFrame, sid: str, slat: str, slon: str, radius_m: float) -> DataFrame:
    """The nearest site of each point within a radius (J7, J10): ``pid, sid, distance_m``; equal distances go to the smaller ``sid``.

    Of sites of equal place only the smallest ``sid`` can be nearest, and points of equal place share theirs, so both are looked for by place. A place that has a site
    within half of a reach has its nearest there; so the search begins with a reach that holds a handful of sites, and places without any go on with twice the reach.
    """
    here = lambda df, key, lat, lon: df.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(F.col("key").isNotNull() & point_code(F.col("lat"), F.col("lon")).isNotNull())
    p = here(points, pid, plat, plon)
    left = materialize(p.select("lat", "lon").distinct())
    s = materialize(here(sites, sid, slat, slon).groupBy("lat", "lon").agg(F.min("key").alias("sid")))
    reach = radius_m / 2 ** _halvings(left, s, radius_m)
    found = None
    while True:
        near = within_distance(left.withColumn("spot", F.struct("lat", "lon")), "spot", "lat", "lon", s, "sid", "lat", "lon", reach)
        near = near.groupBy("spot").agg(F.min(F.struct("distance_m", F.col("sid").alias("s"))).alias("b")).select("spot.*", "b")
        if reach < radius_m:
            near = materialize(near)
            before, left = left, materialize(left.join(near, ["lat", "lon"], "left_anti"))
            discard(left.sparkSession, before)
        found = near if found is None else found.unionByName(near)
        if reach >= radius_m or left.isEmpty():
            break
        reach = min(radius_m, 2 * reach)
    best = p.join(found, ["lat", "lon"]).groupBy("key").agg(F.min("b").alias("b"))  # of several places of a point the one nearest to its site
    return best.select(F.col("key").alias(pid), F.col("b.s").alias(sid if sid != pid else f"{sid}_site"), F.col("b.distance_m").alias("distance_m"))


def far_from(points: DataFrame, pid: str, plat: str, plon: str, sites: DataFrame, sid: str, slat: str, slon: str, radius_m: float) -> DataFrame:
    """Points with no site nearer than ``radius_m``."""
    near = within_distance(points, pid, plat, plon, sites, sid, slat, slon, radius_m).where(F.col("distance_m") < radius_m)
    return points.join(near.select(pid).distinct(), pid, "left_anti")


def lift_disruption(stations: DataFrame, entries: DataFrame) -> DataFrame:
    """The first lift message for each station (J12): ids equal or one the start of the other, or the name in the entry's name or in the first 60 characters of its message.

    An OR of prefix and containment tests has no equality to join on; both sides are catalogues, and the smaller, the messages, is checked to be so.
    ``stations``: naptan, name. ``entries``: ord, uid, stop_name, message.
    """
    usable = entries.where(F.coalesce("message", F.lit("")) != "").select(F.col("ord").alias("_o"), F.coalesce("uid", F.lit("")).alias("_u"), F.lower(F.coalesce("stop_name", F.lit(""))).alias("_n"), F.col("message").alias("_m"))
    if usable.limit(20_001).count() > 20_000:
        raise ValueError("more than 20000 lift messages at a time")
    name = F.lower(F.trim("name"))
    by_id = (F.col("_u") != "") & (F.col("naptan").startswith(F.col("_u")) | F.col("_u").startswith(F.col("naptan")))
    by_name = F.contains(F.col("_n"), name) & (F.col("_n") != "")
    by_text = (name != "") & F.contains(F.lower(F.substring("_m", 1, 60)), name)
    hit = stations.join(F.broadcast(usable), by_id | by_name | by_text)
    return hit.groupBy("naptan", "name").agg(F.min_by("_m", "_o").alias("message"))


def snapped(points: DataFrame, crs: str, stations: DataFrame, gateways: dict[str, str]) -> DataFrame:
    """Calling points on stations of the network: their own, else the one their gateway snaps to; others are dropped."""
    known = stations.select(F.col("crs").alias("_crs")).where("_crs is not null").distinct()
    known = F.broadcast(known) if known.limit(20_001).count() <= 20_000 else known
    snap = F.try_element_at(F.create_map(*[F.lit(x) for kv in gateways.items() for x in kv]), F.col(crs)) if gateways else F.lit(None).cast("string")
    both = points.join(known, F.col(crs) == F.col("_crs"), "left").withColumn("_own", F.col("_crs")).drop("_crs").withColumn("_snap", snap)
    out = both.join(known, F.col("_snap") == F.col("_crs"), "left").withColumn("node", F.coalesce("_own", "_crs"))
    return out.where("node is not null").drop("_own", "_snap", "_crs")


def with_route(buses: DataFrame, routes: DataFrame) -> DataFrame:
    """Each bus with the learned route of its key, if there is one."""
    key = F.concat_ws(":", "operator", "line", "direction")
    return buses.withColumn("key", key).withColumn("_safe", safe_key(F.col("key"))).join(routes.withColumn("_safe", safe_key(F.col("key"))).drop("key"), "_safe", "left").drop("_safe")


def departures(predictions: DataFrame, keys: list[str], tts: str, order: str, n: int) -> DataFrame:
    """The next ``n`` departures of each board (L2): missing times last, ties in feed order."""
    w = Window.partitionBy(*keys).orderBy(F.col(tts).asc_nulls_last(), order)
    return predictions.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def calling_pattern(predictions: DataFrame, train: list[str], station: str, tts: str) -> DataFrame:
    return predictions.groupBy(*train, station).agg(F.min(tts).alias(tts))  # A15


def disruption_text(statuses: DataFrame, line: str) -> DataFrame:
    """Distinct descriptions other than 'Good Service', joined, and the distinct reasons of a line (A16). ``statuses``: line, ord, description, reason."""
    w = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col("description") != "Good Service"), F.struct("ord", F.col(c).alias("v"))))), lambda s: s["v"]))
    return statuses.groupBy(line).agg(F.array_join(w("description"), ", ").alias("description"), w("reason").alias("reasons"))


def lines_at(points: DataFrame, pid: str, plat: str, plon: str, vertices: DataFrame, radius_m: float) -> DataFrame:
    """Distinct sorted lines that pass each point (A23); ``vertices``: vid, line_id, lat, lon of resampled tracks."""
    near = within_distance(points, pid, plat, plon, vertices, "vid", "lat", "lon", radius_m)
    return near.join(vertices.select("vid", "line_id"), "vid").groupBy(pid).agg(F.array_sort(F.collect_set("line_id")).alias("lines"))


def active_lines(buses: DataFrame, line: str, wanted: list[str] | None = None) -> DataFrame:
    """Buses per line, lines trimmed and upper-cased."""
    label = F.upper(F.trim(line))
    rows = buses.select(label.alias("line")).where(F.coalesce(F.col("line"), F.lit("")) != "")
    if wanted is not None:
        rows = rows.where(F.col("line").isin([w.strip().upper() for w in wanted]))
    return rows.groupBy("line").agg(F.count("*").alias("buses"))
