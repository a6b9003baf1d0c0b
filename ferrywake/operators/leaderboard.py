"""Distance leaderboards.

A vehicle is credited with the distance between neighbouring fixes in order of arrival, if gap, distance and implied speed are
plausible. A rejected fix still is the next one's predecessor, so the lag is plain. Buckets are days, weeks and months in London.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.functions.clock import kept, period_keys
from ferrywake.functions.text import half_up
from ferrywake.operators.series import floor_div, haversine
from ferrywake.operators.trips import lag_across

# Rules for crediting distance, and river lines that rank as ships.
MAX_GAP_MS = 300_000
MIN_MOVE_M = 5.0
SPEED_CAPS = {"ship": 25.0, "tube": 40.0, "bus": 40.0, "nr": 65.0}
RIVER_LINES = ("rb1", "rb4", "rb6", "woolwich-ferry")
TOP = 20


def outcomes(fixes: DataFrame, max_gap_ms: int = MAX_GAP_MS, min_move_m: float = MIN_MOVE_M, caps: dict[str, float] | float = 40.0, time_policy: str = "tick", chunk_rows: int = 1_000_000) -> DataFrame:
    """Each fix with ``gap_ms``, ``move_m`` and ``outcome``: 'first', 'gap', 'jitter', 'teleport' or 'ok' (W1).

    ``fixes``: mode, id, label, line_id, lat, lon, t_ms, tick_ms, ord (arrival number). ``time_policy`` 'tick' measures gaps
    between ticks, 'fix' between fix times (T2). A vehicle's fixes are windowed in pieces of ``chunk_rows`` arrival numbers. Rows with a null id, position, time or ord don't count.
    """
    time = "tick_ms" if time_policy == "tick" else "t_ms"
    base = fixes.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(time).isNotNull() & F.col("tick_ms").isNotNull() & F.col("ord").isNotNull())
    lagged = lag_across(base.withColumn("_chunk", floor_div(F.col("ord"), chunk_rows)), ["id"], "_chunk", ["ord"], ["lat", "lon", time])
    gap = F.col(time) - F.col("prev_" + time)
    move = haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    if isinstance(caps, dict):
        cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("mode")), F.lit(40.0))
    else:
        cap = F.lit(float(caps))
    out = lagged.withColumn("gap_ms", gap).withColumn("move_m", move).drop("_chunk", "prev_lat", "prev_lon", "prev_" + time)
    verdict = F.when(F.col("gap_ms").isNull(), "first").when((F.col("gap_ms") <= 0) | (F.col("gap_ms") > max_gap_ms), "gap").when(F.col("move_m") < min_move_m, "jitter")
    return out.withColumn("outcome", verdict.when(F.col("move_m") / (F.col("gap_ms") / 1000.0) > cap, "teleport").otherwise("ok"))


def totals(judged: DataFrame) -> DataFrame:
    """Metres per (period, bucket, mode, id), with the latest label and the first line (A1, A2). Buckets follow the tick time (T4)."""
    rows = judged.where("outcome = 'ok'").select("mode", "id", "label", "line_id", "ord", F.col("move_m").alias("m"), F.explode(period_keys(F.timestamp_millis("tick_ms"))).alias("p"))
    return rows.groupBy("p.period", "p.bucket", "mode", "id").agg(F.sum("m").alias("m"), F.max_by("label", "ord").alias("label"), F.min_by("line_id", "ord").alias("line_id"), F.min("ord").alias("first_ord"))


def ranked(facts: DataFrame) -> DataFrame:
    """Position by metres inside each board, ties in order of first credit (W2, T5), and vehicles on the board (A3)."""
    board = ["mode", "period", "bucket"]
    place = F.row_number().over(Window.partitionBy(*board).orderBy(F.desc("m"), "first_ord"))
    size = facts.groupBy(*board).agg(F.count("*").alias("total"))
    return facts.withColumn("rank", place.cast("long")).join(size, board)


def top(facts: DataFrame, n: int = TOP) -> DataFrame:
    """The first ``n`` of each board, km to one decimal."""
    board = ["mode", "period", "bucket"]
    place = F.row_number().over(Window.partitionBy(*board).orderBy(F.desc("m"), "first_ord"))
    return facts.withColumn("rank", place.cast("long")).where(F.col("rank") <= n).select(*board, "rank", "id", "label", "line_id", "m", (half_up(F.col("m") / 100.0) / 10.0).alias("km"))


def within_retention(facts: DataFrame, now: Column) -> DataFrame:
    return facts.where(kept(F.col("period"), F.col("bucket"), now))  # R3


def creditable(trains: DataFrame) -> DataFrame:
    """Train positions as fixes: synthetic and id-less trains are shown but not credited (T13); river lines rank as ships."""
    mode = F.when(F.col("line_id").isin(*RIVER_LINES), "ship").otherwise("tube")
    prefix = F.when(F.col("line_id").isin(*RIVER_LINES), "ship:tfl:").otherwise("tube:")
    return trains.where(~F.col("synthetic") & F.col("vehicle_id").isNotNull()).select(mode.alias("mode"), F.concat(prefix, "key").alias("id"), F.concat_ws(" ", F.initcap("line_id"), "vehicle_id").alias("label"), "line_id", "lat", "lon")


# Namespaces of board ids, the longer before those that begin alike, and the live table that each is looked up in.
NAMESPACES = (("tube:", "trains"), ("train:nr:", "rail"), ("ship:tfl:", "boats"), ("bus:", "buses"), ("ship:", "vessels"))


def located(rows: DataFrame, live: dict[str, DataFrame]) -> DataFrame:
    """Board rows with the live position of their id (J14), looked up in the table of its namespace: ``live`` maps the names in `NAMESPACES` to tables of ``id, lon, lat``.

    Live ids lack the namespace. Rows of another namespace, or whose vehicle isn't live, have no position.
    """
    table, bare = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, name in reversed(NAMESPACES):
        mine = F.col("id").startswith(prefix)
        table, bare = F.when(mine, name).otherwise(table), F.when(mine, F.substring("id", len(prefix) + 1, 2**30)).otherwise(bare)
    keyed = None
    for name, df in live.items():
        part = df.where("id is not null").groupBy(F.col("id").cast("string").alias("_bare")).agg(F.min(F.struct("lon", "lat")).alias("_at")).withColumn("_table", F.lit(name))
        keyed = part if keyed is None else keyed.unionByName(part)
    if keyed is None:
        return rows.withColumn("lon", F.lit(None).cast("double")).withColumn("lat", F.lit(None).cast("double"))
    out = rows.withColumn("_table", table).withColumn("_bare", bare).join(keyed, ["_table", "_bare"], "left")
    return out.withColumn("lon", F.col("_at.lon")).withColumn("lat", F.col("_at.lat")).drop("_table", "_bare", "_at")


def styled(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Name and colour of a row's line, where it has one (J15). ``lines`` is the manifest, checked to be small."""
    catalogue = lines.select(F.col("id").alias("line_id"), F.col("name").alias("line_name"), F.coalesce("display_color", "color").alias("color")).dropDuplicates(["line_id"])
    few = catalogue.limit(10_001).count() <= 10_000
    return rows.join(F.broadcast(catalogue) if few else catalogue, "line_id", "left").withColumn("line_name", F.coalesce("line_name", "line_id"))
