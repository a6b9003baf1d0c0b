"""The live path (R1-R5, S1-S3, K1-K4): file streams, keyed state with expiry, and snapshot tables.

The same rules as in batch, with the state held per key: the last fix of a vehicle, or its merged row. Rows of a key are applied in order of arrival.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ferrywake.functions.clock import period_keys
from ferrywake.operators.leaderboard import MAX_GAP_MS, MIN_MOVE_M, SPEED_CAPS, within_retention
from ferrywake.operators.series import EARTH_M
from ferrywake.sources.feeds import bus_activities

LAST_FIX_TTL_MS, VESSEL_TTL_MS = 900_000, 600_000


def use_rocksdb(spark: SparkSession) -> None:
    """State store for the keyed processors; batches run only when there is data, and state that has outlived its time is hidden on reading."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bus_stream(spark: SparkSession, path: str, now=None, files_per_trigger: int = 20) -> DataFrame:
    """Bus fixes from captured documents as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return bus_activities(raw, "value", F.current_timestamp() if now is None else now)


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


class Credits(StatefulProcessor):
    """Credited distance of each fix against the vehicle's last one (W1, R2); a rejected fix still becomes the last."""

    def __init__(self, max_gap_ms: int = MAX_GAP_MS, min_move_m: float = MIN_MOVE_M, caps: dict[str, float] | None = None) -> None:
        self.max_gap_ms, self.min_move_m, self.caps = max_gap_ms, min_move_m, caps or SPEED_CAPS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "lat double, lon double, t_ms long", LAST_FIX_TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples():
            if last is not None:
                gap, move = r.t_ms - last[2], _metres((last[0], last[1]), (r.lat, r.lon))
                if 0 < gap <= self.max_gap_ms and move >= self.min_move_m and move / (gap / 1000) <= self.caps.get(r.mode, 40.0):
                    out.append((r.mode, key[0], r.label, r.line_id, int(r.ord), int(r.tick_ms), move))
            last = (float(r.lat), float(r.lon), int(r.t_ms))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["mode", "id", "label", "line_id", "ord", "tick_ms", "move_m"])

    def close(self) -> None:
        pass


def credits(fixes: DataFrame, processor: Credits | None = None) -> DataFrame:
    """Stream of credited distances from a stream of fixes: mode, id, label, line_id, lat, lon, t_ms, tick_ms, ord."""
    good = fixes.where("id is not null and lat is not null and lon is not null and t_ms is not null")
    return good.groupBy("id").transformWithStateInPandas(processor or Credits(), "mode string, id string, label string, line_id string, ord long, tick_ms long, move_m double", "append", "processingtime")


class Merged(StatefulProcessor):
    """A vehicle's row merged from partial messages: what a message lacks is carried forward (S3, R4), until the vehicle is silent for too long."""

    def __init__(self, key: str, columns: list[tuple[str, str]], ttl_ms: int = VESSEL_TTL_MS) -> None:
        self.key, self.columns, self.ttl_ms = key, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", ", ".join(f"{n} {t}" for n, t in self.columns), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [n for n, _ in self.columns]
        known = dict(zip(names, self.row.get())) if self.row.exists() else dict.fromkeys(names)
        for r in pd.concat(list(rows)).sort_values("last_seen", kind="stable").to_dict("records"):
            known = {n: (r[n] if r[n] is not None and r[n] == r[n] else known[n]) for n in names}
        self.row.update(tuple(known[n].item() if hasattr(known[n], "item") else known[n] for n in names))
        yield pd.DataFrame([{self.key: key[0], **known}])

    def close(self) -> None:
        pass


def merged_vessels(messages: DataFrame, ttl_ms: int = VESSEL_TTL_MS) -> DataFrame:
    columns = [("name", "string"), ("lat", "double"), ("lon", "double"), ("sog", "double"), ("cog", "double"), ("ship_type", "int"), ("destination", "string"), ("length_m", "int"), ("width_m", "int"), ("draught_m", "double"), ("last_seen", "long")]
    schema = "mmsi long, " + ", ".join(f"{n} {t}" for n, t in columns)
    return messages.where("mmsi is not null").groupBy("mmsi").transformWithStateInPandas(Merged("mmsi", columns, ttl_ms), schema, "update", "processingtime")


class Changed(StatefulProcessor):
    """Fixes whose time differs from the last written one of their vehicle (K1, D3)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        f = pd.concat(list(rows)).sort_values("ord", kind="stable")
        keep = []
        for t in f["t"].tolist():
            keep.append(t != last)
            last = t
        if last is not None:
            self.last.update((int(last),))
        yield f.loc[keep, ["k", "i", "x", "y", "t"]]

    def close(self) -> None:
        pass


def trace_lines(buses: DataFrame) -> DataFrame:
    """Trace rows of bus fixes: k key, i vehicle, x lon, y lat, t epoch seconds (K1), ``ord`` the order of arrival, or of time where there is none; rows without line are skipped."""
    order = F.col("ord").cast("long") if "ord" in buses.columns else F.unix_seconds("recorded_at")
    return buses.where("line <> ''").select(order.alias("ord"), F.concat_ws(":", "operator", "line", "direction").alias("k"), F.col("id").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.unix_seconds("recorded_at").alias("t"))


def trace_sink(buses: DataFrame, path: str, checkpoint: str, seconds: int = 5) -> DataStreamWriter:
    """Writer of changed fixes as JSON lines by UTC date (K1)."""
    rows = trace_lines(buses).groupBy("i").transformWithStateInPandas(Changed(), "k string, i string, x double, y double, t long", "append", "none")
    dated = rows.withColumn("dt", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"))
    return dated.writeStream.format("json").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds} seconds")


FACTS = "mode string, period string, bucket string, id string, m double, label string, line_id string, first_ord long, last_ord long"


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of the board with rows that can't be right left out (K4); empty if there is none."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], FACTS)
    return spark.read.schema(FACTS).parquet(path).where("id is not null and m is not null and not isnan(m) and m < double('infinity')")


def add_credits(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """The board after a batch of credits: metres add up, the latest label and the first line stay (A1, A2)."""
    new = batch.select("mode", "id", "label", "line_id", "ord", F.col("move_m").alias("m"), F.explode(period_keys(F.timestamp_millis("tick_ms"))).alias("p"))
    rows = new.select("mode", F.col("p.period").alias("period"), F.col("p.bucket").alias("bucket"), "id", "m", "label", "line_id", F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord"))
    both = facts.unionByName(rows)
    return both.groupBy("mode", "period", "bucket", "id").agg(F.sum("m").alias("m"), F.max_by("label", "last_ord").alias("label"), F.min_by("line_id", "first_ord").alias("line_id"), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"))


def newest_snapshot(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """Number that batch 0 of a checkpoint has on the board: noted beside the checkpoint when it is new, one more than the newest snapshot there is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root, note = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(checkpoint + ".first")
    fs = root.getFileSystem(conf)
    if fs.exists(note):
        return int(spark.read.text(str(note)).first()[0])
    numbers = [int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(root) if p.getPath().getName().startswith("snapshot=")] if fs.exists(root) else []
    first = max(numbers, default=-1) + 1
    spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.mode("overwrite").text(str(note))
    return first


def board_sink(stream: DataFrame, folder: str, checkpoint: str, seconds: int | None = 15) -> DataStreamWriter:
    """Writer that keeps the board as snapshots (R1, R3, K3): each batch reads the newest one, adds its credits, drops buckets past their retention and writes the next.

    Snapshots are numbered on from what the folder holds when the writer is made, so a new checkpoint goes on with the old board; a replayed batch writes the same snapshot again.
    Without ``seconds`` it takes what is there and ends.
    """
    first = newest_snapshot(stream.sparkSession, folder, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = first + number
        before = load_facts(spark, f"{folder}/snapshot={at - 1}")
        after = add_credits(before, batch)
        newest = after.where("period = 'day'").agg(F.max("bucket")).first()[0]  # the board's own clock, so that a replay expires the same
        kept_ = after if newest is None else within_retention(after, F.lit(newest).cast("timestamp"))
        kept_.write.mode("overwrite").parquet(f"{folder}/snapshot={at}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot={at - 3}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
