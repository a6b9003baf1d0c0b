"""Feed-quality probes (A22) and trace housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ferrywake.operators.trips import lag_across


def countdown_regressions(polls: DataFrame, keys: list[str], time: str, stop: str, tts: str, chunk, least_s: int = 15) -> DataFrame:
    """Countdowns that rose by more than ``least_s`` against what was left, at the same next stop, and dues that didn't move.

    Returns ``keys, regressions, stuck_due, n``. ``chunk`` must not decrease with ``time``; times in seconds.
    """
    lagged = lag_across(polls.withColumn("_chunk", chunk), keys, "_chunk", [time], [time, stop, tts])
    same = F.col(stop).eqNullSafe(F.col("prev_" + stop)) & F.col("prev_" + time).isNotNull()
    rise = F.col(tts) - F.greatest(F.lit(0), F.col("prev_" + tts) - (F.col(time) - F.col("prev_" + time)))
    return lagged.groupBy(*keys).agg(F.count_if(same & (rise > least_s)).alias("regressions"), F.count_if(same & (F.col(tts) <= 15) & (F.col("prev_" + tts) <= 15)).alias("stuck_due"), F.count("*").alias("n"))


def presence_gaps(polls: DataFrame, keys: list[str], poll_no: str, chunk) -> DataFrame:
    """Times a key vanished and came back, and the longest absence in polls."""
    lagged = lag_across(polls.withColumn("_chunk", chunk), keys, "_chunk", [poll_no], [poll_no])
    gap = F.col(poll_no) - F.col("prev_" + poll_no) - 1
    return lagged.groupBy(*keys).agg(F.count_if(gap > 0).alias("gaps"), F.max(F.coalesce(gap, F.lit(0))).alias("longest"), F.count("*").alias("n"))


def vanished(polls: DataFrame, key: str, poll_no: str, stop: str, destination: str) -> DataFrame:
    """For keys gone before the last poll: whether they vanished at their destination or on the way."""
    last = polls.agg(F.max(poll_no).alias("_end"))
    ends = polls.groupBy(key).agg(F.max(poll_no).alias("_seen"), F.max_by(F.struct(F.col(stop).alias("s"), F.col(destination).alias("d")), poll_no).alias("_at"))
    end = last.first()._end  # one number
    return ends.where(F.col("_seen") < (end if end is not None else 0)).select(key, F.when(F.col("_at.s") == F.col("_at.d"), "destination").otherwise("mid-route").alias("where"))


def expired_partitions(files: DataFrame, day: str, size: str, today, keep_days: int = 7, most_bytes: int = 2 * 1024**3) -> DataFrame:
    """Partitions to delete (K2): older than ``keep_days``, then the oldest until the rest fits. One row per day, so one window holds them all."""
    days = files.groupBy(day).agg(F.sum(size).alias("bytes"))
    newest_first = Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    judged = days.withColumn("old", F.date_diff(F.to_date(today), F.to_date(day)) > keep_days)
    return judged.withColumn("kept", F.sum(F.when(F.col("old"), 0).otherwise(F.col("bytes"))).over(newest_first)).where(F.col("old") | (F.col("kept") > most_bytes)).select(day, "bytes", "old")


def delete_expired(spark, folder: str, today, keep_days: int = 7, most_bytes: int = 2 * 1024**3) -> DataFrame:
    """Delete the expired date partitions (``dt=...``) of a trace folder (K2) and return them: ``dt, bytes, old``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    parts = [p.getPath() for p in fs.listStatus(root) if p.isDirectory() and p.getPath().getName().startswith("dt=")]
    sizes = [(p.getName()[3:], int(fs.getContentSummary(p).getLength())) for p in parts]
    gone = expired_partitions(spark.createDataFrame(sizes, "dt string, bytes long"), "dt", "bytes", today, keep_days, most_bytes).collect()  # one row per day
    for r in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"dt={r.dt}"), True)
    return spark.createDataFrame(gone, "dt string, bytes long, old boolean")


def fix_counts(traces: DataFrame, key: str) -> DataFrame:
    return traces.groupBy(key).agg(F.count("*").alias("fixes"))  # A12


def systematic(df: DataFrame, keys: list[str], order: list[str], most: int = 20_000) -> DataFrame:
    """Every ``floor(n / most)``-th row of each key (A11), a sample by definition."""
    n = F.count("*").over(Window.partitionBy(*keys))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    step = F.greatest(F.lit(1).cast("long"), F.floor(n / most))
    return df.withColumn("_s", step).withColumn("_r", r).where((F.col("_r") - 1) % F.col("_s") == 0).drop("_s", "_r")
