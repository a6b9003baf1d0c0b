from pyspark.sql import functions as F

from ferrywake.operators import leaderboard
from ferrywake.streaming import live

SCHEMA = "mode string, id string, label string, line_id string, lat double, lon double, t_ms long, tick_ms long, ord long"


def test_stream_credits_like_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = [("bus", f"v{k % 3}", "l", "n", 51.5 + k * 0.0005, 0.0, 20_000 * k, 20_000 * k, k) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    src = str(tmp_path / "in")
    for part in range(2):
        df.where((F.col("ord") >= part * 30) & (F.col("ord") < part * 30 + 30)).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = live.board_sink(live.credits(stream), str(tmp_path / "board"), str(tmp_path / "cp"), seconds=None).start()
    assert q.awaitTermination(120)
    assert q.exception() is None
    last = live.load_facts(spark, str(tmp_path / "board" / "snapshot=1"))
    want = leaderboard.totals(leaderboard.outcomes(df, caps=leaderboard.SPEED_CAPS, time_policy="fix"))
    got = {(r.period, r.bucket, r.id): round(r.m, 6) for r in last.collect()}
    assert got == {(r.period, r.bucket, r.id): round(r.m, 6) for r in want.collect()} and len(got) == 9
    assert live.load_facts(spark, str(tmp_path / "none")).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
