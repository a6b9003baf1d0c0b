"""Mixing sources to target weights (problem 9): capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F


def water_fill(available: Mapping[str, float], weight: Mapping[str, float], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """Size each source contributes: its share of ``total``, at most ``available * repeats``; what clamped sources lack is
    spread over the others in proportion to their weights, until nothing exceeds its cap. If all are clamped, the mix is smaller than ``total``."""
    cap = {s: available.get(s, 0.0) * max(0, repeats.get(s) or 0) for s in weight}
    out = {s: 0.0 for s in weight}
    free = {s for s in weight if weight[s] and weight[s] > 0 and cap[s] > 0}
    left = float(total)
    while free and left > 0:
        norm = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / norm >= cap[s]}
        if not over:
            for s in free:
                out[s] = left * weight[s] / norm
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        free -= over
    return out


def mix(items: DataFrame, targets: DataFrame, item: str, source: str, size: str, target_source: str, share: str, max_repeats: str, total: float | None = None, seed: int = 17, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Repetitions of each item and a report per source.

    Returns (``item, source, tokens, copies``: items with at least one copy) and (``source, target_share, tokens, actual_share, epochs,
    clamped``). ``total`` defaults to half of all sizes of the targeted sources. Whole epochs repeat every item; the fractional one takes items in the order of a
    seeded hash until the size is met, to within one item. The order is never formed over a whole source: sizes per hash bucket tell the bucket in
    which the limit falls (at most ``buckets`` rows per source), and only that bucket is ordered.

    Items with a null id, source or size, or of a source without target, get no copies. Targets listed twice are merged (largest share and repeats); null shares
    count 0. A target source without items contributes nothing and its share goes to the others.
    """
    want = targets.select(F.col(target_source).alias("source"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col(max_repeats).cast("int"), F.lit(0)).alias("repeats")).where("source is not null")
    rows = want.groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 sources in the targets")
    spark = items.sparkSession
    names = [r.source for r in rows]
    base = items.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("tokens")).where("item is not null and source is not null and tokens >= 0")
    base = base.where(F.col("source").isin(names)).withColumn("h", F.xxhash64("item", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    by_bucket = base.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    # bounded: one row per target source
    available = {r.source: float(r.size) for r in by_bucket.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    wanted = sum(available.values()) / 2 if total is None else float(total)
    shares = {r.source: r.share for r in rows}
    quota = water_fill(available, shares, {r.source: r.repeats for r in rows}, wanted)
    plan_rows = []
    for s in names:
        have, q = available.get(s, 0.0), quota.get(s, 0.0)
        whole = int(q // have) if have else 0
        cap = next(r.repeats for r in rows if r.source == s)
        plan_rows.append((s, float(shares[s]), whole, float(q - whole * have), bool(have and abs(q - have * cap) < 1e-6)))
    plan = F.broadcast(spark.createDataFrame(plan_rows, "source string, target_share double, whole int, part double, clamped boolean"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    level = by_bucket.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(plan, "source")
    verdict = level.select("source", "bucket", "whole", "before", "part", F.when(F.col("before") + F.col("size") <= F.col("part"), "all").when(F.col("before") < F.col("part"), "edge").otherwise("none").alias("fraction"))
    # at most buckets rows per target source; Spark broadcasts it only below its own size threshold
    judged = base.join(verdict, ["source", "bucket"])
    edge = judged.where("fraction = 'edge'")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(inside) <= F.col("part")).cast("int"))
    rest = judged.where("fraction <> 'edge'").withColumn("extra", (F.col("fraction") == "all").cast("int"))
    columns = ["item", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    chosen = edge.select(*columns).unionByName(rest.select(*columns)).where("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    have = spark.createDataFrame([(s, available.get(s, 0.0)) for s in names], "source string, have double")
    whole = F.greatest(F.coalesce(F.sum("used").over(Window.partitionBy()), F.lit(0)), F.lit(1))  # over the report's few rows
    report = plan.join(used, "source", "left").join(have, "source").select(
        "source", "target_share", F.coalesce("used", F.lit(0)).cast("long").alias("tokens"), (F.coalesce("used", F.lit(0)) / whole).alias("actual_share"),
        F.coalesce(F.try_divide(F.col("used").cast("double"), "have"), F.lit(0.0)).alias("epochs"), "clamped",
    )
    return chosen.withColumnRenamed("item", item), report
