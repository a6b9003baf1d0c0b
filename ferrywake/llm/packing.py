"""Filling containers of fixed capacity (problem 8): hierarchical residual packing.

Items are packed best-fit (largest first) inside partitions. Bins that are nearly full are final; underfull ones go on as
items of the next round, in as many partitions as they then fill, where they are packed best-fit again, until one partition holds what is left
or a round no longer helps. Where an item ends up follows from one join per round of (bin -> bin it went into).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ferrywake.operators.series import group_starts, map_whole_groups
from ferrywake.session import materialize


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item (sizes 1..capacity), largest item first, each into the fullest bin it fits in.

    Open bins are kept by free space; a bit set of occupied free spaces gives the best fit at once.
    """
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), np.int64)
    by_free: dict[int, list[int]] = {}
    occupied = 0  # bit f is set while some open bin has f free
    bins = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = occupied >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                occupied &= ~(1 << free)
        else:
            free, b = capacity, bins
            bins += 1
        place[i] = b
        left = free - size
        if left:
            by_free.setdefault(left, []).append(b)
            occupied |= 1 << left
    return place


def pack(items: DataFrame, containers: DataFrame, item: str, size: str, container: str, capacity: str, full: float = 0.98, block_items: int = 50_000) -> DataFrame:
    """Pack every item into bins of every container: ``container, bin, item, part, tokens``.

    An item larger than the capacity is split: its parts 0, 1, ... fill bins of their own and the last, smaller part is packed like an
    item; no other item is split. ``bin`` is unique per container. Every item with a size of at least 1 appears with its whole size in
    each container; items of size 0, or with a null id or size, need no place and are left out, as are containers without a positive
    capacity. Containers listed twice with the same capacity count once. ``block_items`` bounds the items of one best-fit run.

    The containers are joined by broadcast: every item goes into each of them by definition, and they are checked to be few.
    """
    kinds = containers.select(F.col(container).alias("container"), F.col(capacity).cast("long").alias("capacity")).where("container is not null and capacity > 0").distinct()
    listed = [(r.container, r.capacity) for r in kinds.limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1000 containers")
    base = items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).where("item is not null and size > 0")
    spread = base.select("item", "size", F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).cast("long").alias("capacity")) for c, k in listed])).alias("c")) if listed else base.withColumn("c", F.struct(F.lit("").alias("container"), F.lit(1).cast("long").alias("capacity"))).where("false")
    sized = spread.select("item", "size", "c.*").withColumn("whole", F.expr("size div capacity")).withColumn("rest", F.expr("size % capacity"))
    exact = sized.where("whole > 0").select("container", "item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"), F.col("capacity").alias("tokens"))
    exact = exact.withColumn("bin", F.concat_ws("-", F.lit("x"), F.col("item").cast("string"), F.col("part").cast("string")))
    loose = materialize(sized.where("rest > 0").select("container", "capacity", "item", F.col("whole").alias("part"), F.col("rest").alias("size")))

    def fill(t: pa.Table) -> pa.Table:
        begin = np.flatnonzero(group_starts(t, ["container", "block"]))
        end = np.concatenate((begin[1:], [t.num_rows]))
        sizes = t.column("size").to_numpy()
        names, blocks, rounds = t.column("container").to_pylist(), t.column("block").to_pylist(), t.column("round").to_pylist()
        out: list[str] = []
        for b, e in zip(begin, end):
            prefix = f"{rounds[b]}-{blocks[b]}-"
            place = best_fit(sizes[b:e], t.column("capacity")[int(b)].as_py())
            out.extend(prefix + str(p) for p in place.tolist())
        del names
        return t.append_column("bin", pa.array(out, pa.string()))

    schema = "container string, capacity long, id string, size long, round int, block long, bin string"
    current = loose.select("container", "capacity", F.concat_ws("-", F.lit("i"), F.col("item").cast("string"), F.col("part").cast("string")).alias("id"), "size")
    n = {r.container: r["count"] for r in loose.groupBy("container").count().collect()}  # one row per container
    steps: list[DataFrame] = []
    for step in range(64):
        if not n:
            break
        blocks = F.element_at(F.create_map(*[x for c, k in n.items() for x in (F.lit(c), F.lit(max(1, math.ceil(k / block_items))))]), F.col("container"))
        keyed = current.withColumn("round", F.lit(step)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(step)), blocks).cast("long"))
        placed = materialize(map_whole_groups(keyed.select("container", "capacity", "id", "size", "round", "block"), ["container", "block"], ["id"], fill, schema))
        steps.append(placed.select("container", "id", "bin"))
        filled = placed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("size"))
        under = filled.where(F.col("size") < F.col("capacity") * F.lit(full)).select("container", "capacity", F.col("bin").alias("id"), "size")
        left = {r.container: r["count"] for r in under.groupBy("container").count().collect()}
        # a container whose items fitted one block is done: best-fit has seen all of them together
        again = {c: k for c, k in left.items() if n[c] > block_items and k < n[c]}
        current = under.where(F.col("container").isin(list(again))) if again else under
        n = again
    where = loose.select("container", "item", "part", F.col("size").alias("tokens"), F.concat_ws("-", F.lit("i"), F.col("item").cast("string"), F.col("part").cast("string")).alias("bin"))
    for k, step in enumerate(steps):
        moved = step.select("container", F.col("id").alias("bin"), F.col("bin").alias("into"))
        where = where.join(moved, ["container", "bin"], "left" if k else "inner").withColumn("bin", F.coalesce("into", "bin")).drop("into")
    columns = ["container", "bin", "item", "part", "tokens"]
    return where.select(*columns).unionByName(exact.select(*columns)).withColumnRenamed("item", item)


def fill_report(packed: DataFrame, containers: DataFrame, container: str, capacity: str) -> DataFrame:
    """Per container: bins, tokens and the share of the capacity that is used."""
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"))
    size = F.broadcast(containers.select(F.col(container).alias("container"), F.col(capacity).cast("long").alias("capacity")).where("container is not null and capacity > 0").distinct())
    total = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    return total.join(size, "container").withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity")))
