import random
from collections import defaultdict

import numpy as np

from ferrywake.llm.packing import best_fit, fill_report, pack


def check(spark, sizes, boxes, **kw):
    items = spark.createDataFrame([(n, s, "x", 1) for n, s in enumerate(sizes)], "doc long, size long, bin string, part int")
    cont = spark.createDataFrame([(*b, "y") for b in boxes], "container string, cap int, item string")
    packed = pack(items, cont, "doc", "size", "container", "cap", **kw)
    load, whole, parts = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in packed.collect():
        load[r.container, r.bin] += r.tokens
        whole[r.container, r.doc] += r.tokens
        parts[r.container, r.doc] += 1
    caps = {c: k for c, k in boxes if c is not None and k and k > 0}
    for (c, _), used in load.items():
        assert used <= caps[c]
    for c, k in caps.items():
        for n, s in enumerate(sizes):
            if s:
                assert whole[c, n] == s and parts[c, n] == -(-s // k)
    return packed, cont


def test_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 400) for _ in range(600)] + [0, None, 5000, 128, 256]
    packed, cont = check(spark, sizes, [("a", 128), ("b", 512), ("b", 512), ("bad", 0), (None, 5)])
    assert all(r.filled > 0.95 for r in fill_report(packed, cont.where("cap > 0 and container is not null"), "container", "cap").collect())


def test_many_blocks_are_merged(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(800)]
    packed, cont = check(spark, sizes, [("a", 1000)], block_items=25)
    assert fill_report(packed, cont, "container", "cap").first().filled > 0.9


def test_best_fit():
    place = best_fit(np.array([6, 5, 5, 4]), 10)
    load = defaultdict(int)
    for b, s in zip(place, (6, 5, 5, 4)):
        load[b] += s
    assert sorted(load.values()) == [10, 10]


def test_empty(spark):
    check(spark, [], [("a", 10)])
    check(spark, [None, 0], [("a", 10)])
    items = spark.createDataFrame([(1, 5)], "doc long, size long")
    assert pack(items, spark.createDataFrame([], "container string, cap int"), "doc", "size", "container", "cap").count() == 0
