import pytest

from ferrywake.llm.mixing import mix, water_fill


def test_water_fill():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == {"a": 50, "b": 50}
    out = water_fill({"a": 10, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 2, "b": 1, "c": 1}, 200)
    assert out == {"a": 20, "b": 90, "c": 90}
    assert water_fill({"a": 10}, {"a": 1.0, "b": 1.0}, {"a": 3, "b": 5}, 1000) == {"a": 30, "b": 0.0}
    assert water_fill({}, {}, {}, 10) == {}


def run(spark, items, targets, total, **kw):
    i = spark.createDataFrame([(*r, 1, "x") for r in items], "doc long, src string, tok long, h int, bucket string")
    t = spark.createDataFrame([(*r, 1) for r in targets], "source string, share double, reps int, tokens int")
    return mix(i, t, "doc", "src", "tok", "source", "share", "reps", total, **kw)


def test_shares_caps_and_whole_items(spark):
    items = [(n, "big", 10) for n in range(3000)] + [(5000 + n, "small", 10) for n in range(20)] + [(9001, None, 10), (9002, "other", 10), (None, "big", 10), (9003, "big", None)]
    chosen, report = run(spark, items, [("big", 0.9, 1), ("small", 0.1, 3), ("none", 0.5, 9), (None, 1.0, 1)], 10_000, buckets=16)
    by = {r.source: r for r in report.collect()}
    assert by["small"].tokens == 600 and by["small"].clamped and by["small"].epochs == pytest.approx(3.0)
    assert 9380 <= by["big"].tokens <= 9400 and by["none"].tokens == 0
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1.0)
    copies = chosen.collect()
    assert all(r.copies == 3 for r in copies if r.source == "small") and max(r.copies for r in copies if r.source == "big") == 1
    again, _ = run(spark, items, [("big", 0.9, 1), ("small", 0.1, 3), ("none", 0.5, 9), (None, 1.0, 1)], 10_000, buckets=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies))


def test_fraction_above_one(spark):
    chosen, report = run(spark, [(n, "a", 7) for n in range(100)], [("a", 1.0, 5)], 1750)
    assert 1743 <= report.first().tokens <= 1750 and {r.copies for r in chosen.collect()} == {2, 3}


def test_empty(spark):
    chosen, report = run(spark, [], [("a", 1.0, 2)], 100)
    assert chosen.count() == 0 and report.first().tokens == 0
    chosen, report = run(spark, [(1, "a", 5)], [], 100)
    assert chosen.count() == 0 and report.count() == 0
