import random

import pytest
from pyspark.sql import functions as F

from ferrywake.operators.grid import iso_micros, regular_grid


def grid(spark, data, **kw):
    df = spark.createDataFrame([(*r, "slot", 1.0) for r in data], "ref string, us long, v double, rid long, state string, mean double")
    return {(r.ref, r.slot_s): r for r in regular_grid(df, "ref", "us", "v", "rid", **kw).collect()}


S = 1_000_000


def test_slots_means_and_gaps(spark):
    out = grid(spark, [("a", 0, 1.0, 1), ("a", 450 * S, 3.0, 2), ("a", 450 * S, 9.0, 3), ("a", 4 * 900 * S, 5.0, 4), ("b", 10 * S, None, 5), (None, 0, 1.0, 6), ("c", None, 1.0, 7), ("d", -1 * S, 2.0, 8)], hold_s=1000)
    assert sorted(k for k in out if k[0] == "a") == [("a", s * 900) for s in range(5)]
    assert out["a", 0].mean == pytest.approx(2.0) and out["a", 0].coverage == pytest.approx(1.0) and out["a", 0].n_readings == 2
    assert (out["a", 900].state, out["a", 900].n_readings) == ("filled", 0) and out["a", 900].coverage == pytest.approx(550 / 900)
    assert out["a", 1800].state == "missing" and out["a", 1800].mean is None
    assert out["a", 3600].state == "read"
    assert ("d", -900) in out and not any(k[0] in ("b", "c", None) for k in out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = [(k, rng.randrange(0, 200_000) * S, float(rng.randrange(10)), n) for n, k in enumerate(["x"] * 80 + ["y"] * 40)]
    out = grid(spark, data, hold_s=2000, chunk_s=7200)
    for key in ("x", "y"):
        first = {}
        for k, us, v, n in sorted(data, key=lambda r: (r[1], r[3])):
            if k == key:
                first.setdefault(us, v)
        times = sorted(first)
        for slot in range(times[0] // (900 * S), times[-1] // (900 * S) + 1):
            lo, hi = slot * 900 * S, (slot + 1) * 900 * S
            w = vw = 0.0
            for n, t in enumerate(times):
                end = min(t + 2000 * S, times[n + 1] if n + 1 < len(times) else 1 << 62)
                o = max(0, min(end, hi) - max(t, lo))
                w, vw = w + o, vw + o * first[t]
            r = out[key, slot * 900]
            assert r.n_readings == sum(lo <= t < hi for t in times) and r.coverage == pytest.approx(w / (900 * S))
            assert (r.mean is None) == (w == 0) and (w == 0 or r.mean == pytest.approx(vw / w))


def test_empty(spark):
    assert grid(spark, []) == {}


def test_times(spark):
    texts = ["2014-01-01T00:00:00Z", "2014-01-01T01:00:00+01:00", "2014-01-01T00:00:00.000Z", "2013-12-31T22:00:00-02:00", "20140101T000000Z", "2014-01-01T00:00Z", "2014-01-01T01:00:00+0100", "n/a", "", None, "2014-01-01T00:00:00", "2014-13-01T00:00:00Z"]
    out = [r.u for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", iso_micros(F.col("t")).alias("u")).orderBy("n").collect()]
    assert out[:7] == [1_388_534_400_000_000] * 7 and out[7:] == [None] * 5
