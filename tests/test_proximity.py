import random

from ferrywake.operators.proximity import within_distance
from ferrywake.operators.series import np_haversine


def pairs(spark, points, sites, r, **kw):
    p = spark.createDataFrame([(*x, 1, 2.0) for x in points], "pid long, lat double, lon double, bucket int, slat double")
    s = spark.createDataFrame([(*x, "z") for x in sites], "i string, y double, x double, sid string")
    return {(a.pid, a.i): a.distance_m for a in within_distance(p, "pid", "lat", "lon", s, "i", "y", "x", r, **kw).collect()}


def brute(points, sites, r):
    out = {}
    for p, la, lo in points:
        for i, y, x in sites:
            if None in (p, la, lo, i, y, x) or not (-90 <= la <= 90 and -180 <= lo <= 180 and -90 <= y <= 90 and -180 <= x <= 180):
                continue
            d = float(np_haversine(la, lo, y, x))
            if d <= r:
                out[p, i] = min(d, out.get((p, i), d))
    return out


def test_like_brute_force_both_ways(spark):
    rng = random.Random(1)
    points = [(n, 51.5 + rng.uniform(-0.02, 0.02), rng.uniform(-0.03, 0.03)) for n in range(300)] + [(900, None, 0.0), (901, 91.0, 181.0), (None, 51.5, 0.0), (902, float("nan"), 0.0)]
    sites = [(f"s{n}", 51.5 + rng.uniform(-0.02, 0.02), rng.uniform(-0.03, 0.03)) for n in range(60)] + [("s0", 51.5, 0.0), ("s0", 51.5, 0.0), (None, 51.5, 0.0), ("bad", None, 0.0)]
    for r, kw in ((250.0, {}), (1500.0, {"broadcast_rows": 0, "salts": 3})):
        want = brute(points, sites, r)
        got = pairs(spark, points, sites, r, **kw)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_date_line_and_poles(spark):
    points = [(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 89.9995, 10.0), (4, 89.9995, -170.0), (5, 90.0, 0.0), (6, -10.0, 180.0)]
    sites = [("e", 10.0, 180.0), ("w", 10.0, -180.0), ("n", 90.0, 0.0), ("m", 89.9999, 100.0)]
    want = brute(points, sites, 400.0)
    assert pairs(spark, points, sites, 400.0).keys() == want.keys() and len(want) > 6


def test_empty(spark):
    assert pairs(spark, [], [("a", 1.0, 1.0)], 10.0) == {} and pairs(spark, [(1, 1.0, 1.0)], [], 10.0) == {}
