import random

from ferrywake.operators import lookups
from ferrywake.operators.series import np_haversine


def brute(points, sites, r):
    out = {}
    for p, la, lo in points:
        near = [(float(np_haversine(la, lo, y, x)), s) for s, y, x in sites if None not in (p, la, lo, s, y, x) and max(abs(la), abs(y)) <= 90]
        if (best := min((n for n in near if n[0] <= r), default=None)) and best < out.get(p, (r + 1, "")):
            out[p] = best
    return {p: s for p, (_, s) in out.items()}


def nearest(spark, points, sites, r):
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    s = spark.createDataFrame(sites, "id string, y double, x double")
    return {a.id: a.id_site for a in lookups.nearest_within(p, "id", "lat", "lon", s, "id", "y", "x", r).collect()}


def test_dense_places_are_not_paired(spark, monkeypatch):
    rng, pairs = random.Random(5), []

    def counted(*a, **kw):
        out = within(*a, **kw)
        pairs.append(out.count())
        return out

    within = lookups.within_distance
    monkeypatch.setattr(lookups, "within_distance", counted)
    spot = lambda: (51.5 + rng.uniform(-0.002, 0.002), rng.uniform(-0.003, 0.003))
    points = [(n, *spot()) for n in range(200)] + [(n, 51.51, 0.01) for n in range(200, 300)]
    sites = [(f"s{n}", *spot()) for n in range(200)] + [(f"t{n}", 51.5, 0.0) for n in range(100)]
    assert nearest(spark, points, sites, 2000.0) == brute(points, sites, 2000.0)
    assert sum(pairs) <= 10 * len(points)  # of 90000 within reach


def test_like_brute_force_near_and_far(spark):
    rng = random.Random(6)
    spots = [(51.5 + rng.gauss(0, 0.02), rng.gauss(0, 0.03)) for _ in range(200)]
    points = [(n, *spots[n % 150]) for n in range(300)] + [(5, 51.5, 0.0), (900, None, 0.0), (901, 91.0, 0.0), (None, 51.5, 0.0)]
    sites = [(f"s{n:02}", *rng.choice(spots)) for n in range(30)] + [(f"c{n}", 51.52 + n * 1e-6, 0.03) for n in range(100)] + [(None, 51.5, 0.0), ("x", None, 0.0)]
    for r in (150.0, 3000.0):
        want = brute(points, sites, r)
        assert want and nearest(spark, [*points, (902, float("nan"), 0.0)], sites, r) == want
    assert nearest(spark, [], sites, 10.0) == nearest(spark, points, [], 10.0) == {}
