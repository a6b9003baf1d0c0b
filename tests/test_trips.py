import numpy as np
from pyspark.sql import functions as F

from ferrywake.operators.spikes import BUS_LAT
from ferrywake.operators.trips import lag_across, running_across, stop_stretches, stops_and_trips

SCHEMA = "id string, us long, lat double, lon double, chunk int, kind string, k string"


def run(spark, data, **kw):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in data], SCHEMA)
    out = stops_and_trips(df, "id", F.col("us"), F.col("lat"), F.col("lon"), BUS_LAT, **kw).collect()
    return sorted((r.id, r.kind, r.start_us // 10**6, r.end_us // 10**6, r.n_fixes) for r in out)


def route(id, legs, start=0, step=30):
    """legs: (fixes, metres per fix); returns rows and times."""
    rows, t, y = [], start, 0.0
    rng = np.random.default_rng(7)
    for n, move in legs:
        for _ in range(n):
            jitter = rng.uniform(-8, 8) if move == 0 else 0.0
            rows.append((id, t * 10**6, 51.5 + (y + jitter) / 111_195, 0.1))
            t += step
            y += move
    return rows


def test_stop_between_trips(spark):
    rows = route("a", [(20, 300), (25, 0), (20, 300)])
    rows += [rows[5], ("a", None, 51.5, 0.1), ("a", 7, None, 0.1), (None, 8, 51.5, 0.1), ("a", 615 * 10**6, 48.0, 0.1)]
    assert run(spark, rows) == [("a", "stop", 600, 1350, 26), ("a", "trip", 0, 600, 21), ("a", "trip", 1350, 1920, 20)]


def test_silence_ends_a_spell(spark):
    rows = route("a", [(10, 300)]) + route("a", [(10, 300)], start=10_000)
    assert run(spark, rows) == [("a", "trip", 0, 270, 10), ("a", "trip", 10_000, 10_270, 10)]


def test_chunk_bounds_do_not_show(spark):
    rows = route("a", [(20, 300), (60, 0), (20, 300), (80, 0), (30, 300)])
    assert run(spark, rows) == run(spark, rows, chunk_s=1111)


def test_two_rests_near_each_other_and_chunks(spark):
    # two rests 70 m apart form one stop only if all fixes fit one median, wherever chunk bounds lie
    rows = route("a", [(10, 300), (30, 0), (1, 70), (30, 0), (10, 300)]) + route("b", [(5, 400), (80, 1.9), (5, 400)])
    whole = run(spark, rows)
    for chunk_s in (700, 3_600):
        assert run(spark, rows, chunk_s=chunk_s) == whole
    assert sum(r[1] == "stop" for r in whole) >= 2


def test_differing_copies_give_a_row_that_exists(spark):
    rows = route("a", [(20, 300), (25, 0), (20, 300)])
    rows += [("a", rows[30][1], rows[30][2] + 0.002, 0.05), ("a", rows[31][1], 95.0, 0.0)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    stop = stops_and_trips(df, "id", F.col("us"), F.col("lat"), F.col("lon"), BUS_LAT).where("kind = 'stop'").collect()
    assert [(r.start_us // 10**6, r.end_us // 10**6, r.n_fixes) for r in stop] == [(600, 1350, 26)] and stop[0].lon == 0.1


def test_short_standing_is_no_stop(spark):
    assert [r[1] for r in run(spark, route("a", [(20, 300), (8, 0), (20, 300)]))] == ["trip"]


def test_single_fix_and_empty(spark):
    assert run(spark, [("a", 0, 51.5, 0.1)]) == [] and run(spark, []) == []


def test_stretches_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 60
        t = np.cumsum(rng.integers(20, 60, n)).astype(float)
        x, y = np.cumsum(rng.choice([0, 0, 0, 90], n) * rng.uniform(-1, 1, n)), rng.normal(0, 15, n)
        got = stop_stretches((t * 1e6).astype(np.int64), x, y, np.array([0]), np.ones(n, bool), 60.0, 300_000_000)
        fits = lambda a, b: np.hypot(x[a : b + 1] - np.median(x[a : b + 1]), y[a : b + 1] - np.median(y[a : b + 1])).max() <= 60
        for a, b in got:
            assert fits(a, b) and t[b] - t[a] >= 300
            assert b == n - 1 or not fits(a, b + 1)
            assert a == 0 or a - 1 in {q for _, q in got} or not fits(a - 1, b)
        covered = {i for a, b in got for i in range(a, b + 1)}
        for a in range(n):
            b = int(np.searchsorted(t, t[a] + 300))
            if b < n and fits(a, b):
                assert covered & set(range(a, b + 1))


def test_lag_and_sums_over_chunks(spark):
    df = spark.createDataFrame([("a", t // 10, t, t * 1.0) for t in range(0, 50, 3)] + [("b", 0, 1, 1.0)], "k string, chunk int, t int, v double")
    out = {(r.k, r.t): r for r in running_across(lag_across(df, ["k"], "chunk", ["t"], ["t"]), ["k"], "chunk", ["t"], {"total": F.col("v")}).collect()}
    total = 0
    for t in range(0, 50, 3):
        total += t
        assert out["a", t].prev_t == (t - 3 if t else None) and out["a", t].total == total
    assert out["b", 1].prev_t is None
