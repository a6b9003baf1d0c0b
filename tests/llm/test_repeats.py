import random

from pyspark.sql import functions as F

from ferrywake.llm.repeats import position_runs, run_starts
from ferrywake.operators.series import np_haversine

SCHEMA = "fix_id long, id string, lat double, lon double, us long, node string, ptr int, k string, chunk int"


def runs(spark, data, least=1, **kw):
    df = spark.createDataFrame([(*r, "n", 1, "k", 2) for r in data], SCHEMA)
    out = position_runs(df, "id", "lat", "lon", F.col("us"), "fix_id", min_count=least, **kw).collect()
    return sorted((r.id, r.start_us, r.end_us, r.n) for r in out)


def brute(data, least=1):
    first = {}
    for f, i, la, lo, us in sorted((r for r in data if None not in r), key=lambda r: r[0]):
        first.setdefault((i, us), (la, lo))
    out, last = [], None
    for (i, us), (la, lo) in sorted(first.items()):
        if last and last[0] == i and us - last[1] <= 1800 * 10**6 and np_haversine(last[2], last[3], la, lo) <= 10:
            out[-1][2], out[-1][3] = us, out[-1][3] + 1
        else:
            out.append([i, us, us, 1])
        last = (i, us, la, lo)
    return sorted(tuple(r) for r in out if r[3] >= least)


def test_like_brute_force(spark):
    rng = random.Random(2)
    data, n = [], 0
    for i in ("a", "b", "c"):
        us, la = 0, 51.5
        for _ in range(150):
            n += 1
            us += rng.choice([30, 60, 1800, 1801]) * 10**6
            la += rng.choice([0, 0, 0, 0, 0.00005, 0.01])
            data.append((n, i, la, 0.1, us))
    data += [(n + 1, *data[3][1:]), (n + 2, "a", 50.0, 0.1, data[3][4]), (n + 3, "a", None, 0.1, 5), (n + 4, None, 51.5, 0.1, 5), (n + 5, "a", 51.5, 0.1, None)]
    rng.shuffle(data)
    for least in (1, 3):
        assert runs(spark, data, least) == brute(data, least)
    assert runs(spark, data, 3, chunk_s=3600) == brute(data, 3)


def test_long_chain_needs_few_rounds(spark):
    links = spark.createDataFrame([(n, n - 1) for n in range(1, 300)] + [(1001, 1000)], "node long, ptr long")
    out = {r.node: r.start for r in run_starts(links, max_rounds=10).collect()}
    assert out == {n: 0 for n in range(1, 300)} | {1001: 1000}


def test_empty(spark):
    assert runs(spark, []) == []
