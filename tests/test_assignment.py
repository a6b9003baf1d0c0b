import random

import pytest

from ferrywake.operators import network
from ferrywake.operators.series import np_haversine


def greedy(stations, nodes, r):
    taken, out = set(), {}
    for s, y, x, _ in sorted((s for s in stations if None not in s[:3]), key=lambda s: (s[3] is not None, s[3], s[0])):
        near = sorted((float(np_haversine(y, x, la, lo)), n) for n, la, lo in nodes if None not in (n, la, lo) and n not in taken)
        if near and near[0][0] <= r:
            out[s] = near[0][1]
            taken.add(near[0][1])
    return out


def assigned(spark, stations, nodes, r):
    s = spark.createDataFrame(stations, "sid long, lat double, lon double, ord int")
    return {a.sid: a.nid for a in network.assign_distinct(s, spark.createDataFrame(nodes, "nid string, lat double, lon double"), r).collect()}


def test_pairs_are_not_stored(spark, monkeypatch):
    written = []

    def counted(df, *a):
        out = stored(df, *a)
        written.append(out.count())
        return out

    stored = network.materialize
    monkeypatch.setattr(network, "materialize", counted)
    stations = [(n, 51.5, 0.0, 50 - n) for n in range(40)]
    nodes = [(f"n{n:02}", 51.5 + 0.0001 * (n % 3), 0.0) for n in range(60)]
    assert assigned(spark, stations, nodes, 500.0) == greedy(stations, nodes, 500.0)
    assert sum(written) <= 3 * (len(stations) + len(nodes))  # of 2400 pairs within reach


def test_like_greedy_over_cells(spark):
    rng = random.Random(3)
    stations = [(n, 51.5 + rng.uniform(-0.02, 0.02), rng.uniform(-0.04, 0.04), rng.choice([None, *range(20)])) for n in range(150)] + [(900, None, 0.0, 1), (None, 51.5, 0.0, 2)]
    nodes = [(f"n{n}", 51.5 + rng.uniform(-0.02, 0.02), rng.uniform(-0.04, 0.04)) for n in range(120)] + [(None, 51.5, 0.0), ("x", None, 0.0)]
    nodes += [(f"d{n}", *nodes[0][1:]) for n in range(10)]
    for r in (200.0, 700.0):
        want = greedy(stations, nodes, r)
        assert len(want) > 40 and assigned(spark, stations, nodes, r) == want


def test_repeated_rows_and_none(spark):
    twice = [(1, 51.5, 0.0, 1), (1, 51.5, 0.0, 1), (2, 51.5, 0.0, 2)]
    assert assigned(spark, twice, [("b", 51.5, 0.0), ("b", 51.5, 0.0001), ("a", 51.5, 0.0002)], 500.0) == {1: "b", 2: "a"}
    assert assigned(spark, [], [("a", 51.5, 0.0)], 500.0) == assigned(spark, twice, [], 500.0) == assigned(spark, twice, [("a", 52.5, 0.0)], 500.0) == {}
    with pytest.raises(Exception, match="several places"):
        assigned(spark, [*twice, (1, 51.6, 0.0, 1)], [("a", 51.5, 0.0)], 500.0)
