import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrywake.operators.spikes import BUS_LAT, TIDE_LEVEL, VESSEL_SOG, flag_series, implausible


def tide(n=400, amp=2.0):
    t = np.arange(n) * 900.0
    return t, np.round(amp * np.sin(2 * np.pi * t / 44_700), 2)


def test_tide_spikes_bounds_and_held():
    t, x = tide()
    x[50] += 3.0
    x[120:122] -= 2.5
    x[200] = -999.0
    x[300:320] = x[300]
    code = flag_series(t, x, None, TIDE_LEVEL)
    assert code[50] == 2 and (code[120:122] == 2).all() and code[200] == 1 and (code[301:320] == 3).all() and code[300] == 0
    assert np.count_nonzero(code) == 23


def test_dock_that_hardly_moves_is_normal():
    t = np.arange(300) * 900.0
    x = np.full(300, 0.78)
    x[::7] = 0.79
    assert not flag_series(t, x, None, TIDE_LEVEL).any()
    x[100] = 1.6
    assert np.flatnonzero(flag_series(t, x, None, TIDE_LEVEL)).tolist() == [100]


def test_surge_is_real():
    t, x = tide()
    x = x + 1.2 * np.exp(-(((t - 200 * 900.0) / 14_400) ** 2))
    assert not flag_series(t, np.round(x, 2), None, TIDE_LEVEL).any()


def test_bus_lat_held_and_jump():
    rng = np.random.default_rng(3)
    n = 200
    t = np.cumsum(rng.uniform(30, 60, n))
    lat, lon = 51.5 + np.cumsum(np.r_[0, np.diff(t)]) * 5 / 111_195, np.cumsum(np.r_[0, np.diff(t)]) * 6 / 69_000
    lat[60:100], lon[60:100] = lat[60], lon[60]  # parked: both stay, which is normal
    lat[100:] -= lat[100] - lat[60]
    lat[30] = 0.0
    lat[150:158] = lat[150]
    code = flag_series(t, lat, lon, BUS_LAT)
    assert code[30] == 2 and (code[151:158] == 3).all()
    assert np.count_nonzero(code) == 8


def test_vessel_alternating_is_normal():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.choice([0.0, 0.1], 100), 1), np.round(9 + rng.normal(0, 0.4, 100), 1), np.zeros(50)])
    t = np.arange(len(x)) * 60.0
    assert not flag_series(t, x, None, VESSEL_SOG).any()
    x[150], x[20], x[30] = 45.0, -3.0, 102.3
    assert np.flatnonzero(flag_series(t, x, None, VESSEL_SOG)).tolist() == [20, 30, 150]


def found(spark, data, profile=TIDE_LEVEL):
    df = spark.createDataFrame([(*r, "r", 1) for r in data], "rid long, k string, us long, v double, code string, chunk int")
    return {r.rid: r.reason for r in implausible(df, "rid", F.col("k"), F.col("us"), F.col("v"), profile).collect()}


def test_copies_nulls_and_chunks(spark):
    t, x = tide(3000)
    x[1500] += 4.0
    data = [(n, "g", int(s * 1e6), float(v)) for n, (s, v) in enumerate(zip(t, x))]
    data += [(9001, "g", int(t[1500] * 1e6), float(x[1500])), (9002, "g", None, 5000.0), (9003, None, 1, 0.5), (9004, "g", 5, None), (9005, "h", 1, 1.0)]
    assert found(spark, data) == {1500: "spike", 9001: "spike", 9002: "bounds"}


def test_differing_values_of_one_time(spark):
    rng = np.random.default_rng(5)
    lat = 51.5 + np.cumsum(rng.uniform(0, 200, 300)) / 111_195
    data = [(n, "b", n * 30_000_000, float(v)) for n, v in enumerate(lat)]
    data += [(9001, "b", 100 * 30_000_000, 95.0), (9002, "b", 100 * 30_000_000, 58.0), (9003, "b", 200 * 30_000_000, 45.0), (9004, "b", 210 * 30_000_000, float(lat[210] + 0.0005)), (9005, "b", 100 * 30_000_000, 95.0)]
    assert found(spark, data, BUS_LAT) == {9001: "bounds", 9002: "spike", 9003: "spike", 9005: "bounds"}


def test_empty(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_series(n):
    assert not flag_series(np.arange(n) * 60.0, np.ones(n), None, TIDE_LEVEL).any()


def test_jointly_outside_the_ellipsoid():
    # high water of a gauge with a large range: 0.75 m are less than an axis of steps, but value and both differences together lie outside
    t, x = tide(amp=6.0)
    x[np.argmax(x)] += 0.75
    code = flag_series(t, x, None, TIDE_LEVEL)
    assert np.flatnonzero(code).tolist() == [int(np.argmax(x))] and code.max() == 2
    assert not flag_series(*tide(amp=6.0), None, TIDE_LEVEL).any()
