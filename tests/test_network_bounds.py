import pytest

from ferrywake.operators.network import station_neighbours


def test_too_many_zone_nodes_raise(spark):
    segments = spark.createDataFrame([("n1", "n2", 10.0)], "a string, b string, len_m double")
    zone = spark.createDataFrame([("n1", "A", 51.5, 0.0), ("n2", "B", 51.5, 0.0)], "nid string, sid string, lat double, lon double")
    with pytest.raises(ValueError, match="zones"):
        station_neighbours(segments, zone, most_segments=1)
