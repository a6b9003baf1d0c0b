import pytest

from ferrywake.operators.trains import infer_trains

PREDS = "line_id string, line_name string, vehicle_id string, naptan_id string, station_name string, time_to_station int, current_location string, platform_name string, direction string, destination_name string, destination_naptan_id string, towards string, ord long"
BRANCHES = "line_id string, branch_id int, direction string, stops array<struct<id:string,name:string,lon:double,lat:double>>, segments array<array<struct<lon:double,lat:double>>>, run_times array<int>"
A, B, C = ("A", "Alpha", 0.0, 51.5), ("B", "Beta", 0.0145, 51.5), ("C", "Gamma", 0.029, 51.5)


def branch(line, n, way, stops, names=None):
    stops = [(i, (names or {}).get(i, name), x, y) for i, name, x, y in stops]
    return (line, n, way, stops, [[(p[2], p[3]), (q[2], q[3])] for p, q in zip(stops, stops[1:])], None)


def pred(line="victoria", stop="B", tts=60, vid="001", loc=None, way="outbound", **kw):
    return dict(line_id=line, line_name=line, vehicle_id=vid, naptan_id=stop, station_name=stop, time_to_station=tts, current_location=loc, platform_name=None, direction=way, destination_name=kw.get("dest"), destination_naptan_id=None, towards=kw.get("towards"))


CASES = [
    pred(vid="approach", tts=60, loc="Between Alpha and Beta"), pred(vid="platform", tts=5), pred(vid="t20", tts=20), pred(vid="t40", tts=40), pred(vid="t70", tts=70), pred(vid="departed", tts=200, loc="Between Alpha and Beta"),
    pred(vid="held", tts=5), pred(vid="held", stop="C", tts=200), pred(vid="gone", tts=5), pred(vid="gone", stop="C", tts=40), pred(vid="near", tts=70, loc="Approaching Beta"), pred(vid="at", tts=40, loc="At Beta Platform"),
    pred(vid="other", tts=40, loc="At Gamma Platform"), pred(vid="ahead", tts=3600), pred(vid="live", tts=540, loc="Between Alpha and Beta"), pred(vid="000", tts=540), pred(vid="back", tts=40, way="inbound"), pred(vid="first", stop="A", tts=100),
    pred(line="names1", vid="1", tts=40, loc="At King's Cross St. Pancras Platform 3"), pred(line="names2", vid="1", tts=70, loc="Approaching Harrow-on-the-Hill"),
    pred(line="echo", vid=None, tts=60, loc="Between Alpha and Beta"), pred(line="echo", vid=None, stop="C", tts=200, loc="Between Alpha and Beta"), pred(line="owned", vid="77", tts=60, loc="Between Alpha and Beta"), pred(line="owned", vid=None, tts=90, loc="Between Alpha and Beta"),
    pred(line="split", vid=None, tts=60, loc="Beta"), pred(line="split", vid=None, tts=60, loc="Beta", way="inbound"), pred(line="split", vid=None, tts=60, loc="Beta", way=None),
    pred(line="district", vid="42", tts=30), pred(line="circle", vid="42", tts=400), pred(line="bakerloo", vid="42"),
    pred(line="dlr", vid=None, stop="B", tts=50, dest="X"), pred(line="dlr", vid=None, stop="C", tts=300, dest="X"), pred(line="dlr", vid=None, stop="C", tts=60, dest="Y"), pred(line="dlr", vid=None, stop="B", tts=90, dest="Y"),
    pred(line="far", vid=None, tts=540), pred(line="close", vid=None, tts=120), pred(line="sticky", vid="1", tts=60, way=None), pred(line="dest", vid="1", tts=60, way=None, dest="Alpha Underground Station"), pred(line="unknown", vid="1"),
]
LINES = sorted({p["line_id"] for p in CASES} - {"unknown"})
NAMES = {"names1": {"B": "King's Cross St Pancras"}, "names2": {"B": "Harrow on the Hill Underground Station"}}


def rows_of(preds):
    return [tuple({**p, "ord": n}[f.split()[0]] for f in PREDS.split(", ")) for n, p in enumerate(preds)]


@pytest.fixture(scope="module")
def trains(spark):
    branches = [x for line in LINES for x in (branch(line, 0, "outbound", [A, B, C], NAMES.get(line)), branch(line, 1, "inbound", [C, B, A], NAMES.get(line)))]
    prev = spark.createDataFrame([("sticky:1", "sticky:1:inbound:1")], "key string, segment_key string")
    out = infer_trains(spark.createDataFrame(rows_of(CASES), PREDS), spark.createDataFrame(branches, BRANCHES), prev).collect()
    return lambda line: [r for r in out if r.line_id == line]


def test_placement(trains):
    out = {r.vehicle_id: r for r in trains("victoria")}
    assert out["approach"].next_stop_id == "B" and 0 < out["approach"].lon < 0.0145
    assert out["platform"].lon == pytest.approx(0.0145) and out["platform"].segment_frac == 1
    assert out["t20"].lon > out["t40"].lon > out["t70"].lon
    assert out["departed"].lon > 0 and out["departed"].run_time_s > 200
    assert out["held"].next_stop_id == "C" and out["held"].lon == pytest.approx(0.0145)
    assert 0.0145 < out["gone"].lon < 0.029
    assert out["near"].segment_frac >= 0.85 and out["at"].segment_frac == 1 and out["other"].segment_frac < 0.85
    assert "ahead" not in out and "live" in out and "000" not in out and None not in out
    assert out["back"].lon > 0.0145 and out["back"].bearing == pytest.approx(270) and out["t40"].bearing == pytest.approx(90)
    assert out["first"].lon == 0 and out["first"].segment_key == "" and out["t40"].segment_key == "victoria:0:outbound:1"


def test_names_are_compared_loosely(trains):
    assert trains("names1")[0].segment_frac == 1 and trains("names2")[0].segment_frac >= 0.85


def test_echoes_collapse(trains):
    assert [(r.next_stop_id, r.synthetic) for r in trains("echo")] == [("B", True)]
    assert [r.vehicle_id for r in trains("owned")] == ["77"] and len(trains("split")) == 2


def test_shared_stock_and_distinct_lines(trains):
    assert len(trains("district")) == 1 and trains("circle") == [] and len(trains("bakerloo")) == 1


def test_leading_edges(trains):
    assert sorted((r.destination, r.next_stop_id) for r in trains("dlr")) == [("X", "B"), ("Y", "B"), ("Y", "C")]


def test_horizon_and_branches(trains):
    assert trains("far") == [] and len(trains("close")) == 1 and trains("unknown") == []
    assert trains("sticky")[0].segment_key == "sticky:1:inbound:1" and trains("dest")[0].segment_key == "dest:1:inbound:1"
