import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrywake.functions import clock, geo, polyline, text
from ferrywake.operators import latest, leaderboard, lookups, network, quality, rail, routes
from ferrywake.sources import bakes, feeds


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()


def test_emergency_and_ship_classes(spark):
    df = spark.createDataFrame([(1, "g-npas ", None), (2, "G-POLX", None), (3, "G-LAAA", "NPAS1"), (4, None, "HLE21  "), (5, None, "npas-61"), (6, "G-ABCD", "BAW1"), (7, None, None)], "n int, r string, f string")
    assert [r.k for r in df.select("n", text.emergency_kind(F.col("r"), F.col("f")).alias("k")).orderBy("n").collect()] == ["police", "police", "air-ambulance", "air-ambulance", "police", None, None]
    ships = spark.createDataFrame([(k, v) for k, v in enumerate([60, 70, 89, 30, 37, 55, 56, None])], "n int, t int")
    assert [r.c for r in ships.select("n", text.ship_class(F.col("t")).alias("c")).orderBy("n").collect()] == ["pass", "cargo", "tanker", "fish", "pleasure", "special", "other", "other"]


def test_clock(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    keys = one(spark, clock.period_keys(t("2026-07-24 23:30:00")), clock.period_keys(t("2026-07-22 12:00:00")), clock.period_keys(t("2026-03-29 00:30:00")))
    assert [k.bucket for k in keys.c0] == ["2026-07-25", "2026-07-22", "2026-07"] and keys.c1[1].bucket == "2026-07-22" and keys.c2[0].bucket == "2026-03-29"
    now = F.unix_millis(t("2026-07-24 23:30:00"))
    r = one(spark, clock.near_time_ms(F.lit("00:40"), now) - now, clock.near_time_ms(F.lit("23:50"), now) - now, clock.near_time_ms(F.lit("Delayed"), now), clock.near_time_ms(F.lit("7:05"), now) - now, clock.stop_time_ms(F.lit(None), F.lit("Delayed"), F.lit("00:30"), now) - now)
    assert (r.c0, r.c1, r.c2, r.c3, r.c4) == (600_000, -2_400_000, None, (6 * 60 + 35) * 60_000, 0)


def test_scalars(spark):
    r = one(spark, text.half_up(F.lit(-2.5)), text.half_up(F.lit(2.5)), text.due_label(F.lit(44)), text.due_label(F.lit(90)), text.safe_key(F.lit("A:1/b c")), text.direction(F.lit(" 1")), text.dimension(F.lit(0), F.lit(None).cast("int")), text.localized_name(F.lit('[{"text":"Nom","language":"fr"},{"text":" Name ","language":"en"}]')), text.localized_name(F.lit('" "')), text.delayed(F.lit("Delayed")), text.delayed(F.lit("12:30")))
    assert tuple(r) == (-2, 3, "due", "2 min", "A_1_b_c", "outbound", None, "Name", None, True, False)
    props = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("key"), F.lit(v).alias("value")) for c, k, v in (("Facility", "WiFi", "yes"), ("Facility", "Lifts", "3"), ("Facility", "Lifts", "9"), ("Facility", "Toilets", "no"), ("Geo", "Car park", "yes"))])
    assert one(spark, text.facilities(props)).c0 == ["WiFi", "Lifts ×3"]
    stops = F.array(*[F.struct(F.lit(c).alias("crs")) for c in "AABBA"])
    assert [s.crs for s in one(spark, latest.without_repeats(stops, "crs")).c0] == ["A", "B", "A"]
    assert text.valid_lines("b, a,b") == ["a", "b"]
    with pytest.raises(ValueError):
        text.valid_lines("Bad Line!")


def test_disruption_marker(spark):
    m = feeds.disruption_marker
    r = one(spark, m(F.lit("[0.1,51.5]"), F.lit(None).cast("string")), m(F.lit("x"), F.lit('{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2]]]}')), m(F.lit(None).cast("string"), F.lit('{"type":"MultiPolygon","coordinates":[[[[4,4],[6,6]]]]}')), m(F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert tuple(r.c0) == (0.1, 51.5) and tuple(r.c1) == (1, 1) and tuple(r.c2) == (5, 5) and r.c3 is None


def test_polylines():
    line = [(0.0, 51.5), (0.0145, 51.5), (0.0145, 51.509)]
    xy = polyline.to_m(line)
    total = polyline.cumulative(xy)[-1]
    assert polyline.at_fraction(line, 0)[:2] == pytest.approx((0, 51.5)) and polyline.at_fraction(line, 1)[2] == pytest.approx(0)
    assert polyline.fraction_of(line, 0.00725, 51.5001) == pytest.approx(0.5 * 0.0145 * geo.metres_per_lon() / total, abs=1e-6)
    r = polyline.resample(xy, 25)
    assert np.hypot(*np.diff(r, axis=0).T)[:-1].max() <= 25 + 1e-6 and (r[-1] == xy[-1]).all() and len(polyline.resample(xy, 0.01)) == 2500
    part = polyline.between(xy, xy[2], xy[0] + [100, 5])
    assert polyline.cumulative(part)[-1] == pytest.approx(total - 100) and (part[0] == xy[2]).all()
    zig = np.column_stack([np.arange(100.0), np.tile([0, 0.5], 50)])
    assert len(polyline.simplify(zig, 1)) == 2 and len(polyline.simplify(xy, 1)) == 3
    lon, lat = polyline.grid_to_wgs84(651_409.903, 313_177.270)
    assert (float(lon), float(lat)) == pytest.approx((1.716074, 52.658008), abs=1e-4)
    assert polyline.tangent_speed(xy, 0, 8, 3) == pytest.approx(8) and len(polyline.docked(xy, xy[0] - 5, xy[-1] + 5)) > 20
    chains = network.stitch([[(0, 0), (0, 0.01)], [(0, 0.02), (0, 0.01)], [(1, 1), (1, 1.01)]])
    assert sorted(map(len, chains)) == [2, 3]


FIX = "mode string, id string, label string, line_id string, lat double, lon double, t_ms long, tick_ms long, ord long"


def fix(ord, metres, t, id="v", mode="bus", tick=None):
    return (mode, id, f"l{ord}", f"n{ord}", 51.5 + metres / 111_195, 0.0, t * 1000, (t if tick is None else tick) * 1000, ord)


def test_leaderboard_rules(spark):
    rows = [fix(1, 0, 0), fix(2, 100, 15), fix(3, 102, 30), fix(4, 50_000, 45), fix(5, 202, 60), fix(6, 302, 75), fix(7, 402, 400), fix(8, 502, 390), fix(9, 602, 405), fix(10, 0, 0, "w", "ship"), fix(11, 400, 15, "w", "ship"), (None,) * 9]
    judged = leaderboard.outcomes(spark.createDataFrame(rows, FIX), caps=leaderboard.SPEED_CAPS, time_policy="fix")
    assert [r.outcome for r in judged.orderBy("ord").collect()] == ["first", "ok", "jitter", "teleport", "teleport", "ok", "gap", "gap", "ok", "first", "teleport"]
    facts = leaderboard.totals(judged)
    day = {r.id: r for r in leaderboard.ranked(facts).where("period = 'day'").collect()}
    assert day["v"].m == pytest.approx(300, abs=0.1) and day["v"].label == "l9" and day["v"].line_id == "n2" and day["v"].rank == 1 and "w" not in day
    assert {r.period for r in facts.collect()} == {"day", "week", "month"}
    ticks = leaderboard.outcomes(spark.createDataFrame([fix(1, 0, 0, tick=0), fix(2, 640, 80, tick=15)], FIX), caps=40.0)
    assert [r.outcome for r in ticks.orderBy("ord").collect()] == ["first", "teleport"]
    small = leaderboard.outcomes(spark.createDataFrame(rows, FIX), caps=leaderboard.SPEED_CAPS, time_policy="fix", chunk_rows=2)
    assert sorted(map(str, small.collect())) == sorted(map(str, judged.collect()))


def test_latest_and_carried(spark):
    df = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 4, 3, "z"), (None, 9, 4, "n"), ("b", None, 5, "m")], "id string, t int, ord int, v string")
    assert [tuple(r) for r in latest.latest_per_key(df, ["id"], "t", "ord").collect()] == [("a", 5, 1, "x")]
    c = spark.createDataFrame([("a", k, None if k % 5 else float(k)) for k in range(1, 30)], "id string, t long, v double")
    for chunk in (3, 1000):
        out = {r.t: r.v for r in latest.carried_forward(c, "id", "t", ["t"], ["v"], chunk_us=chunk).collect()}
        assert out == {k: (float(k - k % 5) if k >= 5 else None) for k in range(1, 30)}
    ch = spark.createDataFrame([("a", n, v) for n, v in enumerate(["A", "A", "B", "A", None, None])], "id string, n int, v string")
    assert sorted(r.n for r in latest.changed(ch, "id", "n", "v", F.floor(F.col("n") / 2)).collect()) == [0, 2, 3, 4]
    calls = spark.createDataFrame([("k", t) for t in (0, 10, 20, 30, 59, 60, 61, 100)], "k string, t long")
    assert [r.admitted for r in latest.admitted(calls.withColumn("ord", F.col("t")), "k", "t", "ord", 3, 60).orderBy("t").collect()] == [True, True, True, False, False, True, False, True]


def test_journeys_and_learning(spark):
    t = [("k", "v", 0.001 * n, 51.5, 40 * n) for n in range(20)] + [("k", "v", 0.02, 51.5, 19 * 40 + 600), ("k", "v", 0.03, 51.5, 19 * 40 + 1201), ("k", "v", 0.5, 51.5, 40)]
    s = {r.journey: r for r in routes.journey_summary(routes.journeys(spark.createDataFrame(t, "k string, i string, x double, y double, t long"))).collect()}
    assert s[1].n == 21 and s[2].n == 1
    rng = np.random.default_rng(2)
    rows = []
    for j in range(8):
        for n in range(60):
            rows.append(("OP:1:outbound", f"v{j}", 0.001 * n + rng.normal(0, 5e-5), 51.5 + 0.002 * math.sin(n / 10) + rng.normal(0, 5e-5), 10_000 * j + 15 * n))
    rows += [("OP:1:unknown", "z", 0.0, 51.5, 1), ("OP:2:inbound", "q", 0.0, 51.5, 1)]
    prior = spark.createDataFrame([("none", [(0.0, 51.5)], [(0.0, 51.5)])], "key string, poly array<struct<lon:double,lat:double>>, stops array<struct<lon:double,lat:double>>")
    for p in (None, prior):
        out = {r.key: r for r in routes.learn_routes(spark.createDataFrame(rows, "k string, i string, x double, y double, t long"), p).collect()}
        assert out["OP:2:inbound"].outcome == "insufficient" and "OP:1:unknown" not in out
        got = out["OP:1:outbound"]
        assert got.outcome == "learned" and got.journeys == 8 and got.mean_residual_m < 10
        truth = polyline.to_m([(0.001 * n, 51.5 + 0.002 * math.sin(n / 10)) for n in range(60)])
        assert polyline.project(truth, polyline.to_m([(q.lon, q.lat) for q in got.poly]))[2].mean() < 6


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(n)) for n in range(1, 11)], "k string, v double")
    r = df.groupBy("k").agg(routes.floor_quantile(F.collect_list("v"), 0.9).alias("q"), routes.floor_quantile(F.collect_list("v"), 0.5).alias("m")).first()
    assert (r.q, r.m) == (10.0, 6.0)
    s = spark.createDataFrame([("p", x) for x in (0, 5, 60, 90, 2000, 120, 90)], "k string, s long")
    assert network.run_times(s, ["k"], "s").first().run_time_s == 90


def test_rail(spark):
    point = lambda x: {"lon": x, "lat": 51.5}
    seg = lambda a, b, m, x, y: (a, b, m, [point(x), point(y)])
    segments = spark.createDataFrame([seg("A", "B", 1000.0, 0.0, 0.01), seg("C", "B", 1000.0, 0.02, 0.01), seg("A", "C", 5000.0, 0.0, 0.02), seg("C", "KGL", 900.0, 0.02, 0.03), seg("X", "Y", 1.0, 1.0, 1.1)], "a string, b string, len_m double, poly array<struct<lon:double,lat:double>>")
    p = {(r.a, r.b): r for r in rail.rail_paths(spark.createDataFrame([("A", "C"), ("C", "A"), ("A", "X"), ("A", "A")], "a string, b string"), segments).collect()}
    assert p["A", "C"].len_m == 2000 and [q.lon for q in p["A", "C"].poly] == [0.0, 0.01, 0.02] and [q.lon for q in p["C", "A"].poly] == [0.02, 0.01, 0.0] and ("A", "X") not in p and p["A", "A"].poly == []
    comp = {r.node: r.component for r in rail.components(segments, "a", "b").collect()}
    assert comp == {"A": "A", "B": "A", "C": "A", "KGL": "A", "X": "X", "Y": "X"}
    chain = spark.createDataFrame([(n, n + 1) for n in range(60)], "u long, v long")
    assert {r.component for r in rail.components(chain, "u", "v").collect()} == {0}

    now = F.unix_millis(F.lit("2026-01-05 12:00:00").cast("timestamp"))
    stations = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Gamma"), ("KGL", "Kings L")], "crs string, name string")
    sch = "crs string, ord long, service struct<rid:string,std:string,etd:string,operator:string,destination:string,cancelled:boolean,calling_points:array<struct<crs:string,name:string,st:string,et:string,at:string>>>"
    cp = lambda c, st, et=None, at=None: (c, c.lower(), st, et, at)
    boards = [
        ("A", 1, ("r1", "11:50", "Delayed", "Southern", "Gamma", False, [cp("B", "12:10"), cp("B", "12:11"), cp("ZZZ", "12:12"), cp("C", "12:30")])), ("A", 2, ("r1", "11:59", None, "Southern", "Gamma", False, [cp("B", "12:20")])), ("A", 3, ("r2", "11:50", "Cancelled", "X", "G", False, [cp("B", "12:10")])),
        ("A", 4, ("r3", "11:50", None, "", "G", True, [cp("B", "12:10")])), ("C", 5, ("r4", "11:40", None, "c2c", "Milton", False, [cp("MKC", "12:20", "On time")])), ("Q", 6, ("r5", "11:00", None, "c2c", "B", False, [cp("A", "11:10"), cp("B", "11:40")])),
    ]
    t = rail.merged(rail.services(spark.createDataFrame(boards, sch), stations, now))
    got = {r.rid: r for r in t.collect()}
    assert [s.crs for s in got["r1"].stops] == ["A", "B", "C"] and got["r1"].operator == "SN" and [s.crs for s in got["r4"].stops] == ["C", "KGL"] and set(got) == {"r1", "r4", "r5"}
    assert {r.rid for r in rail.running(t, now).collect()} == {"r1", "r4"}
    at = {r.rid: r for r in rail.positions(t, segments, now).collect()}
    assert at["r1"].frac == pytest.approx(0.5) and at["r1"].lon == pytest.approx(0.005) and at["r4"].lon == pytest.approx(0.025)


def test_lookups(spark):
    now = F.lit(10_000_000)
    status = spark.createDataFrame([("a", 3, 4, True, True, 9_000_000), ("b", 1, 1, True, True, 1), ("c", None, None, None, None, None), ("zz", 1, 1, True, True, None)], "station_id string, bikes int, docks int, is_renting boolean, is_installed boolean, reported_ms long")
    info = spark.createDataFrame([(k, k.upper(), 0.0, 51.5, 9) for k in "abc"], "station_id string, name string, lon double, lat double, capacity int")
    assert {r.station_id: (r.bikes, r.renting) for r in lookups.bike_status(status, info, now).collect()} == {"a": (3, True), "b": (1, False), "c": (0, True)}
    st = spark.createDataFrame([("940A", "Wembley Park"), ("940B", "Acton"), ("940C", "Kew")], "naptan string, name string")
    en = spark.createDataFrame([(2, "", None, "WEMBLEY PARK STATION: lift out"), (1, "940A1", "x", "by id"), (3, "", "Acton Town", "acton"), (4, "", None, None)], "ord int, uid string, stop_name string, message string")
    assert {r.naptan: r.message for r in lookups.lift_disruption(st, en).collect()} == {"940A": "by id", "940B": "acton"}
    ds = spark.createDataFrame([("l", 1, "Severe", "A"), ("l", 2, "Severe", "A"), ("l", 3, "Good Service", None), ("l", 4, "Minor", "B")], "line string, ord int, description string, reason string")
    r = lookups.disruption_text(ds, "line").first()
    assert r.description == "Severe, Minor" and r.reasons == ["A", "B"]


def test_quality_and_network(spark):
    polls = spark.createDataFrame([("t", 0, "A", 100), ("t", 10, "A", 120), ("t", 20, "A", 10), ("t", 30, "A", 5), ("t", 40, "B", 200)], "k string, t int, stop string, tts int")
    r = quality.countdown_regressions(polls, ["k"], "t", "stop", "tts", F.lit(0)).first()
    assert (r.regressions, r.stuck_due, r.n) == (1, 1, 5)
    seen = spark.createDataFrame([("a", n) for n in (1, 2, 5)] + [("b", n) for n in range(1, 7)], "k string, n int")
    assert {r.k: (r.gaps, r.longest) for r in quality.presence_gaps(seen, ["k"], "n", F.lit(0)).collect()} == {"a": (1, 2), "b": (0, 0)}
    files = spark.createDataFrame([("2026-01-01", 5), ("2026-01-08", 6), ("2026-01-09", 6), ("2026-01-10", 5)], "day string, bytes long")
    assert sorted(r.day for r in quality.expired_partitions(files, "day", "bytes", F.lit("2026-01-10"), 7, 12).collect()) == ["2026-01-01", "2026-01-08"]
    stations = spark.createDataFrame([(1, 51.5, 0.0, 1), (2, 51.5, 0.0001, 2), (3, 51.5, 0.0002, 3)], "sid int, lat double, lon double, ord int")
    nodes = spark.createDataFrame([("n1", 51.5, 0.00009), ("n2", 51.5, 0.0005)], "nid string, lat double, lon double")
    assert {r.sid: r.nid for r in network.assign_distinct(stations, nodes, 500).collect()} == {1: "n1", 2: "n2"}


SIRI = "<Siri><VehicleActivity><RecordedAtTime>{t}</RecordedAtTime><LineRef>L</LineRef>{extra}<OperatorRef>OP</OperatorRef><DirectionRef>2</DirectionRef><DestinationName>High_St &amp; Park</DestinationName><VehicleLocation><Longitude>{x}</Longitude><Latitude>51.5</Latitude></VehicleLocation><VehicleRef>{v}</VehicleRef></VehicleActivity></Siri>"


def test_feeds(spark, tmp_path):
    doc = lambda t="2026-01-05T11:58:00Z", x="0.1", v="7", extra="": SIRI.format(t=t, x=x, v=v, extra=extra)
    df = spark.createDataFrame([(doc() + doc(extra="<PublishedLineName>12</PublishedLineName>", v="8"),), (doc(t="2026-01-05T11:00:00Z"),), (doc(x="abc"),), (doc(v=" "),), (None,)], "d string")
    out = {r.id: r for r in feeds.bus_activities(df, "d", F.lit("2026-01-05 12:00:00").cast("timestamp")).collect()}
    assert set(out) == {"OP:7", "OP:8"} and out["OP:7"].line == "L" and out["OP:8"].line == "12" and out["OP:7"].dest == "High St & Park" and out["OP:7"].direction == "inbound" and out["OP:7"].bearing is None
    g = spark.createDataFrame([('{"data":{"feeds":[{"name":"a","url":"1"}]}}', '{"data":{"stations":[{"station_id":"s","name":[{"text":"N","language":"en"}],"lon":0.1,"lat":51.5,"capacity":5},{"station_id":"t","name":"T","lon":9.0,"lat":51.5},{"name":"x"}]}}', '{"data":{"stations":[{"station_id":"s","num_vehicles_available":2,"num_docks_available":1,"is_renting":true,"last_reported":"2026-01-05T11:00:00Z"},{"station_id":"t","num_bikes_available":4,"last_reported":1700000000}]}}')], "a string, b string, c string")
    assert {r.name: r.url for r in feeds.bike_feeds(g, "a").collect()} == {"a": "1"}
    old = spark.createDataFrame([('{"data":{"en":{"feeds":[{"name":"b","url":"2"}]}}}',)], "a string")
    assert {r.name: r.url for r in feeds.bike_feeds(old, "a").collect()} == {"b": "2"}
    assert [(r.station_id, r.name, r.capacity) for r in feeds.bike_info(g, "b", geo.Box(-1, 51, 1, 52)).collect()] == [("s", "N", 5)]
    rep = {r.station_id: r for r in feeds.bike_reports(g, "c").collect()}
    assert rep["s"].bikes == 2 and rep["s"].reported_ms is not None and rep["t"].bikes == 4 and rep["t"].reported_ms is None
    d = tmp_path / "traces" / "dt=2026-01-04"
    d.mkdir(parents=True)
    (d / "a.json").write_text('{"k":"A:1:o","i":"A:v","x":0.1,"y":51.5,"t":1}\n{"k":"A:1\n')
    old_day = tmp_path / "traces" / "dt=2025-12-01"
    old_day.mkdir()
    (old_day / "a.json").write_text('{"k":"old","i":"A:v","x":0.1,"y":51.5,"t":1}\n')
    assert [r.k for r in feeds.traces(spark, str(tmp_path / "traces"), "2026-01-05").collect()] == ["A:1:o"]
    stations = spark.createDataFrame([("g", "G", 51.5, 0.1, [("m1", 300), ("m2", 900)]), ("DIFF1", "D", 51.5, 0.1, [("m1", 900)]), ("far", "F", 10.0, 0.1, [("m2", 900)])], "ref string, label string, lat double, lon double, measures array<struct<id:string,period:int>>")
    readings = spark.createDataFrame([("m1", 1.0, "2026"), ("m2", 2.0, "2026"), ("m3", None, "x")], "measure string, value double, date_time string")
    assert [(r.ref, r.level_m) for r in feeds.tide_gauges(stations, readings, geo.Box(-1, 51, 1, 52)).collect()] == [("g", 2.0)]


def test_timetables_and_region(spark, tmp_path):
    xml = """<T xmlns="http://x"><AnnotatedStopPointRef><StopPointRef>s1</StopPointRef><Location><Longitude>0.1</Longitude><Latitude>51.5</Latitude></Location></AnnotatedStopPointRef>
<AnnotatedStopPointRef><StopPointRef>s2</StopPointRef><Location><Easting>530000</Easting><Northing>180000</Northing></Location></AnnotatedStopPointRef>
<RouteSection id="rs"><RouteLink id="rl"><From><StopPointRef>s1</StopPointRef></From><To><StopPointRef>s2</StopPointRef></To></RouteLink></RouteSection><Route id="r"><RouteSectionRef>rs</RouteSectionRef></Route>
<NationalOperatorCode>OP</NationalOperatorCode><Line id="l"><LineName>7</LineName></Line><JourneyPattern id="j"><Direction>inbound</Direction><RouteRef>r</RouteRef></JourneyPattern></T>"""
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.xml", xml)
        z.writestr("broken.xml", "<a")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(inner, "inner.zip")
    inner.unlink()
    r = bakes.timetables(spark, str(tmp_path)).collect()
    assert [(x.key, len(x.poly), len(x.stops)) for x in r] == [("OP:7:inbound", 2, 2)]
    assert bakes.load_region({}).box == geo.Box(-0.55, 51.25, 0.35, 51.72) and bakes.load_region({"REGION_BBOX": "1,2,3,4"}).centre == (2, 3)
    for bad in ("1,2,3", "a,b,c,d", "3,2,1,4", "-200,0,0,1"):
        with pytest.raises(ValueError, match="REGION_BBOX"):
            bakes.load_region({"REGION_BBOX": bad})
    assert bakes.parse_flag("Yes", "X") and not bakes.parse_flag(" ", "X") and bakes.parse_env("# c\nA='b'\nexport C=d\n") == {"A": "b", "C": "d"}
    with pytest.raises(ValueError):
        bakes.parse_flag("maybe", "X")
    b = geo.Box(-179, -89, 179, 89).widened(5)
    assert b == geo.Box(-180, -90, 180, 90)


def test_stitching():
    a, b, c = [(0.0, 51.5), (0.01, 51.5)], [(0.02, 51.5), (0.01, 51.5)], [(0.5, 51.5), (0.51, 51.5)]
    assert network.ordered_stitch([a, b, c]) == [[(0.0, 51.5), (0.01, 51.5), (0.02, 51.5)], c]
    assert network.ordered_stitch([a[::-1], b]) == [[(0.0, 51.5), (0.01, 51.5), (0.02, 51.5)]] and network.ordered_stitch([]) == []
    lines = network.chains_of([("A", "B", [(0, 0), (1, 0)]), ("C", "B", [(2, 0), (1, 0)]), ("C", "D", [(2, 0), (2, 1)]), ("C", "E", [(2, 0), (3, 0)])])
    assert sorted(map(len, lines)) == [2, 2, 3] and [(0, 0), (1, 0), (2, 0)] in [sorted(x) for x in lines]
    ring = network.chains_of([("A", "B", [(0, 0), (1, 0)]), ("B", "C", [(1, 0), (1, 1)]), ("C", "A", [(1, 1), (0, 0)])])
    assert len(ring) == 1 and len(ring[0]) == 4


def test_read_api_refuses(spark):
    from ferrywake.plans import read_api

    rows = spark.createDataFrame([("a", 1)], "line_id string, ord long")
    for call in (lambda: read_api.arrivals(rows, "A,,b"), lambda: read_api.stop_arrivals(rows, "x!"), lambda: read_api.board(rows, "year", "2026", "bus"), lambda: read_api.board(rows, "day", "2026-01-01", "plane")):
        with pytest.raises(ValueError):
            call()


def test_station_list_of_both_kinds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("crs,name,lat,lon\nABC,Abc,51.5,0.1\n,None,1,1\nXYZ,Xyz,,0.1\n")
    (tmp_path / "s.json").write_text('[{"crs":"ABC","name":"Abc","lat":51.5,"lon":0.1},{"crs":null,"lat":1,"lon":1}]')
    assert [tuple(r) for r in feeds.station_list(spark, str(tmp_path / "s.csv")).collect()] == [tuple(r) for r in feeds.station_list(spark, str(tmp_path / "s.json")).collect()] == [("ABC", "Abc", 51.5, 0.1)]
