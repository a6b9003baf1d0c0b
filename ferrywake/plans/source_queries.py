"""Queries of sources, sinks and streams: tables are written as a feed would send them, read by the readers and compared with the tables."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrywake.functions.geo import Box
from ferrywake.operators import leaderboard, lookups, quality
from ferrywake.plans.reference_queries import GAP_MS, _EVENT_SQL, _TOTALS_SQL, query, r6
from ferrywake.plans.fixes import fixes
from ferrywake.session import materialize, shared_folder, table
from ferrywake.sources import bakes, feeds
from ferrywake.streaming import live


def captured(spark: SparkSession, texts: DataFrame, suffix: str = "") -> str:
    """Write a text column as captured payloads into the shared folder; returns their path."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}{suffix}"
    texts.write.text(path)
    return path


def document(df: DataFrame, *columns, wrap: str = "%s") -> DataFrame:
    """Rows as one JSON document: an array of objects inside ``wrap``. For catalogues."""
    rows = df.select(F.struct(*columns).alias("r")).agg(F.to_json(F.collect_list("r")).alias("j"))
    return rows.select(F.format_string(wrap, "j").alias("value"))


# ---- sources -----------------------------------------------------------------------------------------------------------

@query("""select operator || ':' || split_part(id, ':', 2) as id, line, operator, case lower(trim(direction)) when '1' then 'outbound' when '2' then 'inbound' else lower(trim(direction)) end as direction, round(lat, 6) as lat, round(lon, 6) as lon, round(bearing, 3) as bearing, epoch_us(recorded_at) as us
from bus_fixes where id is not null and operator is not null and trim(line) <> '' and trim(direction) <> '' and lat is not null and lon is not null and recorded_at is not null and timestamp '2027-01-01' - recorded_at <= interval 20000 day""")
def bus_documents(spark, d):
    b = table(spark, d, "bus_fixes").where("id is not null and operator is not null and trim(line) <> '' and trim(direction) <> ''")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f"<s:{n}>"), c, F.lit(f"</s:{n}>")), F.lit(""))
    one = F.concat(
        F.lit("<VehicleActivity>"), tag("RecordedAtTime", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), tag("PublishedLineName", esc(F.col("line"))), tag("OperatorRef", esc(F.col("operator"))), tag("DirectionRef", F.col("direction")),
        tag("VehicleRef", esc(F.split_part("id", F.lit(":"), F.lit(2)))), tag("Longitude", F.col("lon").cast("string")), tag("Latitude", F.col("lat").cast("string")), tag("Bearing", F.col("bearing").cast("string")), F.lit("</VehicleActivity>"),
    )
    docs = b.groupBy((F.col("fix_id") % 50).alias("k")).agg(F.concat(F.lit("<Siri>\n"), F.array_join(F.collect_list(one), "\n"), F.lit("</Siri>")).alias("value")).drop("k")
    out = feeds.bus_activities(docs, "value", F.lit("2027-01-01").cast("timestamp"), ttl_s=20_000 * 86_400)
    trimmed = F.trim("line")
    return out.select("id", F.when(trimmed == F.col("line"), F.col("line")).otherwise(trimmed).alias("line"), "operator", "direction", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("bearing", 3).alias("bearing"), F.unix_micros("recorded_at").alias("us"))


@query("""select mmsi, nullif(trim(name), '') as name, lat, lon, sog, cog, ship_type, nullif(trim(destination), '') as destination, nullif(coalesce(cast(floor(length_m) as integer), 0) + 3, 0) as length_m, nullif(draught_m, 0) as draught_m, last_seen
from vessels where lat is not null and lon is not null""")
def vessel_feed(spark, d):
    v = table(spark, d, "vessels")
    position = F.struct(F.col("sog").alias("Sog"), F.col("cog").alias("Cog"))
    size = F.struct(F.floor("length_m").cast("int").alias("A"), F.lit(3).alias("B"))
    static = F.struct(F.col("ship_type").alias("Type"), F.col("destination").alias("Destination"), F.col("draught_m").alias("MaximumStaticDraught"), size.alias("Dimension"))
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.col("name").alias("ShipName"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    lines = v.select(F.to_json(F.struct(meta.alias("MetaData"), F.struct(position.alias("PositionReport"), static.alias("ShipStaticData")).alias("Message"), F.col("last_seen").alias("received_ms"))).alias("value"))
    torn = spark.createDataFrame([('{"MetaData":{"MMSI":1,"lat',)], "value string")
    return feeds.vessel_messages(spark, captured(spark, lines.unionByName(torn))).drop("width_m")


@query("select 'C' || c_custkey % 25 as crs, o_orderkey::varchar as rid, o_orderkey % 7 = 0 or o_orderkey % 5 = 0 as cancelled, case when o_orderkey % 3 = 0 then 0 else 1 end as points from orders join customer on o_custkey = c_custkey where o_orderkey % 400 = 0".replace(" where o_orderkey % 400 = 0", " where o_orderdate < timestamp '1995-02-01'"))
def departure_feed(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < timestamp '1995-02-01'")
    k = F.col("o_orderkey")
    point = lambda cancelled: F.struct(F.lit("ABC").alias("crs"), F.lit("Abc").alias("name"), F.lit("10:00").alias("st"), F.lit(None).cast("string").alias("et"), F.lit(None).cast("string").alias("at"), cancelled.alias("isCancelled"))
    lists = F.array(F.array(point(k % 3 == 0)), F.array(point(F.lit(False)), point(F.lit(False))))
    service = F.struct(k.cast("string").alias("rid"), F.lit("09:00").alias("std"), F.when(k % 5 == 0, "Cancelled").otherwise("On time").alias("etd"), (k % 7 == 0).alias("isCancelled"), lists.alias("callingPointLists"))
    boards = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey") % 25).alias("crs")).agg(F.collect_list(service).alias("services"))
    out = feeds.departure_boards(spark, captured(spark, document(boards, "crs", "services")))
    return out.select("crs", "service.rid", "service.cancelled", F.size("service.calling_points").alias("points"))


_BIKES = "b as (select i, min(x) as x, min(y) as y, coalesce(min(b), 0) as b, coalesce(min(d), 0) as d, min(c) as c, min(r) as r from bike_stations where i is not null and x between -180 and 180 and y between -90 and 90 group by i)"


def _bikes(spark, d):
    least = lambda c: F.min(c).alias(c)
    return table(spark, d, "bike_stations").where("i is not null and x between -180 and 180 and y between -90 and 90").groupBy("i").agg(*[least(c) for c in "xybdcr"])


@query(f"with {_BIKES} select i as station_id, 'Dock ' || i as name, round(x, 7) as lon, round(y, 7) as lat, c as capacity, b as bikes, d as docks, coalesce(r, 1) <> 0 and length(i) % 3 <> 0 as renting from b")
def status_info_join(spark, d):
    """Bike status with its catalogue entry, from documents of both kinds; unknown and stale stations."""
    b = _bikes(spark, d)
    name = F.when(F.length("i") % 2 == 0, F.concat(F.lit('[{"text":"Dock '), "i", F.lit('","language":"en"}]'))).otherwise(F.concat(F.lit("Dock "), "i"))
    info = feeds.bike_info(document(b, F.col("i").alias("station_id"), name.alias("name"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("c").alias("capacity"), wrap='{"data":{"stations":%s}}'), "value")
    reported = F.when(F.length("i") % 3 == 0, "2026-01-01T00:00:00Z").when(F.length("i") % 3 == 1, "2026-01-01T05:45:00Z").otherwise("1767225600")
    known = F.struct(F.col("i").alias("station_id"), F.col("b").alias("num_bikes_available"), F.col("d").alias("num_docks_available"), (F.col("r") != 0).alias("is_renting"), F.lit(True).alias("is_installed"), reported.alias("last_reported"))
    stray = spark.createDataFrame([("nowhere", 1, 1, 1.0, 1.0, 1, 1)], "i string, b int, d int, x double, y double, c int, r int").select(*b.columns)
    status = feeds.bike_reports(document(b.unionByName(stray), *[known[c].alias(c) for c in ("station_id", "num_bikes_available", "num_docks_available", "is_renting", "is_installed", "last_reported")], wrap='{"data":{"stations":%s}}'), "value")
    out = lookups.bike_status(status, info, F.unix_millis(F.lit("2026-01-01 06:00:00").cast("timestamp")))
    return out.withColumn("lon", F.round("lon", 7)).withColumn("lat", F.round("lat", 7))


@query("select * from (values ('a', 'u1'), ('b', 'u2'), ('c', 'u5')) as t(name, url)")
def bike_discovery(spark, d):
    docs = spark.createDataFrame([('{"data":{"feeds":[{"name":"a","url":"u1"},{"name":"b","url":"u2"},{"name":"a","url":"u3"}]}}',), ('{"data":{"en":{"feeds":[{"name":"c","url":"u5"},{"name":null,"url":"x"}]}}}',), ("{}",)], "doc string")
    return feeds.bike_feeds(docs, "doc")


@query("""with g as (select ref, min(label) as label, min(lat) as lat, min(lon) as lon from tide_readings where ref is not null and lat is not null and lon is not null group by ref),
r as (select ref, arg_min(level_m, reading_id) as v, min(reading_id) as n from tide_readings where ref is not null and level_m is not null group by ref)
select g.ref, label, round(lat, 6) as lat, round(lon, 6) as lon, round(v + case when length(label) % 2 = 0 then 2 else 1 end, 4) as level_m from g join r using (ref) where lon between -1 and 1 and lat between 51 and 52""")
def gauge_feed(spark, d):
    """Each gauge has two series; that of 15 minutes is preferred where there is one."""
    t = table(spark, d, "tide_readings").where("ref is not null")
    g = t.where("lat is not null and lon is not null").groupBy("ref").agg(F.min("label").alias("label"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    measure = lambda n, p: F.struct(F.concat("ref", F.lit(f"-{n}")).alias("id"), p.alias("period"))
    stations = g.select("ref", "label", "lat", "lon", F.array(measure(1, F.lit(3600)), measure(2, F.when(F.length("label") % 2 == 0, 900).otherwise(1800))).alias("measures"))
    latest = t.where("level_m is not null").groupBy("ref").agg(F.min_by("level_m", "reading_id").alias("v"))
    readings = latest.select(F.explode(F.array(*[F.struct(F.concat("ref", F.lit(f"-{n}")).alias("measure"), (F.col("v") + n).alias("value"), F.lit("2026-01-01T00:00:00Z").alias("date_time")) for n in (1, 2)])).alias("r")).select("r.*")
    return feeds.tide_gauges(stations, readings, Box(-1.0, 51.0, 1.0, 52.0)).select("ref", "label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("level_m", 4).alias("level_m"))


@query("select event_id * 1000000 as ord, 'L' || user_id % 3 as line_id, 'S' || user_id % 24 as naptan_id, event_id as time_to_station, case when event_id % 2 = 0 then 'v' || user_id end as vehicle_id from events where event_id % 10 <> 0")
def arrival_feed(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id").cast("int")
    rows = e.select("event_id", F.to_json(F.array(F.struct(F.when(n % 10 != 0, F.concat(F.lit("S"), F.col("user_id") % 24)).alias("naptanId"), F.concat(F.lit("L"), F.col("user_id") % 3).alias("lineId"), n.alias("timeToStation"), F.when(n % 2 == 0, F.concat(F.lit("v"), "user_id")).alias("vehicleId"), F.lit(1).alias("unknown")))).alias("j"))
    return feeds.arrivals(rows, "j", "event_id").select("ord", "line_id", "naptan_id", "time_to_station", "vehicle_id")


@query("""select * from (values ('status', 'central', 'Minor Delays, Part Closure', 'Signal'), ('status', 'victoria', '', ''), ('stop', '940A', 'Bank', 'Toilets'), ('stop', '940B', 'Monument', ''), ('crowd', '940A', '55', ''), ('crowd', '940B', null, ''), ('lift', '940A', 'Lift out', '')) as t(kind, id, a, b)""")
def station_feeds(spark, d):
    doc = lambda t: spark.createDataFrame([(t,)], "j string")
    lines = feeds.line_statuses(doc('[{"id":"central","lineStatuses":[{"statusSeverityDescription":"Minor Delays","reason":"Signal"},{"statusSeverityDescription":"Part Closure"},{"statusSeverityDescription":"Minor Delays","reason":"Signal"}]},{"id":"victoria","lineStatuses":[{"statusSeverityDescription":"Good Service"}]}]'), "j")
    status = lookups.disruption_text(lines, "line").select(F.lit("status").alias("kind"), F.col("line").alias("id"), F.col("description").alias("a"), F.array_join("reasons", ",").alias("b"))
    stops = feeds.stop_details(doc('[{"naptanId":"940A","commonName":"Bank Underground Station","lat":51.5,"lon":-0.1,"additionalProperties":[{"category":"Facility","key":"Toilets","value":"yes"}]},{"naptanId":"940B","commonName":"Monument"},{"commonName":"No id"}]'), "j")
    stop = stops.select(F.lit("stop").alias("kind"), F.col("naptan").alias("id"), F.col("name").alias("a"), F.coalesce(F.array_join("facilities", ","), F.lit("")).alias("b"))
    crowd = feeds.crowding(spark.createDataFrame([("940A", '{"dataAvailable":true,"percentageOfBaseline":0.545}'), ("940B", '{"dataAvailable":false,"percentageOfBaseline":0.1}')], "naptan string, j string"), "naptan", "j")
    crowd = crowd.select(F.lit("crowd").alias("kind"), F.col("naptan").alias("id"), F.col("percent").cast("string").alias("a"), F.lit("").alias("b"))
    lifts = lookups.lift_disruption(stops, feeds.lift_messages(doc('[{"stationUniqueId":"","stopPointName":null,"message":""},{"stationUniqueId":"940A","stopPointName":"Bank","message":"Lift out"}]'), "j"))
    return status.unionByName(stop).unionByName(crowd).unionByName(lifts.select(F.lit("lift").alias("kind"), F.col("naptan").alias("id"), F.col("message").alias("a"), F.lit("").alias("b")))


@query("select report_id::varchar as hex, round(lat, 6) as lat from vessels where lat is not null and lon is not null and report_id % 3 <> 0")
def aircraft_feed(spark, d):
    v = table(spark, d, "vessels").select(F.col("report_id").cast("string").alias("hex"), "lat", "lon", F.when(F.col("report_id") % 3 == 0, "C2").when(F.col("report_id") % 3 == 1, "A3").alias("category"))
    good = captured(spark, document(v, "hex", "lat", "lon", "category", wrap='{"ac":%s}'))
    return feeds.aircraft(spark, ["/nonexistent/feed", good]).select("hex", F.round("lat", 6).alias("lat"))


_DAY = "strftime(recorded_at, '%Y-%m-%d')"


@query(f"select operator || ':' || line || ':' || direction as k, id as i, round(lon, 7) as x, cast(floor(epoch(recorded_at)) as bigint) as t from bus_fixes where operator is not null and trim(line) <> '' and direction is not null and id is not null and lat is not null and lon is not null and recorded_at is not null and {_DAY} >= strftime((select cast(max(recorded_at) as date) from bus_fixes) - 3, '%Y-%m-%d')")
def trace_files(spark, d):
    """Trace lines by day: partitions older than three days are pruned, torn lines dropped."""
    b = table(spark, d, "bus_fixes").where("trim(line) <> '' and recorded_at is not null and operator is not null and direction is not null")
    rows = live.trace_lines(b).withColumn("dt", F.to_date(F.timestamp_seconds("t")))
    path = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    lines = rows.select("dt", F.to_json(F.struct("k", "i", "x", "y", "t")).alias("value"))
    torn = rows.select("dt").distinct().withColumn("value", F.lit('{"k":"a","i'))
    lines.unionByName(torn).write.partitionBy("dt").text(path)
    last = rows.agg(F.max("dt")).first()[0]
    return feeds.traces(spark, path, str(last)).select("k", "i", F.round("x", 7).alias("x"), "t")


@query("""select 'station' as kind, crs as id, n as value from (select crs, count(*) as n from stations where crs is not null and lat is not null and lon is not null group by crs)
union all select 'line', 'L' || n_nationkey, n_regionkey from nation union all select 'point', 'P' || n_nationkey, n_nationkey from nation union all select 'branch', 'L' || n_nationkey, 2 from nation union all select 'segment', 'N' || n_nationkey, 100 + n_nationkey from nation
union all select 'node', n_nationkey::varchar, n_nationkey from nation union all select 'way', n_nationkey::varchar, 2 from nation""")
def baked_files(spark, d):
    n = table(spark, d, "nation")
    k, text_ = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    line, pair = F.concat(F.lit("L"), "n_nationkey"), lambda c: F.array((c * 0.01), F.lit(51.5))
    manifest = bakes.manifest(spark, captured(spark, document(n, line.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("color"), wrap='{"lines":%s}')))
    stop = lambda c: F.struct(F.concat(F.lit("S"), c).alias("id"), F.lit("s").alias("name"), (c * 0.01).alias("lon"), F.lit(51.5).alias("lat"))
    branch = F.struct(F.lit(0).alias("branchId"), F.lit("outbound").alias("direction"), F.array(stop(k), stop(k + 1)).alias("stops"), F.array(F.array(pair(k), pair(k + 1))).alias("segments"))
    branches = bakes.branches(spark, captured(spark, document(n, line.alias("lineId"), F.array(branch).alias("branches"))))
    points = bakes.point_features(spark, captured(spark, document(n, F.struct(pair(k).alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit("P"), "n_nationkey").alias("id"), line.alias("lineId")).alias("properties"), wrap='{"features":%s}')))
    segments = document(n, F.concat(F.lit("N"), "n_nationkey").alias("a"), F.lit("X").alias("b"), (k + 100.0).alias("lenM"), F.array(pair(k), pair(k + 1)).alias("poly"))
    s = table(spark, d, "stations")
    listed = s.select("crs", "name", "lat", "lon")
    csv = f"{shared_folder(spark)}/stations-{uuid.uuid4().hex}.csv"
    listed.write.option("header", True).csv(csv)
    _, seg = bakes.rail_tables(spark, captured(spark, document(s, "crs", "name", "lat", "lon")), captured(spark, segments))
    element = F.array(F.struct(F.lit("node").alias("type"), k.alias("id"), (k * 1.0).alias("lat"), (k * 1.0).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes")), F.struct(F.lit("way").alias("type"), k.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(k.cast("long"), (k + 1).cast("long")).alias("nodes")))
    # a second file repeats every element with other values; the last counts
    osm = n.select(F.explode(element).alias("e")).select("e.*")
    folder = f"{shared_folder(spark)}/osm-{uuid.uuid4().hex}"
    old = osm.withColumn("lat", F.lit(-1.0)).withColumn("nodes", F.array(F.lit(1).cast("long")))
    for name, part in (("a", old), ("b", osm)):
        document(part, *part.columns, wrap='{"elements":%s}').write.text(f"{folder}/{name}")
    nodes, ways, _ = feeds.osm_elements(spark, f"{folder}/*")
    row = lambda df, kind, i, v: df.select(F.lit(kind).alias("kind"), i.alias("id"), v.cast("long").alias("value"))
    parts = [
        row(feeds.station_list(spark, csv).groupBy("crs").count(), "station", F.col("crs"), F.col("count")), row(manifest, "line", F.col("id"), F.col("color")), row(points, "point", F.col("id"), F.round(F.col("lon") * 100)),
        row(branches, "branch", F.col("line_id"), F.size("stops")), row(seg, "segment", F.col("a"), F.col("len_m")), row(nodes, "node", F.col("id").cast("string"), F.col("lat")), row(ways, "way", F.col("id").cast("string"), F.size("nodes")),
    ]
    return bakes.all_features(parts)


@query("select 'L' || n_nationkey as line_id, 2 as points, 3 as stops from nation")
def route_documents(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    string = F.format_string("[[[%d.5,51.5],[%d.75,51.6]]]", k, k)
    stop = lambda i: F.struct(F.concat(F.lit(f"S{i}-"), k).alias("id"), F.lit("x").alias("name"), F.lit(51.5).alias("lat"), F.lit(0.1).alias("lon"))
    doc = document(n, F.concat(F.lit("L"), k).alias("lineId"), F.lit("outbound").alias("direction"), F.array(string).alias("lineStrings"), F.array(F.struct(F.lit(0).alias("branchId"), F.array(stop(0), stop(1), stop(2)).alias("stopPoint"))).alias("stopPointSequences"))
    lines, stops = feeds.route_sequences(spark, captured(spark, doc))
    return lines.select("line_id", F.size("poly").alias("points")).join(stops.groupBy("line_id").agg(F.count("*").cast("int").alias("stops")), "line_id")


@query("select * from (values ('https://t', 1700000600, '/v2/b')) as t(host, time, path)")
def radar_frames(spark, d):
    docs = spark.createDataFrame([('{"host":"https://t","radar":{"past":[{"time":1700000000,"path":"/v2/a"},{"time":1700000600,"path":"/v2/b"}]}}',), ('{"host":"x","radar":{"past":[]}}',)], "j string")
    return feeds.radar_frame(docs, "j")


_TXC = """<TransXChange xmlns="http://www.transxchange.org.uk/"><StopPoints><AnnotatedStopPointRef><StopPointRef>A</StopPointRef><Location><Longitude>0.0</Longitude><Latitude>51.5</Latitude></Location></AnnotatedStopPointRef>
<AnnotatedStopPointRef><StopPointRef>B</StopPointRef><Location><Longitude>%s</Longitude><Latitude>51.5</Latitude></Location></AnnotatedStopPointRef></StopPoints>
<RouteSections><RouteSection id="RS"><RouteLink id="RL"><From><StopPointRef>A</StopPointRef></From><To><StopPointRef>B</StopPointRef></To></RouteLink></RouteSection></RouteSections><Routes><Route id="R"><RouteSectionRef>RS</RouteSectionRef></Route></Routes>
<Operators><Operator><NationalOperatorCode>OPER</NationalOperatorCode></Operator></Operators><Services><Service><Lines><Line id="l"><LineName>12</LineName></Line></Lines><StandardService><JourneyPattern id="J"><Direction>inbound</Direction><RouteRef>R</RouteRef></JourneyPattern></StandardService></Service></Services></TransXChange>"""


@query("select * from (values ('OPER:12:inbound', 2, 0.2)) as t(key, points, lon)")
def timetable_archives(spark, d):
    """Of two documents, one in an archive inside the archive, the longer shape counts; a broken member is skipped."""
    def archive(**members) -> bytes:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("_", "."), data)
        return raw.getvalue()

    data = archive(a_xml=_TXC % "0.1", bad_xml="<x", in_zip=archive(b_xml=_TXC % "0.2"))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/timetables-{uuid.uuid4().hex}/x.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    t = bakes.timetables(spark, str(path.getParent()))
    return t.select("key", F.size("poly").alias("points"), F.round(F.element_at("poly", -1)["lon"], 4).cast("decimal(3,1)").alias("lon"))


# ---- sinks -------------------------------------------------------------------------------------------------------------

@query("select id as i, line as l, operator as o, direction as r, dest as d, lon as x, lat as y, bearing as b, epoch_ms(recorded_at) as t from bus_fixes")
def bus_wire_rows(spark, d):
    return feeds.bus_wire(table(spark, d, "bus_fixes"))


@query("""select 'Point|' || round((x + 3.3e-7) * 100000)::bigint || '|' || round((y + 3.3e-7) * 100000)::bigint || '|' || i as feature from (select distinct i, x, y from bike_stations where i is not null and x between -180 and 180 and y between -90 and 90)""")
def geojson_points(spark, d):
    b = table(spark, d, "bike_stations").where("i is not null and x between -180 and 180 and y between -90 and 90").select("i", "x", "y").distinct()
    f = bakes.geojson(b, "Point", F.struct((F.col("x") + 3.3e-7).alias("lon"), (F.col("y") + 3.3e-7).alias("lat")), ["i"])
    get = lambda p: F.get_json_object("value", p)
    number = lambda p: F.round(get(p).cast("double") * 100_000).cast("long").cast("string")
    return f.where("get_json_object(value, '$.type') = 'Feature'").select(F.concat_ws("|", get("$.geometry.type"), number("$.geometry.coordinates[0]"), number("$.geometry.coordinates[1]"), get("$.properties.i")).alias("feature"))


@query("select 'A_' || c_custkey || '_out' as safe_key, 'A:' || c_custkey || ':out' as key from customer where c_custkey % 3 = 0")
def stored_routes(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("A:"), "c_custkey", F.lit(":out")).alias("key"), F.when(F.col("c_custkey") % 3 == 0, "learned").otherwise("insufficient").alias("outcome"))
    path = f"{shared_folder(spark)}/routes-{uuid.uuid4().hex}"
    bakes.write_routes(c, path)
    return spark.read.parquet(path).select("safe_key", "key")


@query("select strftime(day, '%Y-%m-%d') as dt from (select distinct cast(o_orderdate as date) as day from orders where o_orderdate >= timestamp '1998-07-01') where day >= (select max(cast(o_orderdate as date)) from orders) - 7")
def retained_traces(spark, d):
    """Day partitions that are left after the expired ones were deleted."""
    o = table(spark, d, "orders").where("o_orderdate >= timestamp '1998-07-01'").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"), F.col("o_orderkey").cast("string").alias("value"))
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    o.write.partitionBy("dt").text(path)
    quality.delete_expired(spark, path, F.lit(o.agg(F.max("dt")).first()[0]))
    return spark.read.text(path).select(F.date_format("dt", "yyyy-MM-dd").alias("dt")).distinct()


# ---- streams -------------------------------------------------------------------------------------------------------------

def _streamed(spark: SparkSession, df: DataFrame, files: int = 1) -> DataFrame:
    """A table as a stream of files in the order of ``ord``."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange(files, "ord").sortWithinPartitions("ord") if files > 1 else df.coalesce(1)
    ordered.write.parquet(path)
    live.use_rocksdb(spark)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finished(writer) -> None:
    q = writer.start()
    q.awaitTermination()


@query("""with l as (select operator || ':' || line || ':' || direction as k, id as i, round(lon, 6) as x, cast(floor(epoch(recorded_at)) as bigint) as t, fix_id from bus_fixes where operator is not null and direction is not null and trim(line) <> '' and id is not null and lat is not null and lon is not null and recorded_at is not null)
select k, i, x, t from (select *, lag(t) over (partition by i order by fix_id) as p from l) where p is distinct from t""")
def trace_stream(spark, d):
    """Fixes whose time differs from the last one written of their vehicle, by a stream in two batches."""
    b = table(spark, d, "bus_fixes").where("operator is not null and direction is not null and trim(line) <> '' and id is not null and lat is not null and lon is not null and recorded_at is not null").withColumn("ord", F.col("fix_id"))
    out = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    _finished(live.trace_sink(_streamed(spark, b.select("id", "line", "operator", "direction", "lon", "lat", "recorded_at", "ord"), 2), out, out + "-check").trigger(availableNow=True))
    return spark.read.schema("k string, i string, x double, y double, t bigint, dt date").json(out).select("k", "i", F.round("x", 6).alias("x"), "t")


@query(f"with {_EVENT_SQL}{_TOTALS_SQL} select mode, period, bucket, id::varchar as id, round(m, 4) as m from facts where period = 'day' and cast(bucket as date) >= (select max(cast(bucket as date)) from facts where period = 'day') - 62")
def board_stream(spark, d):
    """The distance board as a stream keeps it, over two batches and a restart with a new checkpoint, without expired buckets."""
    f = fixes(spark, d).select(F.lit("bus").alias("mode"), F.col("vid").cast("string").alias("id"), F.col("mode").alias("label"), F.col("mode").alias("line_id"), "lat", "lon", F.col("tms").alias("t_ms"), F.col("tms").alias("tick_ms"), F.col("event_id").alias("ord"))
    folder = f"{shared_folder(spark)}/board-{uuid.uuid4().hex}"
    credits = live.credits(_streamed(spark, f, 2), live.Credits(max_gap_ms=GAP_MS))
    _finished(live.board_sink(credits, folder, folder + "-check", None))
    empty = live.credits(_streamed(spark, f.where("false")), live.Credits(max_gap_ms=GAP_MS))
    _finished(live.board_sink(empty, folder, folder + "-check2", None))
    newest = live.newest_snapshot(spark, folder, folder + "-look") - 1
    return live.load_facts(spark, f"{folder}/snapshot={newest}").where("period = 'day'").select("mode", "period", "bucket", "id", F.round("m", 4).alias("m"))


@query("""select mmsi, last_value(nullif(trim(name), '') ignore nulls order by last_seen, report_id) as name, last_value(ship_type ignore nulls order by last_seen, report_id) as ship_type, max(last_seen) as last_seen from vessels where mmsi is not null and last_seen is not null group by mmsi""".replace("last_value(nullif(trim(name), '') ignore nulls order by last_seen, report_id)", "arg_max(nullif(trim(name), ''), last_seen * 1000000 + report_id)").replace("last_value(ship_type ignore nulls order by last_seen, report_id)", "arg_max(ship_type, last_seen * 1000000 + report_id)"))
def vessel_stream(spark, d):
    """Rows merged from partial messages by a stream of one batch."""
    v = table(spark, d, "vessels").where("mmsi is not null and last_seen is not null").withColumn("ord", F.col("report_id"))
    m = v.select("mmsi", F.nullif(F.trim("name"), F.lit("")).alias("name"), "lat", "lon", "sog", "cog", "ship_type", "destination", F.col("length_m").cast("int").alias("length_m"), F.col("width_m").cast("int").alias("width_m"), "draught_m", "last_seen", "ord")
    out = f"{shared_folder(spark)}/vessels-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    _finished(live.merged_vessels(_streamed(spark, m)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "-check").trigger(availableNow=True))
    return spark.read.parquet(f"{out}/0").select("mmsi", "name", "ship_type", "last_seen")
