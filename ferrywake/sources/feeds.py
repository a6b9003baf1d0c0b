"""Feeds as files: XML and JSON scans into the engine's tables.

Every reader takes a path of captured payloads; nothing here opens a network connection. Schemas are explicit and malformed rows are dropped one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ferrywake.functions import text
from ferrywake.functions.geo import Box

TAGS = ("RecordedAtTime", "LineRef", "PublishedLineName", "OperatorRef", "DirectionRef", "DestinationName", "VehicleRef", "Longitude", "Latitude", "Bearing")


def activity_fields(xml: Column) -> dict[str, Column]:
    """First text of each tag of a vehicle activity; null where the tag is missing."""
    out = {}
    for tag in TAGS:
        raw = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)</", 1)
        plain = raw
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(sign))
        out[tag] = F.nullif(F.trim(plain), F.lit(""))
    return out


def bus_activities(documents: DataFrame, column: str, now: Column, ttl_s: int = 300) -> DataFrame:
    """Bus fixes of SIRI vehicle-monitoring documents (S1, F14, F15, P3): ``id, line, operator, direction, dest, lat, lon, bearing, recorded_at``.

    Activities without vehicle, position or time, and those older than five minutes, are dropped.
    """
    one = documents.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<VehicleActivity[ >].*?</VehicleActivity>"), F.lit(0))).alias("a"))
    f = activity_fields(F.col("a"))
    at = f["RecordedAtTime"].try_cast("timestamp")
    lon, lat = f["Longitude"].try_cast("double"), f["Latitude"].try_cast("double")
    rows = one.select(
        F.concat_ws(":", F.coalesce(f["OperatorRef"], F.lit("")), f["VehicleRef"]).alias("id"), F.coalesce(f["PublishedLineName"], f["LineRef"], F.lit("")).alias("line"), F.coalesce(f["OperatorRef"], F.lit("")).alias("operator"),
        text.direction(F.coalesce(f["DirectionRef"], F.lit(""))).alias("direction"), text.humanized(F.coalesce(f["DestinationName"], F.lit(""))).alias("dest"), lat.alias("lat"), lon.alias("lon"), f["Bearing"].try_cast("double").alias("bearing"),
        at.alias("recorded_at"), f["VehicleRef"].alias("_v"),
    )
    good = F.col("_v").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & F.col("recorded_at").isNotNull()
    return rows.where(good & (F.unix_millis(now) - F.unix_millis("recorded_at") <= ttl_s * 1000)).drop("_v")


def bus_files(spark: SparkSession, path: str, now: Column) -> DataFrame:
    return bus_activities(spark.read.text(path, wholetext=True), "value", now)


def bus_wire(buses: DataFrame) -> DataFrame:
    """Short-key projection (K7)."""
    return buses.select(F.col("id").alias("i"), F.col("line").alias("l"), F.col("operator").alias("o"), F.col("direction").alias("r"), F.col("dest").alias("d"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("bearing").alias("b"), F.unix_millis("recorded_at").alias("t"))


AIS = "MessageType string, MetaData struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double>, Message struct<PositionReport:struct<Sog:double,Cog:double>,ShipStaticData:struct<Type:int,Destination:string,MaximumStaticDraught:double,Dimension:struct<A:int,B:int,C:int,D:int>>>, received_ms bigint"


def vessel_messages(spark: SparkSession, path: str) -> DataFrame:
    """AIS messages, one per line, as partial vessel rows (S3, F42); `latest.carried_forward` merges them."""
    m = spark.read.schema(AIS).option("mode", "DROPMALFORMED").json(path)
    d = F.col("Message.ShipStaticData.Dimension")
    rows = m.select(
        F.col("MetaData.MMSI").alias("mmsi"), F.nullif(F.trim("MetaData.ShipName"), F.lit("")).alias("name"), F.col("MetaData.latitude").alias("lat"), F.col("MetaData.longitude").alias("lon"), F.col("Message.PositionReport.Sog").alias("sog"),
        F.col("Message.PositionReport.Cog").alias("cog"), F.col("Message.ShipStaticData.Type").alias("ship_type"), F.nullif(F.trim("Message.ShipStaticData.Destination"), F.lit("")).alias("destination"), text.dimension(d["A"], d["B"]).alias("length_m"),
        text.dimension(d["C"], d["D"]).alias("width_m"), F.nullif(F.col("Message.ShipStaticData.MaximumStaticDraught"), F.lit(0.0)).alias("draught_m"), F.col("received_ms").alias("last_seen"),
    )
    return rows.where("mmsi is not null and lat is not null and lon is not null")


BOARD = "crs string, services array<struct<rid:string,std:string,etd:string,platform:string,operator:string,origin:string,destination:string,isCancelled:boolean,callingPointLists:array<array<struct<crs:string,name:string,st:string,et:string,at:string,isCancelled:boolean>>>>>"


def departure_boards(spark: SparkSession, path: str) -> DataFrame:
    """Departure boards as ``crs, ord, service`` (S4): the first list of calling points only, without cancelled points; 'Cancelled' as an estimate cancels."""
    b = spark.read.schema(BOARD).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    s = b.select("crs", F.posexplode("services").alias("n", "s"), F.monotonically_increasing_id().alias("board"))
    points = F.filter(F.coalesce(F.get("s.callingPointLists", F.lit(0)), F.array().cast("array<struct<crs:string,name:string,st:string,et:string,at:string,isCancelled:boolean>>")), lambda p: ~F.coalesce(p["isCancelled"], F.lit(False)))
    cancelled = F.coalesce(F.col("s.isCancelled"), F.lit(False)) | F.coalesce(F.col("s.etd") == "Cancelled", F.lit(False))
    service = F.struct(F.col("s.rid").alias("rid"), F.col("s.std").alias("std"), F.col("s.etd").alias("etd"), F.col("s.platform").alias("platform"), F.col("s.operator").alias("operator"), F.col("s.origin").alias("origin"), F.col("s.destination").alias("destination"), cancelled.alias("cancelled"), points.alias("calling_points"))
    return s.select("crs", (F.col("board") * 1000 + F.col("n")).alias("ord"), service.alias("service"))


FEED = "array<struct<name:string,url:string>>"


def bike_feeds(discovery: DataFrame, column: str) -> DataFrame:
    """Feed URLs of a discovery document of any version (S5): data.feeds, else data.<language>.feeds; the first of equal names."""
    direct = F.from_json(F.get_json_object(column, "$.data.feeds"), FEED)
    langs = F.map_values(F.from_json(F.get_json_object(column, "$.data"), f"map<string,struct<feeds:{FEED}>>", {"mode": "PERMISSIVE"}))
    nested = F.flatten(F.transform(F.coalesce(langs, F.array().cast(f"array<struct<feeds:{FEED}>>")), lambda v: F.coalesce(v["feeds"], F.array().cast(FEED))))
    all_feeds = F.concat(F.coalesce(direct, F.array().cast(FEED)), F.coalesce(nested, F.array().cast(FEED)))
    rows = discovery.select(F.posexplode(all_feeds).alias("n", "f")).where("f.name is not null and f.url is not null")
    return rows.groupBy("f.name").agg(F.min_by("f.url", "n").alias("url"))


def bike_info(documents: DataFrame, column: str, box: Box | None = None) -> DataFrame:
    """Station catalogue (S5, F35); names may be localised lists."""
    rows = documents.select(F.explode(F.from_json(F.get_json_object(column, "$.data.stations"), "array<string>")).alias("s"))
    field = lambda p, t: F.get_json_object("s", "$." + p).try_cast(t)
    name = F.coalesce(text.localized_name(F.when(F.get_json_object("s", "$.name").startswith("["), F.get_json_object("s", "$.name")).otherwise(F.to_json(F.struct(F.get_json_object("s", "$.name").alias("v"))))), F.nullif(F.trim(F.get_json_object("s", "$.name")), F.lit("")))
    out = rows.select(F.get_json_object("s", "$.station_id").alias("station_id"), name.alias("name"), field("lon", "double").alias("lon"), field("lat", "double").alias("lat"), field("capacity", "int").alias("capacity"))
    out = out.where("station_id is not null and name is not null and lon is not null and lat is not null")
    return out.where(box.holds(F.col("lon"), F.col("lat"))) if box else out


def bike_reports(documents: DataFrame, column: str) -> DataFrame:
    """Station status across versions (S5). Only textual report times tell staleness."""
    rows = documents.select(F.explode(F.from_json(F.get_json_object(column, "$.data.stations"), "array<string>")).alias("s"))
    field = lambda p, t: F.get_json_object("s", "$." + p).try_cast(t)
    reported = F.get_json_object("s", "$.last_reported")
    return rows.select(
        F.get_json_object("s", "$.station_id").alias("station_id"), F.coalesce(field("num_vehicles_available", "int"), field("num_bikes_available", "int"), F.lit(0)).alias("bikes"), F.coalesce(field("num_docks_available", "int"), F.lit(0)).alias("docks"),
        field("is_renting", "boolean").alias("is_renting"), field("is_installed", "boolean").alias("is_installed"), F.when(reported.rlike(r"^\d{4}-"), F.unix_millis(reported.try_cast("timestamp"))).alias("reported_ms"),
    ).where("station_id is not null")


def tide_gauges(stations: DataFrame, readings: DataFrame, box: Box, preferred_s: int = 900) -> DataFrame:
    """Gauges with the latest reading of their preferred measure (S6, J2, A6): the 15-minute series first, then in catalogue order.

    ``stations``: ref, label, lat, lon, measures (array of id, period). ``readings``: measure, value, date_time (ISO text). Difference series and gauges outside the box are left out.
    """
    placed = stations.where(F.col("ref").isNotNull() & (F.col("ref") != "") & ~F.col("ref").startswith("DIFF") & box.holds(F.col("lon"), F.col("lat")))
    m = placed.select("ref", "label", "lat", "lon", F.posexplode("measures").alias("n", "m")).where("m.id is not null")
    good = readings.where("measure is not null and value is not null and date_time is not null")
    j = m.join(good, F.col("m.id") == F.col("measure"))
    w = Window.partitionBy("ref").orderBy(F.desc(F.coalesce(F.col("m.period") == preferred_s, F.lit(False))), "n")
    best = j.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select("ref", "label", "lat", "lon", F.col("value").alias("level_m"), F.col("date_time").alias("reading_at"))


TRACE = "k string, i string, x double, y double, t bigint, dt date"


def traces(spark: SparkSession, path: str, today: str, days: int = 3) -> DataFrame:
    """Trace lines of the last days (S9, T15): partitions by date are pruned, torn lines dropped."""
    raw = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)
    return raw.where(F.col("dt") >= F.date_sub(F.to_date(F.lit(today)), days)).where("k is not null and i is not null and x is not null and y is not null and t is not null").drop("dt")


def aircraft(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Aircraft of the first source that can be read."""
    schema = "ac array<struct<hex:string,flight:string,r:string,t:string,alt_baro:string,gs:double,track:double,lat:double,lon:double,category:string>>"
    last: Exception | None = None
    for p in paths:
        try:
            df = spark.read.schema(schema).option("multiLine", True).json(p)
            return df.select(F.explode("ac").alias("a")).select("a.*").where(text.flying(F.col("lat"), F.col("lon"), F.col("category")))
        except Exception as e:  # noqa: BLE001 - any failure of one source leads to the next
            last = e
    raise last or ValueError("no source")


def radar_frame(documents: DataFrame, column: str) -> DataFrame:
    """The last past radar frame."""
    past = F.from_json(F.get_json_object(column, "$.radar.past"), "array<struct<time:bigint,path:string>>")
    return documents.select(F.get_json_object(column, "$.host").alias("host"), F.try_element_at(past, F.lit(-1)).alias("f")).where("f is not null").select("host", "f.time", "f.path")


ARRIVAL = "array<struct<id:string,vehicleId:string,naptanId:string,stationName:string,lineId:string,lineName:string,platformName:string,direction:string,destinationNaptanId:string,destinationName:string,timeToStation:int,currentLocation:string,towards:string>>"


def arrivals(documents: DataFrame, column: str, order: str) -> DataFrame:
    """Arrival predictions as `trains.infer_trains` takes them (S7); ``order`` numbers the documents, and rows keep their order in them."""
    rows = documents.select(F.col(order).alias("doc"), F.posexplode(F.from_json(column, ARRIVAL)).alias("n", "a"))
    names = {"line_id": "lineId", "line_name": "lineName", "vehicle_id": "vehicleId", "naptan_id": "naptanId", "station_name": "stationName", "time_to_station": "timeToStation", "current_location": "currentLocation", "platform_name": "platformName", "direction": "direction", "destination_name": "destinationName", "destination_naptan_id": "destinationNaptanId", "towards": "towards"}
    good = rows.where("a.naptanId is not null and a.lineId is not null and a.timeToStation is not null")
    return good.select(*[F.col(f"a.{v}").alias(k) for k, v in names.items()], (F.col("doc").cast("long") * 1_000_000 + F.col("n")).alias("ord"))


def line_statuses(documents: DataFrame, column: str) -> DataFrame:
    """Statuses of lines (S7): ``line, ord, description, reason``, as `lookups.disruption_text` takes them."""
    schema = "array<struct<id:string,lineStatuses:array<struct<statusSeverityDescription:string,reason:string>>>>"
    lines = documents.select(F.explode(F.from_json(column, schema)).alias("l"))
    return lines.select(F.col("l.id").alias("line"), F.posexplode("l.lineStatuses").alias("ord", "s")).select("line", "ord", F.col("s.statusSeverityDescription").alias("description"), F.col("s.reason").alias("reason"))


def stop_details(documents: DataFrame, column: str) -> DataFrame:
    """Stop points (S7, F30): ``naptan, name, lat, lon, facilities``."""
    schema = "array<struct<naptanId:string,commonName:string,lat:double,lon:double,additionalProperties:array<struct<category:string,key:string,value:string>>>>"
    s = documents.select(F.explode(F.from_json(column, schema)).alias("s")).where("s.naptanId is not null")
    return s.select(F.col("s.naptanId").alias("naptan"), text.clean_name(F.col("s.commonName")).alias("name"), "s.lat", "s.lon", text.facilities(F.col("s.additionalProperties")).alias("facilities"))


def crowding(documents: DataFrame, naptan: str, column: str) -> DataFrame:
    """Live crowding of stations."""
    c = F.from_json(column, "dataAvailable boolean, percentageOfBaseline double")
    return documents.select(naptan, text.crowding_percent(F.coalesce(c["dataAvailable"], F.lit(False)), c["percentageOfBaseline"]).alias("percent"))


def lift_messages(documents: DataFrame, column: str) -> DataFrame:
    """Lift disruptions in feed order (S7), as `lookups.lift_disruption` takes them."""
    schema = "array<struct<stationUniqueId:string,stopPointName:string,message:string>>"
    return documents.select(F.posexplode(F.from_json(column, schema)).alias("ord", "e")).select("ord", F.col("e.stationUniqueId").alias("uid"), F.col("e.stopPointName").alias("stop_name"), F.col("e.message").alias("message"))


def disruption_marker(point: Column, geography: Column) -> Column:
    """Marker of a road disruption (F31, A21): its point, else a Point, else the centroid of the first outer ring. ``geography`` is GeoJSON text."""
    pair = lambda a: F.when(F.size(a) >= 2, F.struct(F.get(a, F.lit(0)).alias("lon"), F.get(a, F.lit(1)).alias("lat")))
    kind, coords = F.get_json_object(geography, "$.type"), F.get_json_object(geography, "$.coordinates")

    def centre(ring: Column) -> Column:
        good = F.filter(ring, lambda p: F.size(p) >= 2)
        total = F.aggregate(good, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a["x"] + F.get(p, F.lit(0))).alias("x"), (a["y"] + F.get(p, F.lit(1))).alias("y")))
        return F.when(F.size(good) > 0, F.struct((total["x"] / F.size(good)).alias("lon"), (total["y"] / F.size(good)).alias("lat")))

    own = pair(F.from_json(point, "array<double>"))
    spot = F.when(kind == "Point", pair(F.from_json(coords, "array<double>")))
    poly = F.when(kind == "Polygon", centre(F.get(F.from_json(coords, "array<array<array<double>>>"), F.lit(0))))
    multi = F.when(kind == "MultiPolygon", centre(F.get(F.get(F.from_json(coords, "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0))))
    return F.coalesce(own, spot, poly, multi)


def station_list(spark: SparkSession, path: str) -> DataFrame:
    """Station list of a CSV file with a header or of a JSON array (S12): ``crs, name, lat, lon``; rows without code or place are left out."""
    schema = "crs string, name string, lat double, lon double"
    rows = spark.read.schema(schema).option("header", True).csv(path) if path.endswith(".csv") else spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where("crs is not null and lat is not null and lon is not null")


def osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of cached extracts (S12), one of each id: of equal ones the last by file and place in it."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("f"), F.posexplode("elements").alias("n", "e"))
    e = e.groupBy("e.type", "e.id").agg(F.max_by("e", F.struct("f", "n")).alias("e")).select("e.*")
    return e.where("type = 'node'").select("id", "lat", "lon", "tags"), e.where("type = 'way'").select("id", "nodes", "tags"), e.where("type = 'relation'").select("id", "members", "tags")


def route_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Line strings and stop sequences of route documents (S13): (line_id, direction, ord, poly) and (line_id, direction, branch_id, i, stop)."""
    schema = "lineId string, direction string, lineStrings array<string>, stopPointSequences array<struct<branchId:int,stopPoint:array<struct<id:string,name:string,lat:double,lon:double>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    strings = docs.select("lineId", "direction", F.posexplode("lineStrings").alias("n", "s")).withColumn("c", F.explode(F.from_json("s", "array<array<array<double>>>")))
    lines = strings.select(F.col("lineId").alias("line_id"), "direction", F.col("n").cast("long").alias("ord"), F.transform("c", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))).alias("poly"))
    stops = docs.select("lineId", "direction", F.explode("stopPointSequences").alias("q")).select(F.col("lineId").alias("line_id"), "direction", F.col("q.branchId").alias("branch_id"), F.posexplode("q.stopPoint").alias("i", "stop"))
    return lines, stops
