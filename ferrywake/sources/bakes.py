"""Baked tables, timetables and configuration."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ferrywake.functions.geo import Box
from ferrywake.functions.polyline import grid_to_wgs84

PT = "struct<lon:double,lat:double>"
BRANCHES = "lineId string, branches array<struct<branchId:int,direction:string,stops:array<struct<id:string,name:string,lon:double,lat:double>>,segments:array<array<array<double>>>,runTimes:array<int>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines with mode, colour and display colour."""
    return _json(spark, path, "lines array<struct<id:string,name:string,mode:string,color:string,displayColor:string>>").select(F.explode("lines").alias("l")).select("l.id", "l.name", "l.mode", "l.color", F.col("l.displayColor").alias("display_color"))


def branches(spark: SparkSession, path: str) -> DataFrame:
    """Branches of all lines below a folder or glob (S10); lines without a file simply have none."""
    b = _json(spark, path, BRANCHES).select(F.col("lineId").alias("line_id"), F.explode("branches").alias("b"))
    segments = F.transform("b.segments", lambda s: F.transform(s, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))
    return b.select("line_id", F.col("b.branchId").alias("branch_id"), F.col("b.direction").alias("direction"), F.col("b.stops").alias("stops"), segments.alias("segments"), F.col("b.runTimes").alias("run_times"))


def point_features(spark: SparkSession, path: str) -> DataFrame:
    """Station points of feature collections."""
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<id:string,name:string,lineId:string>>>"
    return _json(spark, path, schema).select(F.explode("features").alias("f")).select("f.properties.id", "f.properties.name", F.col("f.properties.lineId").alias("line_id"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def rail_tables(spark: SparkSession, stations: str, segments: str) -> tuple[DataFrame, DataFrame]:
    """Rail stations and undirected segments."""
    s = _json(spark, segments, "a string, b string, lenM double, poly array<array<double>>")
    poly = F.transform("poly", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return _json(spark, stations, "crs string, name string, lat double, lon double"), s.select("a", "b", F.col("lenM").alias("len_m"), poly.alias("poly"))


def geojson(df: DataFrame, geometry: str, coordinates: Column, properties: list[str], places: int = 5) -> DataFrame:
    """Features as text, coordinates rounded (K6). ``coordinates`` is a (lon, lat) struct for Point, an array of them for LineString."""
    short = lambda p: F.array(F.round(p["lon"], places), F.round(p["lat"], places))
    shape = short(coordinates) if geometry == "Point" else F.transform(coordinates, short)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), shape.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_routes(routes: DataFrame, path: str) -> None:
    """Learned routes as one table keyed by the sanitised key (K5)."""
    from ferrywake.functions.text import safe_key

    routes.where("outcome = 'learned'").withColumn("safe_key", safe_key(F.col("key"))).write.mode("overwrite").parquet(path)


def fresh_datasets(datasets: DataFrame, today: Column, grace_days: int = 90) -> DataFrame:
    """Timetable datasets that don't end more than 90 days ago or whose end isn't known, newest first."""
    return datasets.where(F.col("end_date").isNull() | (F.date_add("end_date", grace_days) > today)).orderBy(F.desc_nulls_last("modified"))


def newest_per_output(datasets: DataFrame, output: str) -> DataFrame:
    """Of the datasets that write one output the newest (L4); the smaller id of equally new ones."""
    w = Window.partitionBy(output).orderBy(F.desc_nulls_last("modified"), "id")
    return datasets.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def all_features(parts: list[DataFrame]) -> DataFrame:
    """Feature rows of several lines as one collection."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def timetable_shapes(xml: bytes) -> list[tuple[str, str, str, list[tuple[float, float]], list[tuple[float, float]]]]:
    """(operator, line, direction, shape, stops) of a timetable document; grid coordinates are transformed."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(xml)
    find = lambda e, n: next((x for x in e.iter() if _local(x.tag) == n), None)
    text = lambda e, n: (lambda x: (x.text or "").strip() if x is not None else "")(find(e, n))

    def place(e) -> tuple[float, float] | None:
        lon, lat = text(e, "Longitude"), text(e, "Latitude")
        if lon and lat:
            return float(lon), float(lat)
        east, north = text(e, "Easting"), text(e, "Northing")
        if east and north:
            x, y = grid_to_wgs84(float(east), float(north))
            return float(x), float(y)
        return None

    operator = text(root, "NationalOperatorCode") or text(root, "OperatorCode")
    lines = {e.get("id", ""): text(e, "LineName") for e in root.iter() if _local(e.tag) == "Line"}
    points = {text(e, "StopPointRef"): p for e in root.iter() if _local(e.tag) == "AnnotatedStopPointRef" and (p := place(e))}
    links = {}
    for e in root.iter():
        if _local(e.tag) == "RouteLink":
            track = [p for x in e.iter() if _local(x.tag) == "Location" and (p := place(x))]
            ends = [text(x, "StopPointRef") for x in e if _local(x.tag) in ("From", "To")]
            links[e.get("id", "")] = (track or [points[s] for s in ends if s in points], ends)
    sections = {e.get("id", ""): [x.get("id", "") for x in e if _local(x.tag) == "RouteLink"] for e in root.iter() if _local(e.tag) == "RouteSection"}
    routes = {e.get("id", ""): [s for x in e if _local(x.tag) == "RouteSectionRef" for s in sections.get((x.text or "").strip(), [])] for e in root.iter() if _local(e.tag) == "Route"}
    out = []
    name = next(iter(lines.values()), "")
    for e in root.iter():
        if _local(e.tag) != "JourneyPattern":
            continue
        shape: list[tuple[float, float]] = []
        stops: list[tuple[float, float]] = []
        for link in routes.get(text(e, "RouteRef"), []):
            track, ends = links.get(link, ([], []))
            shape += track if not shape or (track and shape[-1] != track[0]) else track[1:]
            stops += [points[s] for s in ends if s in points and (not stops or stops[-1] != points[s])]
        if len(shape) > 1:
            out.append((operator, name, text(e, "Direction") or "outbound", shape, stops))
    return out


def timetables(spark: SparkSession, path: str, most_bytes: int = 40 * 1024**2) -> DataFrame:
    """Longest shape per OPERATOR:line:direction of timetable archives (S11, A17): ``key, poly, stops``. Archives may hold archives, one level deep; broken members are skipped."""
    point = lambda ps: [{"lon": x, "lat": y} for x, y in ps]

    def documents(raw: bytes, depth: int = 0) -> Iterator[bytes]:
        if not zipfile.is_zipfile(io.BytesIO(raw)):
            yield raw
            return
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                low = info.filename.lower()
                if info.file_size <= most_bytes and (low.endswith(".xml") or low.endswith(".zip") and depth == 0):
                    yield from documents(z.read(info), depth + 1)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ferrywake.functions.polyline import cumulative, to_m

        for f in frames:
            rows = []
            for raw in f["content"]:
                for doc in documents(bytes(raw)):
                    try:
                        found = timetable_shapes(doc)
                    except Exception:  # noqa: BLE001 - a broken document doesn't end the scan
                        continue
                    rows += [(f"{o}:{line}:{way}", float(cumulative(to_m(shape))[-1]), point(shape), point(stops)) for o, line, way, shape, stops in found]
            yield pd.DataFrame(rows, columns=["key", "length_m", "poly", "stops"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,xml}").load(path).select("content")
    shapes = files.mapInPandas(parse, f"key string, length_m double, poly array<{PT}>, stops array<{PT}>")
    return shapes.groupBy("key").agg(F.max_by(F.struct("poly", "stops"), "length_m").alias("r")).select("key", "r.*")


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are skipped, quotes around a value removed."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            v = m.group(2)
            out[m.group(1)] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


@dataclass(frozen=True)
class Region:
    """The region a deployment covers."""

    name: str
    box: Box
    centre: tuple[float, float]
    radius_nm: float


def parse_box(text: str, name: str = "BBOX") -> Box:
    parts = [p.strip() for p in text.split(",")]
    try:
        west, south, east, north = map(float, parts)
    except ValueError:
        raise ValueError(f"{name}: expected four numbers west,south,east,north, got {text!r}") from None
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError(f"{name}: west must be below east and south below north, inside the globe, got {text!r}")
    return Box(west, south, east, north)


def parse_lonlat(text: str, name: str) -> tuple[float, float]:
    try:
        lon, lat = (float(p) for p in text.split(","))
    except ValueError:
        raise ValueError(f"{name}: expected two numbers lon,lat, got {text!r}") from None
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"{name}: outside the globe: {text!r}")
    return lon, lat


def parse_flag(text: str | None, name: str, default: bool = False) -> bool:
    if text is None or text.strip() == "":
        return default
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"{name}: expected true or false, got {text!r}")


def load_region(env: dict[str, str] | None = None) -> Region:
    env = dict(os.environ) if env is None else env
    box = parse_box(env.get("REGION_BBOX", "-0.55,51.25,0.35,51.72"), "REGION_BBOX")
    centre = parse_lonlat(env["REGION_CENTRE"], "REGION_CENTRE") if env.get("REGION_CENTRE") else ((box.min_lon + box.max_lon) / 2, (box.min_lat + box.max_lat) / 2)
    return Region(env.get("REGION_NAME", "London"), box, centre, float(env.get("REGION_RADIUS_NM", "30")))


def capabilities(env: dict[str, str], files: set[str]) -> dict[str, bool]:
    """Which layers can run: those whose credential or data file is there."""
    has = lambda *names: all(env.get(n, "").strip() for n in names)
    return {"buses": has("BODS_API_KEY"), "vessels": has("AIS_API_KEY"), "rail": has("DARWIN_TOKEN") and {"nr/stations.json", "nr/segments.json"} <= files, "bikes": has("GBFS_URL"), "tides": parse_flag(env.get("TIDES"), "TIDES", True), "trains": "manifest.json" in files}


def save_json(rows: list[dict], path: str) -> None:
    """Small snapshots as JSON, written beside and then renamed, so readers never see half a file (K3)."""
    with open(path + ".tmp", "w") as f:
        json.dump(rows, f)
    os.replace(path + ".tmp", path)
