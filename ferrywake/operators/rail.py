"""Timetabled trains on a rail graph."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.functions.clock import near_time_ms, stop_time_ms
from ferrywake.functions.polyline import point_at_fraction
from ferrywake.functions.text import short_operator
from ferrywake.operators.latest import without_repeats
from ferrywake.operators.lookups import snapped
from ferrywake.session import materialize

MOST_PATH_M = 60_000.0
FINISHED_MS = 120_000

# Stations outside the region and the station of the network their line enters by.
GATEWAYS = {
    "MKC": "KGL", "TRI": "KGL", "RDG": "LNY", "SLO": "LNY", "MAI": "LNY", "TWY": "LNY", "SVG": "PBR", "HIT": "PBR", "WGC": "PBR", "PBO": "PBR", "LUT": "RDT", "LTN": "RDT", "SAC": "RDT", "BDM": "RDT",
    "CHM": "SNF", "COL": "SNF", "HWN": "CHN", "BIS": "CHN", "SSD": "CHN", "BSO": "WHR", "HWY": "DGC", "GER": "DGC", "WOK": "WBY", "BSK": "WBY", "GLD": "CLA", "TON": "SEV", "RDH": "MHM", "GTW": "MHM",
}
# Initials of train operators.
INITIALS = {
    "South Western Railway": "SWR", "Southeastern": "SE", "Southern": "SN", "Thameslink": "TL", "Great Northern": "GN", "Gatwick Express": "GX", "Great Western Railway": "GWR", "Greater Anglia": "GA", "London North Eastern Railway": "LNER",
    "Avanti West Coast": "AWC", "East Midlands Railway": "EMR", "West Midlands Railway": "WMR", "London Northwestern Railway": "LNR", "Chiltern Railways": "CH", "Heathrow Express": "HEX", "CrossCountry": "XC", "TransPennine Express": "TPE",
    "London Overground": "LO", "Elizabeth line": "EL", "Elizabeth Line": "EL", "c2c": "c2c", "Grand Central": "GC", "Hull Trains": "HT", "Lumo": "LUMO", "ScotRail": "SR", "Transport for Wales": "TfW", "Caledonian Sleeper": "CS",
}


def services(boards: DataFrame, stations: DataFrame, now_ms: Column, gateways: dict[str, str] | None = None) -> DataFrame:
    """One row per board and service with its timed stops on the network.

    ``boards``: crs, ord, service struct (rid, std, etd, operator, destination, cancelled, calling_points array of (crs, name, st, et, at)). Cancelled
    services and those with fewer than two timed stops are dropped.
    """
    live = boards.where(F.col("service.rid").isNotNull() & (F.col("service.rid") != "") & ~F.coalesce("service.cancelled", F.lit(False)) & ~F.coalesce(F.col("service.etd") == "Cancelled", F.lit(False)))
    own = F.struct(F.col("crs").alias("crs"), F.lit(None).cast("string").alias("name"), F.coalesce(near_time_ms(F.col("service.etd"), now_ms), near_time_ms(F.col("service.std"), now_ms)).alias("time"), F.lit(True).alias("first"))
    rest = F.transform(F.col("service.calling_points"), lambda p: F.struct(p["crs"].alias("crs"), p["name"].alias("name"), stop_time_ms(p["at"], p["et"], p["st"], now_ms).alias("time"), F.lit(False).alias("first")))
    points = live.select("crs", "ord", "service", F.posexplode(F.concat(F.array(own), F.coalesce(rest, F.array().cast("array<struct<crs:string,name:string,time:bigint,first:boolean>>")))).alias("i", "p"))
    flat = points.select("ord", "i", F.col("service.rid").alias("rid"), F.col("service.operator").alias("operator"), F.col("service.destination").alias("destination"), F.col("p.crs").alias("pcrs"), F.col("p.name").alias("pname"), F.col("p.time").alias("time"), F.col("p.first").alias("first"))
    on = snapped(flat.where("time is not null and pcrs is not null"), "pcrs", stations, GATEWAYS if gateways is None else gateways).where("not first or node = pcrs")
    named = on.join(stations.groupBy(F.col("crs").alias("node")).agg(F.min("name").alias("sname")), "node")
    listed = named.groupBy("ord", "rid").agg(F.first("operator").alias("operator"), F.first("destination").alias("destination"), F.array_sort(F.collect_list(F.struct("i", F.col("node").alias("crs"), F.when(F.col("first"), F.col("sname")).otherwise(F.col("pname")).alias("name"), "time"))).alias("s"))
    stops = without_repeats(F.transform("s", lambda s: F.struct(s["crs"].alias("crs"), s["name"].alias("name"), s["time"].alias("time"))), "crs")
    return listed.select("ord", "rid", short_operator(F.coalesce("operator", F.lit("")), INITIALS).alias("operator"), "destination", stops.alias("stops")).where(F.size("stops") >= 2)


def merged(rows: DataFrame) -> DataFrame:
    """Of each service the longest calling pattern, the first board of equal ones."""
    return rows.groupBy("rid").agg(F.max_by(F.struct("operator", "destination", "stops"), F.struct(F.size("stops"), -F.col("ord"))).alias("r")).select("rid", "r.*")


def running(trains: DataFrame, now_ms: Column) -> DataFrame:
    return trains.where(F.element_at("stops", -1)["time"] >= now_ms - FINISHED_MS)  # P3


def _neighbours(edges: list) -> dict[str, list[tuple[str, float, int, bool]]]:
    out: dict[str, list[tuple[str, float, int, bool]]] = {}
    for n, e in enumerate(edges):
        out.setdefault(e["a"], []).append((e["b"], e["len_m"], n, True))
        out.setdefault(e["b"], []).append((e["a"], e["len_m"], n, False))
    return out


def shortest(edges: list, near: dict, start: str, goals: set[str], most_m: float) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """Shortest paths from a node to ``goals`` (Dijkstra with a heap), each with its length and its polyline."""
    dist, back, done = {start: 0.0}, {}, set()
    heap = [(0.0, start)]
    left = set(goals)
    while heap and left:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        if d > most_m:
            break
        done.add(node)
        left.discard(node)
        for other, length, n, forward in near.get(node, ()):
            if d + length < dist.get(other, float("inf")):
                dist[other] = d + length
                back[other] = (node, n, forward)
                heapq.heappush(heap, (d + length, other))
    out = {}
    for g in goals & done:
        parts, at = [], g
        while at != start:
            at, n, forward = back[at]
            pts = [(p["lon"], p["lat"]) for p in edges[n]["poly"]]
            parts.append(pts if forward else pts[::-1])
        line: list[tuple[float, float]] = []
        for pts in reversed(parts):
            line += pts if not line else pts[1:]
        out[g] = (dist[g], line)
    return out


def rail_paths(pairs: DataFrame, segments: DataFrame, most_m: float = MOST_PATH_M, most_segments: int = 200_000) -> DataFrame:
    """Length and polyline of the shortest path for each (``a``, ``b``) of ``pairs`` within ``most_m`` (G1, G7). ``segments``: a, b, len_m, poly; undirected.

    Paths need the whole graph at hand: it is a country's track, whose size is checked before it is broadcast to the searching tasks.
    A pair of equal stations has an empty path.
    """
    if segments.limit(most_segments + 1).count() > most_segments:
        raise ValueError(f"more than {most_segments} segments")
    rows = [r.asDict(recursive=True) for r in segments.where("a is not null and b is not null and len_m >= 0").select("a", "b", "len_m", "poly").collect()]  # bounded by the check
    shared = segments.sparkSession.sparkContext.broadcast(rows)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = shared.value
        near = _neighbours(edges)
        for f in frames:
            out = []
            for a, g in zip(f["a"], f["goals"]):
                out += [(a, b, length, [{"lon": x, "lat": y} for x, y in line]) for b, (length, line) in shortest(edges, near, a, set(g), most_m).items()]
            yield pd.DataFrame(out, columns=["a", "b", "len_m", "poly"])

    wanted = pairs.where("a is not null and b is not null").groupBy("a").agg(F.collect_set("b").alias("goals"))
    return wanted.mapInPandas(search, "a string, b string, len_m double, poly array<struct<lon:double,lat:double>>")


def bracketed(trains: DataFrame, now_ms: Column) -> DataFrame:
    """The stops between which each train is (W11): the last one due by now and the one after; none before the start or after the end."""
    stops = trains.select("rid", "operator", "destination", F.posexplode("stops").alias("i", "s"), "stops")
    here = stops.withColumn("to", F.get("stops", F.col("i") + 1)).where(F.col("to").isNotNull())
    # the scan goes on only while the next stop is due, so it ends at the first one that isn't
    first = here.where(F.col("to")["time"] > now_ms).groupBy("rid").agg(F.min_by(F.struct("operator", "destination", F.col("s").alias("from"), "to"), "i").alias("r"))
    started = trains.where(F.get("stops", F.lit(0))["time"] <= now_ms).select("rid")
    return first.join(started, "rid").select("rid", "r.*")


def positions(trains: DataFrame, segments: DataFrame, now_ms: Column) -> DataFrame:
    """Where each train is by its clock along the shortest path."""
    at = materialize(bracketed(trains, now_ms))
    paths = rail_paths(at.select(F.col("from.crs").alias("a"), F.col("to.crs").alias("b")).distinct(), segments)
    on = at.join(paths.where(F.size("poly") > 1), (F.col("from.crs") == F.col("a")) & (F.col("to.crs") == F.col("b")))
    span = F.col("to.time") - F.col("from.time")
    frac = F.when(span <= 0, 0.0).otherwise(F.least(F.lit(1.0), (now_ms - F.col("from.time")) / span))
    return on.withColumn("frac", frac).withColumn("at", point_at_fraction("poly", "frac")).select("rid", "operator", "destination", F.col("from.crs").alias("from_crs"), F.col("to.crs").alias("to_crs"), "frac", "at.lon", "at.lat", "at.bearing")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components (A19): ``node, component`` (the smallest node), by alternating large-star and small-star rounds.

    Each round is a group-by and a join-free regrouping; labels halve distances, so rounds grow with the logarithm of the diameter. Nothing is collected.
    """
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).where("node is not null").distinct()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:  # stars shrink until nothing changes
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = materialize(small)
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        if now == before:
            break
        before = now
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def shortest_lengths(edges: DataFrame, start: str, rounds: int) -> DataFrame:
    """Length of the shortest path from ``start`` with at most ``rounds`` edges, by relaxation; ``edges``: a, b, len_m in both directions."""
    best = edges.sparkSession.createDataFrame([(start, 0.0)], "node string, len_m double")
    for _ in range(rounds):
        step = best.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (best["len_m"] + edges["len_m"]).alias("len_m"))
        best = materialize(best.unionByName(step).groupBy("node").agg(F.min("len_m").alias("len_m")))
    return best


def undirected_shortest(segments: DataFrame) -> DataFrame:
    """The shortest segment of each unordered pair."""
    keyed = segments.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    w = Window.partitionBy("lo", "hi").orderBy("len_m", "a", "b")
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
