"""Baking of networks: assignment, stitching and graph search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ferrywake.functions import polyline
from ferrywake.operators.lookups import nearest_within
from ferrywake.operators.proximity import BITS, cover_level, disc_cells, point_code, within_distance
from ferrywake.operators.rail import _neighbours
from ferrywake.operators.series import EARTH_M, np_haversine
from ferrywake.session import discard, materialize


def _in_order(radius_m: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Stations of one cell in order, each taking the nearest node within reach that none before it and no earlier station of another cell (``h_ord``, ``h_sid``) holds."""

    def settle(stations: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("nid")
        names = nodes.column("nid").combine_chunks().dictionary_encode()  # in order of nid
        name = names.indices.to_numpy()
        line = lambda t, o, s: [(o is not None, o, s) for o, s in zip(t.column(o).to_pylist(), t.column(s).to_pylist())]
        mine, theirs = line(stations, "ord", "sid"), line(nodes, "h_ord", "h_sid")
        rank = {k: n for n, k in enumerate(sorted({*mine, *(k for k in theirs if k[2] is not None)}))}
        holder = np.full(len(names.dictionary), len(rank))
        for n, k in zip(name, theirs):
            holder[n] = rank.get(k, len(rank))
        # nodes of equal place are one, with the next of them in order of nid: what is held when a station asks stays so for those after it
        lat, lon = nodes.column("lat").to_numpy(), nodes.column("lon").to_numpy()
        by = np.lexsort((name, lon, lat))
        lat, lon, name = lat[by], lon[by], name[by]
        at = np.flatnonzero(np.r_[np.ones(min(1, len(by)), bool), (np.diff(lat) != 0) | (np.diff(lon) != 0)])
        end, lat, lon, free = np.r_[at[1:], len(by)], lat[at], lon[at], np.ones(len(at), bool)
        first_m = radius_m * min(1.0, (32 / max(1, len(at))) ** 0.5)  # a few places lie so near
        s_lat, s_lon = stations.column("lat").to_pylist(), stations.column("lon").to_pylist()
        rows, taken, metres = [], [], []
        for row in sorted(range(len(mine)), key=mine.__getitem__):
            me, reach, found = rank[mine[row]], first_m, False
            if np.count_nonzero(free) * 2 < len(free):
                at, end, lat, lon, free = at[free], end[free], lat[free], lon[free], free[free]
            while not found:
                high = np.degrees(reach / EARTH_M) * 1.000001
                i, j = np.searchsorted(lat, s_lat[row] - high), np.searchsorted(lat, s_lat[row] + high, "right")
                d = np.where(free[i:j], np_haversine(s_lat[row], s_lon[row], lat[i:j], lon[i:j]), np.inf)
                while not found and len(d) and (nearest := d.min()) <= reach:
                    for p in i + np.flatnonzero(d == nearest):
                        while at[p] < end[p] and holder[name[at[p]]] < me:
                            at[p] += 1
                        if at[p] == end[p]:
                            free[p], d[p - i] = False, np.inf
                    if len(ties := i + np.flatnonzero(d == nearest)):
                        node, found = name[at[ties]].min(), True
                        holder[node] = me
                        rows.append(row), taken.append(node), metres.append(nearest)
                if reach >= radius_m:
                    break
                reach = min(radius_m, 2 * reach)
        rows = pa.array(rows, pa.int64())
        return pa.table({"nid": names.dictionary.take(pa.array(taken, pa.int64())), **{c: stations.column(c).take(rows) for c in ("sid", "ord", "cell")}, "distance_m": pa.array(metres, pa.float64())})

    return settle


def assign_distinct(stations: DataFrame, nodes: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """Each station's nearest node within reach that no earlier station takes (J9): ``sid, nid, distance_m``.

    ``stations``: sid, lat, lon, ord; ``nodes``: nid, lat, lon. Greedy in station order, done as deferred acceptance, whose outcome is the same as nodes prefer earlier
    stations: the stations of a cell choose in order; a node that several cells ask for keeps the first in order, and the cells of the others choose again. No pairs are
    stored: a node is sent once to each cell it is within reach of, and a task holds the stations of a cell (as high as two to four radii) and the nodes within reach.
    A station has one place; other rows of it raise an error. Equal distances go to the smaller ``nid``.
    """
    level = max(1, cover_level(radius_m) - 1)
    usable = lambda df, key: df.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")}).withColumn("cell", F.shiftright(point_code(F.col("lat"), F.col("lon")), 2 * (BITS - level))).where(F.col(key).isNotNull() & F.col("cell").isNotNull())
    place = F.struct("lat", "lon")
    one = F.when(F.min(place) != F.max(place), F.raise_error(F.concat(F.lit("station of several places: "), F.col("sid").cast("string")))).otherwise(F.min(F.struct("ord", "lat", "lon", "cell")))
    s = materialize(usable(stations, "sid").groupBy("sid").agg(one.alias("s")).select("sid", "s.*"))
    n = materialize(usable(nodes, "nid").select("nid", F.col("lat").alias("slat"), F.col("lon").alias("slon")))
    reached = disc_cells(n, radius_m, level).select("nid", F.col("slat").alias("lat"), F.col("slon").alias("lon"), "cell")
    schema = StructType([StructField("nid", n.schema["nid"].dataType), *[s.schema[c] for c in ("sid", "ord", "cell")], StructField("distance_m", DoubleType())])
    claims, asking = None, s.select("cell").distinct()
    while True:
        near = reached.join(asking, "cell", "left_semi")
        if claims is None:
            near = near.withColumns({f"h_{c}": F.lit(None).cast(s.schema[c].dataType) for c in ("ord", "sid")})
        else:
            held = claims.where("place = 1").select("nid", F.col("ord").alias("h_ord"), F.col("sid").alias("h_sid"), F.col("cell").alias("home"))
            near = near.join(held, "nid", "left").select("nid", "lat", "lon", "cell", *[F.when(F.col("home") != F.col("cell"), F.col(c)).alias(c) for c in ("h_ord", "h_sid")])
        asked = s.join(asking, "cell", "left_semi").groupBy("cell").cogroup(near.groupBy("cell")).applyInArrow(_in_order(radius_m), schema)
        if claims is not None:
            asked = asked.unionByName(claims.drop("place").join(asking, "cell", "left_anti"))
        last, claims = claims, materialize(asked.withColumn("place", F.row_number().over(Window.partitionBy("nid").orderBy("ord", "sid"))))
        if last is not None:
            discard(s.sparkSession, last)
        asking = claims.where("place > 1").select("cell").distinct()
        if asking.isEmpty():  # every claim is the first of its node
            discard(s.sparkSession, s, n)
            return claims.select("sid", "nid", "distance_m")


def zones(nodes: DataFrame, stations: DataFrame, radius_m: float = 300.0) -> DataFrame:
    return nearest_within(nodes, "nid", "lat", "lon", stations, "sid", "lat", "lon", radius_m)  # J10


def track_segments(pairs: DataFrame, lines: DataFrame, snap_m: float) -> DataFrame:
    """For each stop pair the cut of the polyline whose worse snap is smallest (J17, F8). ``pairs``: line_id, a, b (structs lon, lat), pid; ``lines``: line_id, ord, poly."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pid, order, a, b, poly in zip(f["pid"], f["ord"], f["a"], f["b"], f["poly"]):
                xy = polyline.to_m([(p["lon"], p["lat"]) for p in poly])
                if len(xy) < 2:
                    continue
                ends = polyline.to_m([(a["lon"], a["lat"]), (b["lon"], b["lat"])])
                _, _, d = polyline.project(xy, ends)
                if d.max() <= snap_m:
                    part = polyline.to_deg(polyline.between(xy, ends[0], ends[1]))
                    out.append((pid, order, float(d.max()), [{"lon": x, "lat": y} for x, y in part]))
            yield pd.DataFrame(out, columns=["pid", "ord", "worst_m", "poly"])

    found = pairs.join(lines, "line_id").select("pid", "ord", "a", "b", "poly").mapInPandas(cut, f"pid {pairs.schema['pid'].dataType.simpleString()}, ord long, worst_m double, poly array<struct<lon:double,lat:double>>")
    return found.groupBy("pid").agg(F.min_by(F.struct("worst_m", "poly"), F.struct("worst_m", "ord")).alias("r")).select("pid", "r.*")


def station_of_stop(stops: DataFrame, members: DataFrame, stations: DataFrame) -> DataFrame:
    """Station of each stop: by membership in its area, else the first of the same lower-cased name (J18). ``stops``: stop_id, name; ``members``: stop_id, station_id; ``stations``: station_id, name, ord."""
    by_name = stations.groupBy(F.lower("name").alias("_n")).agg(F.min_by("station_id", "ord").alias("_by_name"))
    area = members.groupBy("stop_id").agg(F.min("station_id").alias("_by_area"))
    return stops.join(area, "stop_id", "left").join(by_name, F.lower("name") == F.col("_n"), "left").select("stop_id", F.coalesce("_by_area", "_by_name").alias("station_id"))


def distinct_lines(lines: DataFrame, poly: str) -> DataFrame:
    """One of the polylines with equal first and last point and number of points."""
    key = F.struct(F.get(poly, F.lit(0)), F.element_at(poly, -1), F.size(poly))
    return lines.withColumn("_k", F.to_json(key)).dropDuplicates(["_k"]).drop("_k")


def unused_ways(ways: DataFrame, taken: DataFrame, way_id: str, order: str) -> DataFrame:
    """Ways by id, the last of equal ones, without those already taken."""
    rest = [c for c in ways.columns if c != way_id]
    last = ways.groupBy(way_id).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(way_id, "_r.*")
    return last.join(taken.select(way_id), way_id, "left_anti")


def stitch(ways: list[list[tuple[float, float]]], gap_m: float = 1.0) -> list[list[tuple[float, float]]]:
    """Join ways end to end while ends meet within ``gap_m``, reversing where needed (G4). Ways of one line; greedy in their order."""
    left = [list(w) for w in ways if len(w) > 1]
    out = []
    while left:
        chain = left.pop(0)
        grown = True
        while grown:
            grown = False
            for i, w in enumerate(left):
                head, tail = polyline.to_m([chain[0]])[0], polyline.to_m([chain[-1]])[0]
                a, b = polyline.to_m([w[0]])[0], polyline.to_m([w[-1]])[0]
                near = lambda p, q: np.hypot(*(p - q)) <= gap_m
                if near(tail, a):
                    chain = chain + w[1:]
                elif near(tail, b):
                    chain = chain + w[::-1][1:]
                elif near(head, b):
                    chain = w[:-1] + chain
                elif near(head, a):
                    chain = w[::-1][:-1] + chain
                else:
                    continue
                left.pop(i)
                grown = True
                break
        out.append(chain)
    return out


def stitched(ways: DataFrame) -> DataFrame:
    """Chains of each line's ways (G4): ``line_id, chain, poly``. A line's ways, a few hundred by nature, are one group."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ord", kind="stable")
        chains = stitch([[(p["lon"], p["lat"]) for p in w] for w in f["poly"]])
        return pd.DataFrame([(key[0], n, [{"lon": x, "lat": y} for x, y in c]) for n, c in enumerate(chains)], columns=["line_id", "chain", "poly"])

    return ways.groupBy("line_id").applyInPandas(run, "line_id string, chain int, poly array<struct<lon:double,lat:double>>")


def station_neighbours(segments: DataFrame, zone: DataFrame, most_m: float = 25_000.0, ratio: float = 3.0, most_segments: int = 500_000) -> DataFrame:
    """Neighbouring stations on a track graph (G2): ``a, b, len_m``. A search from a station's nodes goes on until it enters another station's zone, where it stops.

    ``segments``: a, b, len_m, poly over nodes; ``zone``: nid, sid, lat, lon of the station. Paths longer than ``ratio`` times the straight line are left out.
    """
    if segments.limit(most_segments + 1).count() > most_segments:
        raise ValueError(f"more than {most_segments} segments")
    if zone.limit(most_segments + 1).count() > most_segments:
        raise ValueError(f"more than {most_segments} nodes in zones")
    rows = [r.asDict(recursive=True) for r in segments.select("a", "b", "len_m").collect()]
    homes = {r.nid: (r.sid, r.lat, r.lon) for r in zone.select("nid", "sid", "lat", "lon").collect()}
    shared = segments.sparkSession.sparkContext.broadcast((rows, homes))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        edges, home = shared.value
        near = _neighbours(edges)
        for f in frames:
            out = {}
            for sid in f["sid"]:
                heap = [(0.0, n) for n, h in home.items() if h[0] == sid]
                seen = set()
                while heap:
                    d, n = heapq.heappop(heap)
                    if n in seen or d > most_m:
                        continue
                    seen.add(n)
                    other = home.get(n)
                    if other and other[0] != sid:
                        key = (min(sid, other[0]), max(sid, other[0]))
                        out[key] = min(d, out.get(key, d))
                        continue  # absorbed
                    for m, length, _, _ in near.get(n, ()):
                        heapq.heappush(heap, (d + length, m))
            at = {h[0]: h[1:] for h in home.values()}
            rows = []
            for (a, b), d in out.items():
                straight = float(np.hypot(*(polyline.to_m([(at[a][1], at[a][0])]) - polyline.to_m([(at[b][1], at[b][0])]))[0]))
                if d <= ratio * max(straight, 1.0):
                    rows.append((a, b, d))
            yield pd.DataFrame(rows, columns=["a", "b", "len_m"])

    found = zone.select("sid").distinct().mapInPandas(search, "a string, b string, len_m double")
    return found.groupBy("a", "b").agg(F.min("len_m").alias("len_m"))


def ordered_stitch(ways: list[list[tuple[float, float]]], most_gap_m: float = 250.0) -> list[list[tuple[float, float]]]:
    """Ways of a relation in its order (G4): each turned so that it goes on from the line so far; where a gap is too wide a new line begins."""
    out: list[list[tuple[float, float]]] = []
    far = lambda p, q: float(np.hypot(*(polyline.to_m([p]) - polyline.to_m([q]))[0]))
    for n, way in enumerate(w for w in ways if len(w) > 1):
        if not out:
            following = next((w for w in ways[n + 1 :] if len(w) > 1), None)
            ends = [following[0], following[-1]] if following else []
            turned = bool(ends) and min(far(way[0], e) for e in ends) < min(far(way[-1], e) for e in ends)
            out.append(way[::-1] if turned else list(way))
            continue
        tail = out[-1][-1]
        near = way if far(tail, way[0]) <= far(tail, way[-1]) else way[::-1]
        gap = far(tail, near[0])
        if gap > most_gap_m:
            out.append(list(near))
        else:
            out[-1] += near[1:] if gap < 1e-6 else near
    return out


def chains_of(segments: list[tuple[str, str, list[tuple[float, float]]]]) -> list[list[tuple[float, float]]]:
    """Lines through nodes where exactly two segments meet (G4); they end at junctions and dead ends."""
    at: dict[str, list[int]] = {}
    for n, (a, b, _) in enumerate(segments):
        at.setdefault(a, []).append(n)
        at.setdefault(b, []).append(n)
    used: set[int] = set()

    def walk(node: str, n: int) -> list[tuple[float, float]]:
        line: list[tuple[float, float]] = []
        while n not in used:
            used.add(n)
            a, b, pts = segments[n]
            pts, node = (pts, b) if node == a else (pts[::-1], a)
            line += pts if not line else pts[1:]
            if len(at[node]) == 2:
                n = next((m for m in at[node] if m not in used), n)
        return line

    out = [walk(node, n) for node in at if len(at[node]) != 2 for n in at[node] if n not in used]
    return out + [walk(segments[n][0], n) for n in range(len(segments)) if n not in used]  # rings


def graph_segments(pairs: DataFrame, segments: DataFrame, nodes: DataFrame, snap_m: float = 500.0, penalty: float = 3.0, most_m: float = 60_000.0, most_segments: int = 200_000) -> DataFrame:
    """Path between two places over a track graph (G3): ``pid, cost_m, len_m, poly``, of all nodes within ``snap_m`` the ones with the least length plus ``penalty`` times the snaps.

    ``pairs``: pid, a_lon, a_lat, b_lon, b_lat. ``segments``: a, b, len_m, poly; ``nodes``: nid, lon, lat. One search per pair starts from all snapped nodes at once. The graph is
    checked to be small before it is sent to the searching tasks. Pairs without a path have no row.
    """
    if segments.limit(most_segments + 1).count() > most_segments:
        raise ValueError(f"more than {most_segments} segments")
    rows = [r.asDict(recursive=True) for r in segments.where("a is not null and b is not null and len_m >= 0").select("a", "b", "len_m", "poly").collect()]
    shared = segments.sparkSession.sparkContext.broadcast(rows)
    snaps = []
    for side in ("a", "b"):
        near = within_distance(pairs, "pid", f"{side}_lat", f"{side}_lon", nodes, "nid", "lat", "lon", snap_m)
        snaps.append(near.groupBy("pid").agg(F.collect_list(F.struct("nid", "distance_m")).alias(side)))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        edges = shared.value
        near = _neighbours(edges)
        for f in frames:
            out = []
            for pid, starts, ends in zip(f["pid"], f["a"], f["b"]):
                goal = {e["nid"]: penalty * e["distance_m"] for e in ends}
                cost = {s["nid"]: penalty * s["distance_m"] for s in starts}
                heap = [(c, n) for n, c in cost.items()]
                heapq.heapify(heap)
                back: dict[str, tuple[str, int, bool]] = {}
                done, best, end = set(), float("inf"), None
                while heap:
                    c, n = heapq.heappop(heap)
                    if n in done:
                        continue
                    if c > min(best, most_m):
                        break
                    done.add(n)
                    if n in goal and c + goal[n] < best:
                        best, end = c + goal[n], n
                    for m, length, k, forward in near.get(n, ()):
                        if c + length < cost.get(m, float("inf")):
                            cost[m], back[m] = c + length, (n, k, forward)
                            heapq.heappush(heap, (c + length, m))
                if end is None:
                    continue
                line, at, length = [], end, 0.0
                while at in back:
                    at, k, forward = back[at]
                    pts = edges[k]["poly"] if forward else edges[k]["poly"][::-1]
                    line = pts + line[1:] if line else list(pts)
                    length += edges[k]["len_m"]
                out.append((pid, best, length, line))
            yield pd.DataFrame(out, columns=["pid", "cost_m", "len_m", "poly"])

    kind = pairs.schema["pid"].dataType.simpleString()
    return snaps[0].join(snaps[1], "pid").mapInPandas(search, f"pid {kind}, cost_m double, len_m double, poly array<struct<lon:double,lat:double>>")


def snap_penalised(candidates: DataFrame, penalty: float = 3.0) -> DataFrame:
    """Of the paths between a pair's candidate nodes the one with the least length plus three times the snaps (G3). ``candidates``: pid, len_m, snap_a_m, snap_b_m, poly."""
    cost = F.col("len_m") + penalty * (F.col("snap_a_m") + F.col("snap_b_m"))
    return candidates.groupBy("pid").agg(F.min_by(F.struct("len_m", "poly"), F.struct(cost.alias("c"), "len_m")).alias("r")).select("pid", "r.*")


def baked_geometry(pairs: DataFrame, strict: DataFrame, relaxed: DataFrame, graph: DataFrame, existing: DataFrame) -> DataFrame:
    """Geometry of each pair: cut at a close snap, else at a wide one, else the graph's path, else what there was (G6). All have pid, poly."""
    out = pairs.select("pid")
    for name, part in (("strict", strict), ("relaxed", relaxed), ("graph", graph), ("existing", existing)):
        out = out.join(part.select("pid", F.col("poly").alias(name)), "pid", "left")
    source = F.when(F.col("strict").isNotNull(), "strict").when(F.col("relaxed").isNotNull(), "relaxed").when(F.col("graph").isNotNull(), "graph").when(F.col("existing").isNotNull(), "existing")
    return out.select("pid", F.coalesce("strict", "relaxed", "graph", "existing").alias("poly"), source.alias("source"))


def run_times(samples: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Upper median run time per stop pair, implausible samples ignored (A8). Exact for any group size: ranks come from counts per second, at most 1,800 rows per pair."""
    good = samples.where((F.col(seconds) > 0) & (F.col(seconds) <= 1800))
    hist = good.groupBy(*keys, seconds).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    cum = hist.withColumn("upto", F.sum("c").over(w.orderBy(seconds))).withColumn("n", F.sum("c").over(w))
    return cum.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.floor(F.min(seconds) + 0.5).cast("long").alias("run_time_s"), F.max("n").alias("samples"))
