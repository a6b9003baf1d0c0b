"""Stops and trips from location pings (problem 7).

SQL windows give each fix its lagged distance and silence and its speed over the length of a stop. Two bounds act as hysteresis: a step of more than twice the
stop radius leaves any stop, whatever its median, so it starts a new island, and a stop can begin only where the source then is slow. Islands are the gaps-and-islands
segments, also bounded by silence; inside them stretches are held against the radius itself, grown both ways and merged where they form one, and what lies
between stops is aggregated to trips.

Windows run over (source, chunk); what a chunk needs from earlier ones comes from one summary row per chunk, so no task sees a whole source. Islands are
numbered over chunk bounds, so these don't show in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.series import EARTH_M, floor_div, group_starts, haversine, map_whole_groups
from ferrywake.operators.spikes import Profile, flagged_readings
from ferrywake.session import materialize

CHUNK_S = 7 * 86_400


def lag_across(df: DataFrame, keys: list[str], chunk: str, order: list[str], carried: list[str], prefix: str = "prev_") -> DataFrame:
    """``carried`` columns of the previous row of the same key, also over chunk bounds, as ``prefix + name``.

    Inside a chunk this is a window; the first row of a chunk takes the last row of the key's previous chunk from a summary
    with one row per (key, chunk), the only thing that is windowed over a whole key.
    """
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    row = F.struct(*carried)
    ends = df.groupBy(*keys, chunk).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    before = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy(chunk))).select(*keys, chunk, "_carry")
    out = df.withColumn("_own", F.lag(row).over(w)).join(before, [*keys, chunk], "left").withColumn("_before", F.coalesce("_own", "_carry"))
    return out.select(*df.columns, *[F.col("_before").getField(c).alias(prefix + c) for c in carried])


def running_across(df: DataFrame, keys: list[str], chunk: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running sums of ``values`` per key in ``order``, over chunk bounds, from sums per chunk."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*keys, chunk, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    out = df.select("*", *[F.sum(v).over(w).alias(f"_r_{n}") for n, v in values.items()]).join(offset, [*keys, chunk])
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def fitting_starts(x: np.ndarray, y: np.ndarray, first: np.ndarray, reach: np.ndarray, radius: float, block: int = 1_000_000) -> np.ndarray:
    """Which stretches ``first[i]..reach[i]`` lie within ``radius`` of their median, all those of one length at a time."""
    ok = np.zeros(len(first), bool)
    length = reach - first + 1
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        step = max(1, block // int(size))
        for b in range(0, len(rows), step):
            at = first[rows[b : b + step], None] + np.arange(size)
            dx, dy = x[at], y[at]
            dx, dy = dx - np.median(dx, axis=1, keepdims=True), dy - np.median(dy, axis=1, keepdims=True)
            ok[rows[b : b + step]] = (dx * dx + dy * dy).max(axis=1) <= radius * radius
    return ok


def _middle(v: list[float]) -> float:
    s, h = sorted(v), len(v) // 2
    return s[h] if len(v) % 2 else (s[h - 1] + s[h]) / 2


def grown(x: np.ndarray, y: np.ndarray, lo: int, hi: int, starts: list[int], reach: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Longest stretches (inclusive, in lo..hi) around the fitting ones that begin at ``starts``, in order and without overlap."""
    r2 = radius * radius

    def fits(i: int, j: int) -> bool:
        if j - i < 60:
            a, b = x[i : j + 1].tolist(), y[i : j + 1].tolist()
            ma, mb = _middle(a), _middle(b)
            return all((p - ma) * (p - ma) + (q - mb) * (q - mb) <= r2 for p, q in zip(a, b))
        da, db = x[i : j + 1], y[i : j + 1]
        da, db = da - np.median(da), db - np.median(db)
        return bool((da * da + db * db).max() <= r2)

    def moved(i: int, j: int, way: int, most: int) -> int:
        """How far the end (``way`` 1) or the start (-1) of a fitting stretch goes, by galloping and bisection."""
        far, step, growing = 0, 1, True
        while step:
            try_ = far + step
            if try_ <= most and (fits(i, j + try_) if way > 0 else fits(i - try_, j)):
                far = try_
                if growing:
                    step *= 2
            else:
                growing = False
                step //= 2
        return far

    out: list[tuple[int, int]] = []
    for i in starts:
        if out and i <= out[-1][1]:
            continue
        j = int(reach[i])
        while True:
            j += moved(i, j, 1, hi - j)
            taken = out[-1][1] if out else lo - 1
            back = moved(i, j, -1, i - taken - 1)
            i -= back
            if not back:
                if not out or out[-1][1] < i - 1 or not fits(out[-1][0], j):
                    break
                i = out.pop()[0]  # both are one stop, which may reach farther
        out.append((i, j))
    return out


def stop_stretches(us: np.ndarray, x: np.ndarray, y: np.ndarray, begin: np.ndarray, rests: np.ndarray, radius: float, least_us: int) -> list[tuple[int, int]]:
    """Index ranges (inclusive) of longest stretches that lie within ``radius`` of their median and span ``least_us``.

    Rows are islands one after the other, each from a row of ``begin`` on and in order of ``us``; a stretch starts on a row of ``rests``. ``x``/``y`` metres.
    """
    n = len(us)
    end = np.concatenate((begin[1:], [n]))
    island = np.repeat(np.arange(len(begin)), end - begin)
    since = us - us[begin][island]
    stride = int(since.max()) + least_us + 1 if n else 1
    if stride * len(begin) < 2**62:
        line = island * stride + since
        reach = np.searchsorted(line, line + least_us)
    else:
        reach = np.concatenate([b + np.searchsorted(us[b:e], us[b:e] + least_us) for b, e in zip(begin, end)])
    first = np.flatnonzero((reach < end[island]) & rests)
    first = first[fitting_starts(x, y, first, reach[first], radius)]
    out: list[tuple[int, int]] = []
    cuts = np.flatnonzero(np.diff(island[first])) + 1
    for part in np.split(first, cuts):
        if len(part):
            g = island[part[0]]
            out += grown(x, y, int(begin[g]), int(end[g]) - 1, part.tolist(), reach, radius)
    return out


def stops_and_trips(
    fixes: DataFrame, key: str, us: Column, lat: Column, lon: Column, profile: Profile, radius_m: float = 60.0, least_stop_s: int = 300, silence_s: int = 1800, chunk_s: int = CHUNK_S
) -> DataFrame:
    """Stops and trips of each source: ``key, kind, start_us, end_us, duration_s, n_fixes, distance_m, lat, lon``.

    Fixes with a null key, time or coordinate or an impossible longitude don't count; of copies (equal key and time) one counts, the most plausible row as it
    stands, and fixes with an implausible latitude (see `spikes`, with ``profile``) not at all. ``lat``/``lon`` is the median place of a stop,
    null for a trip; ``n_fixes`` counts both ends. The result doesn't depend on ``chunk_s``. An empty table gives no rows; other columns are ignored.
    """
    base = fixes.select(F.col(key).cast("string").alias("k"), us.alias("us"), lat.cast("double").alias("x"), lon.cast("double").alias("c"))
    series = base.where("k is not null and us is not null and x is not null and c between -180 and 180").groupBy("k", "us", "x").agg(F.min("c").alias("c"))
    good = flagged_readings(series, profile, companion=True, best_of_time=True).drop("code")
    chunk_us, least_us, silence_us = chunk_s * 1_000_000, least_stop_s * 1_000_000, silence_s * 1_000_000

    # lagged distance, silence and speeds, all in one pass over (source, chunk)
    w = Window.partitionBy("k", "chunk").orderBy("us")
    ahead = F.first(F.struct("us", "x", "c")).over(w.rangeBetween(least_us, least_us + silence_us))
    seen = good.withColumn("chunk", floor_div(F.col("us"), chunk_us)).select("k", "chunk", "us", "x", "c", F.lag("us").over(w).alias("p_us"), F.lag("x").over(w).alias("p_x"), F.lag("c").over(w).alias("p_c"), ahead.alias("next"))
    step = haversine(F.col("p_x"), F.col("p_c"), F.col("x"), F.col("c"))
    net_ms = haversine(F.col("x"), F.col("c"), F.col("next.x"), F.col("next.c")) / ((F.col("next.us") - F.col("us")) / 1e6)
    moved = seen.select("k", "chunk", "us", "x", "c", (F.col("us") - F.col("p_us") > silence_us).alias("silent"), step.alias("step"), net_ms.alias("net_ms"))
    # hysteresis: a step of two radii leaves any stop; only a fix from which the source is slow for the length of a stop can begin one
    leaves = F.col("silent") | (F.col("step") > 2 * radius_m)
    rests = F.coalesce(F.col("net_ms") <= 2 * radius_m / least_stop_s, F.col("us") >= (F.col("chunk") + 1) * F.lit(chunk_us) - F.lit(least_us + silence_us))
    judged = moved.select("k", "chunk", "us", "x", "c", rests.alias("rests"), leaves.alias("cut"), F.coalesce("silent", F.lit(False)).cast("long").alias("silent"), F.when(F.col("silent"), 0.0).otherwise(F.coalesce("step", F.lit(0.0))).alias("step"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = materialize(
        judged.select(
            "k", "chunk", "us", "x", "c", "rests", (F.coalesce("cut", F.lit(False)) & F.coalesce(F.lead("cut").over(w), F.lit(False))).alias("alone"), F.row_number().over(w).cast("long").alias("seq"),
            F.sum("step").over(so_far).alias("path"), F.sum(F.coalesce("cut", F.lit(False)).cast("long")).over(so_far).alias("island"), F.sum("silent").over(so_far).alias("spell"),
        )
    )

    # what a chunk needs from earlier ones: one row per (source, chunk), the only thing windowed over a whole source
    ends = inner.groupBy("k", "chunk").agg(F.min_by(F.struct("us", "x", "c"), "us").alias("head"), F.max_by(F.struct("us", "x", "c", "path", "seq", "island", "spell"), "us").alias("tail"))
    by_chunk = Window.partitionBy("k").orderBy("chunk")
    linked = ends.select("k", "chunk", "head", F.lag("tail").over(by_chunk).alias("t"))
    gap = haversine(F.col("t.x"), F.col("t.c"), F.col("head.x"), F.col("head.c"))
    parted = F.coalesce(F.col("head.us") - F.col("t.us") > silence_us, F.lit(True))
    upto = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    add = lambda name, own: F.sum(F.coalesce(f"t.{name}", F.lit(0)) + own).over(upto).alias(f"{name}_0")
    offsets = materialize(linked.select("k", "chunk", add("path", F.when(parted, 0.0).otherwise(gap)), add("seq", F.lit(0)), add("island", (parted | (gap > 2 * radius_m)).cast("long")), add("spell", parted.cast("long"))))

    whole = lambda name: (F.col(name) + F.col(f"{name}_0")).alias(name)
    members = inner.where("not alone").join(offsets, ["k", "chunk"]).select("k", whole("island"), "us", "x", "c", "rests", whole("path"), whole("seq"), whole("spell"))

    def find(t: pa.Table) -> pa.Table | None:
        begin = np.flatnonzero(group_starts(t, ["k", "island"]))
        end = np.concatenate((begin[1:], [t.num_rows]))
        a, o = t.column("x").to_numpy(), t.column("c").to_numpy()
        metre = np.pi / 180 * EARTH_M
        scale = np.repeat(np.cos(np.radians(a[begin])), end - begin)
        found = stop_stretches(t.column("us").to_numpy(), o * metre * scale, a * metre, begin, t.column("rests").to_numpy(zero_copy_only=False), radius_m, least_us)
        if not found:
            return None
        i, j = (pa.array(v) for v in zip(*found))
        f, g = t.take(i), t.take(j)
        middle = [(float(np.median(a[b : e + 1])), float(np.median(o[b : e + 1]))) for b, e in found]
        return pa.table({"k": f.column("k"), "spell": f.column("spell"), **{f"{side}_{c}": u.column(c) for side, u in (("start", f), ("end", g)) for c in ("us", "path", "seq")}, "lat": pa.array([m[0] for m in middle]), "lon": pa.array([m[1] for m in middle])})

    # an island is one uninterrupted rest of one source (or less), and goes to the search as a whole wherever chunk bounds lie
    schema = "k string, spell long, start_us long, start_path double, start_seq long, end_us long, end_path double, end_seq long, lat double, lon double"
    stops = materialize(map_whole_groups(members, ["k", "island"], ["us"], find, schema))

    # trips lie between the start of a spell or the end of a stop and the next start of a stop or the end of the spell
    edge = F.struct("us", "path", "seq")
    parts = inner.groupBy("k", "chunk", "spell").agg(F.min_by(edge, "us").alias("a"), F.max_by(edge, "us").alias("b")).join(offsets, ["k", "chunk"])
    shifted = lambda c: F.struct(F.col(f"{c}.us").alias("us"), (F.col(f"{c}.path") + F.col("path_0")).alias("path"), (F.col(f"{c}.seq") + F.col("seq_0")).alias("seq")).alias(c)
    spells = parts.select("k", whole("spell"), shifted("a"), shifted("b")).groupBy("k", "spell").agg(F.min_by("a", "a.us").alias("a"), F.max_by("b", "b.us").alias("b"))
    mark = lambda n, f, g: F.struct(F.lit(n).alias("kind"), f.alias("from"), g.alias("to"))
    of_stop = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("us", "path", "seq")])
    bounds = spells.select("k", "spell", F.explode(F.array(mark(0, F.col("a"), F.col("a")), mark(2, F.col("b"), F.col("b")))).alias("m"))
    marks = bounds.unionByName(stops.select("k", "spell", mark(1, of_stop("start"), of_stop("end")).alias("m"))).select("k", "spell", "m.*")
    in_spell = Window.partitionBy("k", "spell").orderBy("from.us", "kind")
    steps = marks.withColumn("last", F.lag("to").over(in_spell))
    columns = lambda kind, a, b: ["k", F.lit(kind).alias("kind"), F.col(f"{a}us").alias("start_us"), F.col(f"{b}us").alias("end_us"), (F.col(f"{b}seq") - F.col(f"{a}seq") + 1).alias("n_fixes"), (F.col(f"{b}path") - F.col(f"{a}path")).alias("distance_m")]
    trips = steps.where(F.col("from.us") > F.col("last.us")).select(*columns("trip", "last.", "from."), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    rests_ = stops.select(*columns("stop", "start_", "end_"), "lat", "lon")
    return trips.unionByName(rests_).select(
        F.col("k").alias(key), "kind", "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.col("n_fixes").cast("long").alias("n_fixes"), "distance_m", "lat", "lon"
    )
