"""Implausible values in measurements (problem 5): phase-space thresholding, zero-difference runs and bounds.

Each source's series is seen in phase space: how far a value is off its course (``u``, against the
running median), its first differences and its second differences. Robust ellipsoids (axes from
quantiles of the source's own values, with a floor for sources that hardly move) part the normal cloud from what
is outside; a value outside the ellipsoid that is itself off the course is taken out, the differences are
formed anew over what is left, and so on until nothing more falls. Values stuck while the source moves
on show as runs of zero differences that are too long for the source; impossible values as out of bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ferrywake.operators.series import group_starts, map_whole_groups, with_halo
from ferrywake.session import materialize


@dataclass(frozen=True)
class Profile:
    """What is physically possible and how a kind of series moves; everything else is learned per source.

    ``low``/``high`` bounds; ``step_floor`` least axis of first differences (per second if ``per_second``, else per
    reading); ``value_floor`` least axis of the value; ``least_dt`` seconds below which differences aren't scaled further;
    ``gap_s`` silence that ends a spell; ``rest`` value up to which a source counts as resting; ``companion_move`` how
    far the companion coordinate must have moved to show that the source moves on; ``chunk_s``/``halo_s`` how the series is cut.
    """

    low: float
    high: float
    step_floor: float
    value_floor: float
    per_second: bool = True
    least_dt: float = 10.0
    gap_s: float = 1800.0
    rest: float | None = None
    companion_move: float | None = None
    chunk_s: int = 7 * 86_400
    halo_s: int = 7_200


#: Latitude of road vehicles in degrees: 16 m/s northwards and 1.5 km are the least axes.
BUS_LAT = Profile(low=-90.0, high=90.0, step_floor=16 / 111_195, value_floor=1_500 / 111_195, companion_move=20 / 69_000, halo_s=3_600)
#: Speed over ground in knots; 102.3 and more stand for "not available" in AIS and can't be speeds.
VESSEL_SOG = Profile(low=0.0, high=102.2, step_floor=3.0, value_floor=3.0, per_second=False, rest=1.0, halo_s=7_200)
#: Water level in metres.
TIDE_LEVEL = Profile(low=-50.0, high=50.0, step_floor=0.3 / 900, value_floor=0.25, least_dt=300.0, gap_s=3 * 3_600.0, chunk_s=14 * 86_400, halo_s=2 * 86_400)

WINDOW = 11
LONG_RUN = 6
ALL_THREE = 3**0.5


def running_median(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Median of the ``window`` values around each value; at the ends of those there are."""
    n, h = len(x), window // 2
    if n <= window:
        return np.full(n, np.median(x)) if n else x
    out = np.empty(n)
    out[h : n - h] = np.median(np.lib.stride_tricks.sliding_window_view(x, window), axis=1)
    for i in range(h):
        out[i] = np.median(x[: i + h + 1])
        out[n - 1 - i] = np.median(x[n - 1 - i - h :])
    return out


def _scale(v: np.ndarray) -> float:
    """Robust standard deviation of differences: from the 95 % quantile, as most sources rest half of the time."""
    return float(np.quantile(v, 0.95)) / 1.96 if len(v) else 0.0


def _joint_excursions(u: np.ndarray, rates: np.ndarray, dx: np.ndarray, silent: np.ndarray, a: float, b: float, lam: float) -> np.ndarray:
    """Rows of excursions that lie outside the ellipsoid with axes ``a``, ``b`` and ``2 b`` by all three coordinates together.

    An excursion of up to half a window leaves the course on one side and comes back. At least half of its value is made by either step, and
    most of the steps by its value, and the steps are half of what the ellipsoid allows; else it is a turn of the course, a change of level or the
    true neighbour of a spike. The coordinates rise together, so the ellipsoid is widened until the source's own cloud lies inside.
    """
    m = len(u)
    out = np.zeros(m, bool)
    s = np.abs(rates)
    if not (s > 0.5 * b).any():  # the steps are too small whatever the value
        return out
    d1 = np.maximum(np.concatenate(([0.0], s)), np.concatenate((s, [0.0])))
    d2 = np.abs(np.diff(np.concatenate(([0.0], rates, [0.0]))))
    radius = max(1.0, lam * _scale(np.sqrt((u / a) ** 2 + (d1 / b) ** 2 + (d2 / (2 * b)) ** 2)))
    gaps = np.concatenate(([0], np.cumsum(silent)))
    large = s > 0.5 * radius * b
    for size in range(1, WINDOW // 2 + 1):
        if m < size + 2:
            break
        # both steps are seen, and one of them is large
        first = np.flatnonzero((large[:-size] | large[size:]) & (rates[:-size] * rates[size:] < 0)) + 1
        if not len(first):
            continue
        side = np.sign(u[first])
        inside = np.lib.stride_tricks.sliding_window_view(u, size)[first] * side[:, None]
        low, high = inside.min(axis=1), inside.max(axis=1)
        come, back = side * dx[first - 1], -side * dx[first + size - 1]
        r1, r2 = side * rates[first - 1], -side * rates[first + size - 1]
        steps2 = (np.maximum(r1, r2) / b) ** 2 + ((r1 + r2) / (2 * b)) ** 2
        own = (low > 0) & (np.minimum(come, back) >= 0.5 * high) & (low >= 0.4 * np.maximum(come, back)) & (gaps[first - 1] == gaps[first + size])
        for i in first[own & (steps2 > 0.5 * radius * radius) & (steps2 + (low / a) ** 2 > radius * radius)]:
            out[i : i + size] = True
    return out


def off_course(t: np.ndarray, x: np.ndarray, p: Profile, skip: np.ndarray) -> np.ndarray:
    """Values outside the robust ellipsoids in phase space, found iteratively; ``t`` in seconds, increasing; ``skip`` marks rows already taken out."""
    bad = skip.copy()
    while True:  # every pass takes rows out
        keep = np.flatnonzero(~bad)
        m = len(keep)
        if m < 3:
            break
        ts, xs = t[keep], x[keep]
        dt = np.diff(ts)
        dx = np.diff(xs)
        step = np.abs(dx) / np.maximum(dt, p.least_dt) if p.per_second else np.abs(dx)
        silent = dt > p.gap_s
        lam = np.sqrt(2 * np.log(max(m, 8)))
        if p.rest is None:
            b = max(lam * _scale(step), p.step_floor)
        else:
            # held values are real, only old, so they tell the source's usual level too
            real = x[(x >= p.low) & (x <= p.high) & (skip | ~bad)]
            active = np.abs(real[np.abs(real) > p.rest])
            level = np.quantile(active, 0.75) if len(active) >= 10 and len(active) > 0.02 * m else 8.0
            b = max(1.35 * level, p.step_floor)
        jump = (step > b) & ~silent
        # an axis that isn't the source's own spread is what one coordinate alone may reach, which a lone reading does in all three at once
        wide_b = max(b if p.rest is None else lam * _scale(step), ALL_THREE * (p.step_floor if p.rest is None else b))
        if not jump.any() and not ((step > 0.5 * wide_b) & ~silent).any():
            break
        spell = np.concatenate(([0], np.cumsum(silent)))
        u = np.empty(m)
        bounds = np.flatnonzero(np.diff(spell)) + 1
        wide = None
        for s, e in zip(np.concatenate(([0], bounds)), np.concatenate((bounds, [m]))):
            if e - s >= 3:
                u[s:e] = xs[s:e] - running_median(xs[s:e])
            else:
                if wide is None:
                    wide = running_median(xs)
                u[s:e] = xs[s:e] - wide[s:e]
        au = np.abs(u)
        a = max(lam * _scale(au), p.value_floor) if p.rest is None else b
        a = min(a, 4 * p.value_floor) if p.rest is None else a
        rates = np.where(silent, 0.0, np.sign(dx) * step)
        joint = _joint_excursions(u, rates, dx, silent, max(lam * _scale(au), ALL_THREE * (p.value_floor if p.rest is None else a)), wide_b, lam)
        # beyond the ellipsoid by its value and a step each alone: all that can be told where only one side is seen
        seg = np.concatenate(([0], np.cumsum(jump | silent)))
        n_seg = seg[-1] + 1
        beside = np.concatenate(([False], jump)) | np.concatenate((jump, [False]))
        brief = np.bincount(seg, minlength=n_seg) <= WINDOW // 2  # longer than that and it is the course
        hit = joint | (au > a) & (brief & (np.bincount(seg, beside, n_seg) > 0))[seg]
        if not hit.any():
            break
        # an excursion found jointly is a segment of its own
        seg = np.concatenate(([0], np.cumsum(jump | silent | (joint[1:] != joint[:-1]))))
        n_seg = seg[-1] + 1
        # within an iteration only the farthest of neighbouring segments goes, the others are judged anew
        far = np.zeros(n_seg)
        np.maximum.at(far, seg[hit], au[hit])
        left, right = np.concatenate(([0.0], far[:-1])), np.concatenate((far[1:], [0.0]))
        go = (far > 0) & (far >= left) & (far >= right)
        bad[keep[hit & go[seg]]] = True
    return bad & ~skip


def stuck(t: np.ndarray, x: np.ndarray, companion: np.ndarray | None, p: Profile) -> np.ndarray:
    """Rows held at an old value while the source moves on; the first row of a held stretch is true."""
    n = len(x)
    out = np.zeros(n, bool)
    if n < 3:
        return out
    equal = np.concatenate(([False], x[1:] == x[:-1]))
    if not equal.any():
        return out
    run = np.cumsum(~equal) - 1
    length = np.bincount(run)
    first = np.flatnonzero(~equal)
    if companion is not None:
        move = np.nan_to_num(np.concatenate(([0.0], np.abs(np.diff(companion)))))
        moving = equal & (move > p.companion_move)
        steps = np.bincount(run, moving, len(length))
        total = np.bincount(run, np.where(equal, move, 0.0), len(length))
        for r in np.flatnonzero((steps >= 3) & (total > 5 * p.companion_move)):
            s, e = first[r], first[r] + length[r]
            out[s + int(np.argmax(moving[s:e])) : e] = True
        return out
    active = np.ones(n, bool) if p.rest is None else np.abs(x) > p.rest
    pairs = active & np.concatenate(([False], active[:-1]))
    short = length[run] < LONG_RUN
    seen, same = np.count_nonzero(pairs & short), np.count_nonzero(pairs & equal & short)
    share = (same + 1) / (seen + 3)
    steps = np.abs(np.diff(x))
    positive = steps[steps > 0]
    if not len(positive):
        return out
    fine = np.quantile(positive, 0.05)
    usual = np.quantile(steps[~equal[1:]], 0.95) if (~equal[1:]).any() else 0.0
    for r in np.flatnonzero(length >= LONG_RUN):
        s, e = first[r], first[r] + length[r]
        k = int(length[r])
        if not active[s]:
            continue
        lagged = np.abs(x[k:] - x[:-k]) if n > 2 * k else steps
        moves = np.median(lagged) if len(lagged) else 0.0
        rare = share < 0.3 and k * np.log(1 / share) > 14 and moves >= fine
        release = max(abs(x[e] - x[s]) if e < n and t[e] - t[e - 1] < p.gap_s else 0.0, 0.0)
        leap = p.rest is None and release > max(2.5 * usual, 8 * fine) and moves > 3 * fine
        if rare or leap:
            out[s + 1 : e] = True
    return out


def flag_series(t: np.ndarray, x: np.ndarray, companion: np.ndarray | None, p: Profile) -> np.ndarray:
    """1 for out of bounds, 2 for off course, 3 for stuck, else 0, for one source in order of time."""
    code = np.zeros(len(x), np.int8)
    code[~((x >= p.low) & (x <= p.high))] = 1
    for last in (False, True):
        # held stretches first, as their release looks like a spike; again without spikes, which break a stretch
        rest = np.flatnonzero((code == 0) | (code == 3))
        held = stuck(t[rest], x[rest], None if companion is None else companion[rest], p)
        code[rest[held]] = 3
        if not last:
            code[off_course(t, x, p, code > 0)] = 2
    return code


REASONS = ("ok", "bounds", "spike", "stuck")


def judge_tied(t: np.ndarray, x: np.ndarray, companion: np.ndarray | None, p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """Codes (see `flag_series`) where times may be tied, and for each row its rank among the values of its time: 0 for the one the course takes.

    The course takes, of equal times, the value nearest to the running median of the others. Every other value is judged in its place; as a value farther
    from the course is no more plausible than a nearer one, bisection finds the first that falls. Neighbouring times never take another value together.
    """
    fresh = np.concatenate(([True], t[1:] != t[:-1]))
    if fresh.all():
        return flag_series(t, x, companion, p), np.zeros(len(x), np.int64)
    group = np.cumsum(fresh) - 1
    n = int(group[-1]) + 1
    usable = (x >= p.low) & (x <= p.high)
    has = np.bincount(group, usable, n) > 0
    eligible = np.flatnonzero(usable | ~has[group])
    by_value = eligible[np.lexsort((x[eligible], group[eligible]))]
    first = np.searchsorted(group[by_value], np.arange(n))
    size = np.bincount(group[by_value], minlength=n)
    middle = running_median(x[by_value[first + (size - 1) // 2]])
    away = np.where(usable, np.abs(x - middle[group]), np.inf)
    order = np.lexsort((away, group))
    begin = np.flatnonzero(fresh)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x)) - begin[group[order]]
    row_of = np.empty(len(x), np.int64)
    row_of[begin[group] + rank] = np.arange(len(x))
    course = row_of[begin]
    code = np.zeros(len(x), np.int8)
    code[course] = flag_series(t[course], x[course], None if companion is None else companion[course], p)
    low, high = np.zeros(n, np.int64), np.maximum(np.bincount(group, usable, n).astype(np.int64) - 1, 0)  # ranks up to low stand, ranks beyond high fall
    tied = np.flatnonzero(high > 0)
    part = np.zeros(n, np.int64)
    part[tied] = np.arange(len(tied)) % (WINDOW // 2 + 1)
    while (open_ := tied[low[tied] < high[tied]]).size:
        probe = (low + high + 1) // 2
        for k in range(WINDOW // 2 + 1):
            here = open_[part[open_] == k]
            if not here.size:
                continue
            rows = course.copy()
            rows[here] = row_of[begin[here] + probe[here]]
            falls = flag_series(t[rows], x[rows], None if companion is None else companion[rows], p)[here] > 0
            high[here[falls]] = probe[here[falls]] - 1
            low[here[~falls]] = probe[here[~falls]]
    other = rank > 0
    code[other & (rank > low[group])] = 2
    code[~usable] = 1
    return code, rank


def flagged_readings(series: DataFrame, profile: Profile, companion: bool = False, best_of_time: bool = False) -> DataFrame:
    """Judge a series: columns ``k`` (source), ``us`` (epoch microseconds), ``x`` (value), with ``companion`` also ``c``; other columns are passed on.

    ``series`` holds one row per (``k``, ``us``, ``x``). Returns the flagged rows with ``code`` (see `flag_series`), or with ``best_of_time`` one plausible row
    per time, the nearest to the course. NaN counts as out of bounds.
    """
    columns = series.columns
    pieces = with_halo(series, "us", profile.chunk_s * 1_000_000, profile.halo_s * 1_000_000, profile.halo_s * 1_000_000)

    def judge(t: pa.Table) -> pa.Table | None:
        begin = np.flatnonzero(group_starts(t, ["k", "chunk"]))
        end = np.concatenate((begin[1:], [t.num_rows]))
        us = t.column("us").to_numpy()
        s = us / 1e6
        x = t.column("x").to_numpy()
        c = t.column("c").to_numpy() if companion else None
        code, rank = np.zeros(t.num_rows, np.int8), np.zeros(t.num_rows, np.int64)
        for b, e in zip(begin, end):
            code[b:e], rank[b:e] = judge_tied(s[b:e], x[b:e], None if c is None else c[b:e], profile)
        take = t.column("core").to_numpy(zero_copy_only=False)
        if best_of_time:
            rows = np.flatnonzero(take & (code == 0))
            time = np.cumsum(np.concatenate(([True], (us[1:] != us[:-1]))) | group_starts(t, ["k", "chunk"]))[rows]
            rows = rows[np.lexsort((rank[rows], time))]
            time = np.sort(time)
            rows = rows[np.concatenate(([True], time[1:] != time[:-1]))] if len(rows) else rows
        else:
            rows = np.flatnonzero(take & (code > 0))
        return t.select(columns).append_column("code", pa.array(code.astype(np.int32))).take(pa.array(rows)) if len(rows) else None

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema) + ", code int"
    return map_whole_groups(pieces, ["k", "chunk"], ["us", "x"], judge, schema)


def implausible(rows: DataFrame, row_id: str, key: Column, us: Column, value: Column, profile: Profile, companion: Column | None = None) -> DataFrame:
    """``row_id`` and ``reason`` ('bounds', 'spike' or 'stuck') of every row whose value can't be true.

    Copies (equal key, time and value) are judged once and all get the verdict; differing values of one key and time are judged each (see `judge_tied`).
    Null values are never reported; a row without key or time has no course to leave and is only held against the
    physical bounds. A null companion tells nothing about movement. An empty table gives no rows.
    """
    base = rows.select(F.col(row_id).alias("rid"), key.cast("string").alias("k"), us.alias("us"), value.cast("double").alias("x"), (companion if companion is not None else F.lit(None)).cast("double").alias("c"))
    base = base.where("x is not null")
    placed = base.where("k is not null and us is not null")
    series = placed.groupBy("k", "us", "x").agg(F.min("c").alias("c"), F.min("rid").alias("rid"), F.count("*").alias("n"))
    # few: only copies of a flagged reading are looked up again
    wrong = materialize(flagged_readings(series, profile, companion is not None).select("k", "us", "x", "rid", "n", "code"))
    copies = placed.join(wrong.where("n > 1").select("k", "us", "x", "code"), ["k", "us", "x"]).select("rid", "code")
    loose = base.where("(k is null or us is null) and (isnan(x) or x < %r or x > %r)" % (profile.low, profile.high)).select("rid", F.lit(1).alias("code"))
    both = wrong.where("n = 1").select("rid", "code").unionByName(copies).unionByName(loose)
    return both.select(F.col("rid").alias(row_id), F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("code") + 1).alias("reason"))
