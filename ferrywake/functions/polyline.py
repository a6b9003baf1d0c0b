"""Polylines in numpy: points by fraction or arc length, projection, resampling, cutting, simplifying.

Arrays of vertices are (n, 2); ``lonlat`` ones in degrees use the planar metric of `geo`, others are metres.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ferrywake.functions.geo import M_PER_DEG_LAT, metres_per_lon

SCALE = np.array([metres_per_lon(), M_PER_DEG_LAT])


def to_m(lonlat) -> np.ndarray:
    return np.asarray(lonlat, float).reshape(-1, 2) * SCALE


def to_deg(xy: np.ndarray) -> np.ndarray:
    return xy / SCALE


def cumulative(xy: np.ndarray) -> np.ndarray:
    """Arc length at each vertex."""
    return np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T)))) if len(xy) else np.zeros(0)


def at_arc(xy: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and bearings at arc lengths (F6); lengths outside are clamped to the ends."""
    s = np.atleast_1d(np.asarray(s, float))
    if len(xy) == 1:
        return np.repeat(xy, len(s), axis=0), np.zeros(len(s))
    cum = cumulative(xy)
    s = np.clip(s, 0.0, cum[-1])
    seg = np.clip(np.searchsorted(cum, s, side="left") - 1, 0, len(xy) - 2)
    d = xy[seg + 1] - xy[seg]
    length = cum[seg + 1] - cum[seg]
    u = np.where(length > 0, (s - cum[seg]) / np.where(length > 0, length, 1.0), 0.0)
    return xy[seg] + d * u[:, None], np.degrees(np.arctan2(d[:, 0], d[:, 1])) % 360


def at_fraction(lonlat, f: float) -> tuple[float, float, float]:
    """(lon, lat, bearing) at a fraction of the length."""
    xy = to_m(lonlat)
    p, b = at_arc(xy, max(0.0, min(1.0, f)) * cumulative(xy)[-1])
    lon, lat = to_deg(p)[0]
    return float(lon), float(lat), float(b[0])


def project(xy: np.ndarray, points: np.ndarray, first: int = 0, last: int | None = None, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest segment, position on it (0..1) and distance for each point, over segments first..last-1 (J11, F4b). The first of equal minima wins.

    All segments are compared at once, in blocks of points, which numpy does faster than a cell index of Python objects.
    """
    a = xy[first:last][:-1]
    v = xy[first:last][1:] - a
    len2 = (v * v).sum(1)
    safe = np.where(len2 > 0, len2, 1.0)
    seg, u, dist = np.empty(len(points), int), np.empty(len(points)), np.empty(len(points))
    block = max(1, min(block, 4_000_000 // max(1, len(a))))
    for k in range(0, len(points), block):
        p = points[k : k + block]
        r = p[:, None, :] - a[None]
        t = np.clip((r * v[None]).sum(2) / safe, 0.0, 1.0) * (len2 > 0)
        d = np.hypot(r[..., 0] - v[:, 0] * t, r[..., 1] - v[:, 1] * t)
        best = d.argmin(1)
        rows = np.arange(len(p))
        seg[k : k + block], u[k : k + block], dist[k : k + block] = best + first, t[rows, best], d[rows, best]
    return seg, u, dist


def arc_of(xy: np.ndarray, seg: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Arc length of projections."""
    cum = cumulative(xy)
    return cum[seg] + (cum[seg + 1] - cum[seg]) * u


def fraction_of(lonlat, lon: float, lat: float) -> float:
    """Fraction of the length at which the polyline is nearest."""
    xy = to_m(lonlat)
    total = cumulative(xy)[-1] if len(xy) else 0.0
    if len(xy) < 2 or total == 0:
        return 0.0
    seg, u, _ = project(xy, to_m([[lon, lat]]))
    return float(arc_of(xy, seg, u)[0] / total)


def resample(xy: np.ndarray, spacing: float, most: int = 2500) -> np.ndarray:
    """Vertices every ``spacing`` metres, both ends kept, at most ``most`` (F7). The end is left out if it lies within a quarter spacing."""
    if len(xy) < 2:
        return xy
    total = cumulative(xy)[-1]
    n = int(math.floor(total / spacing + 1e-12))
    points, _ = at_arc(xy, np.arange(0, n + 1) * spacing)
    if len(points) >= most:
        return points[:most]
    return np.vstack([points, xy[-1]]) if np.hypot(*(xy[-1] - points[-1])) > spacing / 4 else points


def between(xy: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Part of a polyline between the projections of two points, reversed if they lie the other way round (F8)."""
    seg, u, _ = project(xy, np.vstack([start, end]))
    a, b = arc_of(xy, seg, u)
    lo, hi = min(a, b), max(a, b)
    cum = cumulative(xy)
    inner = xy[(cum > lo) & (cum < hi)]
    ends, _ = at_arc(xy, np.array([lo, hi]))
    part = np.vstack([ends[:1], inner, ends[1:]])
    return part[::-1] if a > b else part


def docked(xy: np.ndarray, start: np.ndarray, end: np.ndarray, trim_m: float = 140.0, steps: int = 10) -> np.ndarray:
    """Curve both ends of a track into station points with quadratic Bezier arcs after trimming min(trim, L/3)."""
    cum = cumulative(xy)
    cut = min(trim_m, cum[-1] / 3)
    ends, _ = at_arc(xy, np.array([cut, cum[-1] - cut]))
    middle = xy[(cum > cut) & (cum < cum[-1] - cut)]
    t = np.linspace(0, 1, steps + 1)[:, None]
    bow = lambda p, c, q: (1 - t) ** 2 * p + 2 * t * (1 - t) * c + t**2 * q
    return np.vstack([bow(start, xy[0], ends[0]), middle, bow(ends[1], xy[-1], end)])


def simplify(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker (F10), with an explicit stack."""
    keep = np.zeros(len(xy), bool)
    if not len(xy):
        return xy
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        _, _, d = project(xy[[i, j]], xy[i + 1 : j])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return xy[keep]


def tangent_speed(xy: np.ndarray, seg: int, east: float, north: float) -> float:
    """Velocity along a segment, signed."""
    d = xy[seg + 1] - xy[seg]
    n = float(np.hypot(*d))
    return float((east * d[0] + north * d[1]) / n) if n > 0 else 0.0


# The Airy 1830 ellipsoid, the National Grid's projection and the seven Helmert parameters to WGS84.
AIRY = (6_377_563.396, 6_356_256.909)
WGS84 = (6_378_137.0, 6_356_752.314_2)
GRID = {"scale": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "east0": 400_000.0, "north0": -100_000.0}
HELMERT = {"tx": 446.448, "ty": -125.157, "tz": 542.060, "rx": 0.1502, "ry": 0.2470, "rz": 0.8421, "ppm": -20.4894}


def grid_to_wgs84(easting, northing) -> tuple[np.ndarray, np.ndarray]:
    """OSGB36 eastings and northings to WGS84 (lon, lat) (F11): inverse transverse Mercator, then a Helmert shift; about 5 m."""
    e, n = np.asarray(easting, float), np.asarray(northing, float)
    a, b = AIRY
    f0, lat0, lon0 = GRID["scale"], np.radians(GRID["lat0"]), np.radians(GRID["lon0"])
    e2, k = 1 - (b * b) / (a * a), (a - b) / (a + b)

    def meridian(lat):
        d, s = lat - lat0, lat + lat0
        return b * f0 * ((1 + k + 1.25 * k**2 + 1.25 * k**3) * d - (3 * k + 3 * k**2 + 21 / 8 * k**3) * np.sin(d) * np.cos(s) + (15 / 8 * (k**2 + k**3)) * np.sin(2 * d) * np.cos(2 * s) - 35 / 24 * k**3 * np.sin(3 * d) * np.cos(3 * s))

    lat = lat0 + (n - GRID["north0"]) / (a * f0)
    for _ in range(12):
        lat = lat + (n - GRID["north0"] - meridian(lat)) / (a * f0)
    s2 = np.sin(lat) ** 2
    nu = a * f0 / np.sqrt(1 - e2 * s2)
    rho = a * f0 * (1 - e2) / (1 - e2 * s2) ** 1.5
    eta2, t, sec, d = nu / rho - 1, np.tan(lat), 1 / np.cos(lat), e - GRID["east0"]
    phi = lat - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta2 - 9 * t**2 * eta2) * d**4 - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * d**6
    lam = lon0 + sec / nu * d - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * d**3 + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * d**5 - sec / (5040 * nu**7) * (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6) * d**7
    v = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    p = np.array([v * np.cos(phi) * np.cos(lam), v * np.cos(phi) * np.sin(lam), v * (1 - e2) * np.sin(phi)])
    rx, ry, rz = (np.radians(HELMERT[c] / 3600) for c in ("rx", "ry", "rz"))
    m = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]) * 1.0
    m[np.diag_indices(3)] = 1 + HELMERT["ppm"] * 1e-6
    x, y, z = np.array([HELMERT["tx"], HELMERT["ty"], HELMERT["tz"]]).reshape(3, *[1] * e.ndim) + np.tensordot(m, p, 1)
    a2, b2 = WGS84
    q2, r = 1 - (b2 * b2) / (a2 * a2), np.hypot(x, y)
    out = np.arctan2(z, r * (1 - q2))
    for _ in range(8):
        w = a2 / np.sqrt(1 - q2 * np.sin(out) ** 2)
        out = np.arctan2(z + q2 * w * np.sin(out), r)
    return np.degrees(np.arctan2(y, x)), np.degrees(out)


PLACED = T.StructType([T.StructField(c, T.DoubleType()) for c in ("lon", "lat", "bearing")])


@F.pandas_udf(PLACED)
def point_at_fraction(line: pd.Series, fraction: pd.Series) -> pd.DataFrame:
    """Column form of `at_fraction`: array of (lon, lat) structs and a fraction."""
    rows = []
    for pts, f in zip(line, fraction):
        if pts is None or len(pts) == 0 or f is None or f != f:
            rows.append((None, None, None))
        else:
            rows.append(at_fraction([(p["lon"], p["lat"]) for p in pts], f))
    return pd.DataFrame(rows, columns=["lon", "lat", "bearing"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fraction_on(line: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Column form of `fraction_of`."""
    return pd.Series([None if pts is None or x != x or y != y else fraction_of([(p["lon"], p["lat"]) for p in pts], x, y) for pts, x, y in zip(line, lon, lat)], dtype="float64")
