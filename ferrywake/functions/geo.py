"""Geometry on columns: distances, bearings, boxes, dead reckoning."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ferrywake.operators.series import haversine  # noqa: F401  (F1)

# Metres per degree of the planar metric, and its reference latitude.
M_PER_DEG_LAT = 110_540.0
M_PER_DEG_LON_EQUATOR = 111_320.0
REFERENCE_LAT = 51.5
KNOT_MS = 0.514444


def metres_per_lon(lat: float = REFERENCE_LAT) -> float:
    return M_PER_DEG_LON_EQUATOR * math.cos(math.radians(lat))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat: float = REFERENCE_LAT) -> Column:
    """Equirectangular metres at a reference latitude (F2)."""
    return F.hypot((lon2 - lon1) * metres_per_lon(lat), (lat2 - lat1) * M_PER_DEG_LAT)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat: float = REFERENCE_LAT) -> Column:
    """Degrees clockwise from north, 0 <= b < 360."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * metres_per_lon(lat), (lat2 - lat1) * M_PER_DEG_LAT)) + 360.0, F.lit(360.0))


@dataclass(frozen=True)
class Box:
    """A bounding box, inclusive on all edges."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def holds(self, lon: Column, lat: Column) -> Column:
        return lon.between(self.min_lon, self.max_lon) & lat.between(self.min_lat, self.max_lat)

    def widened(self, degrees: float) -> Box:
        """Grown on all sides and clamped to the globe."""
        return Box(max(-180.0, self.min_lon - degrees), max(-90.0, self.min_lat - degrees), min(180.0, self.max_lon + degrees), min(90.0, self.max_lat + degrees))

    def with_margin(self, share: float = 0.2) -> Box:
        """Grown by a share of its width and height."""
        w, h = (self.max_lon - self.min_lon) * share, (self.max_lat - self.min_lat) * share
        return Box(self.min_lon - w, self.min_lat - h, self.max_lon + w, self.max_lat + h)

    def holds_all(self, points: Column) -> Column:
        """Whether every element of an array of (lon, lat) structs lies inside (P16); true for an empty array."""
        return F.forall(points, lambda p: self.holds(p["lon"], p["lat"]))


def reckoned(lon: Column, lat: Column, speed_ms: Column, course_deg: Column, seconds: Column, ref_lat: float = REFERENCE_LAT) -> tuple[Column, Column]:
    """Position after ``seconds`` on a course (F33); null speed or course count as 0."""
    far = F.coalesce(speed_ms, F.lit(0.0)) * seconds
    course = F.radians(F.coalesce(course_deg, F.lit(0.0)))
    return lon + far * F.sin(course) / metres_per_lon(ref_lat), lat + far * F.cos(course) / M_PER_DEG_LAT


def vessel_reckoned(lon: Column, lat: Column, sog_kn: Column, cog: Column, age_ms: Column, fresh_ms: int = 30_000, cap_s: int = 120) -> tuple[Column, Column]:
    """F33 for vessels: only while fresh, at most ``cap_s`` seconds ahead."""
    x, y = reckoned(lon, lat, sog_kn * KNOT_MS, cog, F.least(F.greatest(F.lit(0.0), age_ms / 1000.0), F.lit(float(cap_s))))
    return F.when(age_ms < fresh_ms, x).otherwise(lon), F.when(age_ms < fresh_ms, y).otherwise(lat)


def aircraft_reckoned(lon: Column, lat: Column, speed_kn: Column, track: Column, since_poll_ms: Column, on_ground: Column) -> tuple[Column, Column]:
    """F33 for aircraft: from the time of the poll on, without a bound; on the ground they stay."""
    x, y = reckoned(lon, lat, speed_kn * KNOT_MS, track, F.greatest(F.lit(0.0), since_poll_ms / 1000.0))
    ground = F.coalesce(on_ground, F.lit(False))
    return F.when(ground, lon).otherwise(x), F.when(ground, lat).otherwise(y)


def faded(age_ms: Column, least: float, fresh_ms: int = 30_000, gone_ms: int = 900_000) -> Column:
    """1 while fresh, falling linearly to ``least`` at ``gone_ms``."""
    share = F.least(F.greatest(F.lit(0.0), (age_ms - fresh_ms) / float(gone_ms - fresh_ms)), F.lit(1.0))
    return 1.0 - share * (1.0 - least)


def coasted(s: Column, v: Column, age_ms: Column, tau_s: float = 12.0) -> Column:
    """Arc length reached by a speed that decays with ``tau_s``."""
    return s + v * tau_s * (1.0 - F.exp(-F.greatest(age_ms / 1000.0, F.lit(0.0)) / tau_s))


def ring_centroid(ring: Column) -> Column:
    """Vertex mean of an array of (lon, lat) structs (A21); null if empty."""
    total = F.aggregate(ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a["x"] + p["lon"]).alias("x"), (a["y"] + p["lat"]).alias("y")))
    n = F.size(ring)
    return F.when(n > 0, F.struct((total["x"] / n).alias("lon"), (total["y"] / n).alias("lat")))


def rounded(value: Column, places: int) -> Column:
    """Half towards plus infinity, as the map's number formatting does."""
    p = float(10**places)
    return F.floor(value * p + 0.5) / p


def two_fix_velocity(dlon: Column, dlat: Column, dt_s: Column, bearing: Column, fallback_ms: float = 8.0) -> tuple[Column, Column, Column]:
    """(east m/s, north m/s, tracked) from two fixes 3..120 s apart and at most 20 m/s; else along the bearing, else 0."""
    east, north = dlon * metres_per_lon() / dt_s, dlat * M_PER_DEG_LAT / dt_s
    good = F.coalesce(dt_s.between(3, 120) & (F.hypot(east, north) <= 20.0), F.lit(False))
    rad = F.radians(bearing)
    return F.when(good, east).otherwise(F.coalesce(fallback_ms * F.sin(rad), F.lit(0.0))), F.when(good, north).otherwise(F.coalesce(fallback_ms * F.cos(rad), F.lit(0.0))), good
