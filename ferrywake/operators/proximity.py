"""Points near other points (problem 6): Z-order cell codes, discs covered by code ranges, a range join on codes, exact refinement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.series import EARTH_M, haversine

#: Bits a coordinate has in a code; a cell is 38 m wide at the equator and 19 m high.
BITS = 20


def _spread(v: Column) -> Column:
    """Bits of a number below 2**20 moved to the even places, five at a time by a table of 32 (a formula with shifts would repeat ``v`` 32 times)."""
    table = F.expr("array(" + ", ".join(f"{int(bin(k)[2:], 4)}L" for k in range(32)) + ")")
    out = None
    for part in range(4):
        piece = F.shiftleft(F.get(table, F.shiftright(v, 5 * part).bitwiseAND(F.lit(31)).cast("int")), 10 * part)
        out = piece if out is None else out.bitwiseOR(piece)
    return out


def z_code(ix: Column, iy: Column) -> Column:
    """Position of grid cell (ix, iy) along the Z-order curve."""
    return _spread(ix.cast("long")).bitwiseOR(F.shiftleft(_spread(iy.cast("long")), 1))


def _index(value: Column, low: float, width: float, bits: int) -> Column:
    return F.least(F.floor((value - F.lit(low)) / F.lit(width) * F.lit(float(2**bits))), F.lit(2**bits - 1)).cast("long")


def point_code(lat: Column, lon: Column, bits: int = BITS) -> Column:
    """Code of a position; null unless -90 <= lat <= 90 and -180 <= lon <= 180."""
    usable = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(usable, z_code(_index(lon, -180.0, 360.0, bits), _index(lat, -90.0, 180.0, bits)))


def cover_level(radius_m: float) -> int:
    """Level of the cells that discs are covered with: the finest whose height is at least the radius."""
    return max(1, min(BITS, int(math.log2(180.0 / math.degrees(radius_m / EARTH_M)))))


def disc_cells(sites: DataFrame, radius_m: float, level: int) -> DataFrame:
    """Every row once per ``cell`` of the level that its disc reaches.

    ``sites`` has ``slat``, ``slon`` (usable positions); other columns stay. Discs that reach over the 180th meridian wrap; near a pole all longitudes are covered.
    """
    n = 2**level
    dlat = math.degrees(radius_m / EARTH_M) * 1.000001
    reach = F.lit(math.sin(radius_m / EARTH_M)) / F.cos(F.radians("slat"))
    polar = (F.abs("slat") + F.lit(dlat) >= 90.0) | (reach >= 1.0)
    dlon = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.000001)
    west = F.floor((F.col("slon") - dlon + 180.0) / 360.0 * n).cast("long")
    east = F.least(F.floor((F.col("slon") + dlon + 180.0) / 360.0 * n).cast("long"), west + F.lit(n - 1))
    south = F.greatest(F.floor((F.col("slat") - dlat + 90.0) / 180.0 * n).cast("long"), F.lit(0))
    north = F.least(F.floor((F.col("slat") + dlat + 90.0) / 180.0 * n).cast("long"), F.lit(n - 1))
    cells = sites.withColumn("ix", F.explode(F.sequence(west, east))).withColumn("iy", F.explode(F.sequence(south, north)))
    return cells.select(*sites.columns, z_code(F.pmod(F.col("ix"), F.lit(n)), F.col("iy")).alias("cell"))


def disc_ranges(sites: DataFrame, radius_m: float, level: int, bucket_level: int) -> DataFrame:
    """Code ranges (``lo``, ``hi``, both inclusive) that cover each site's disc, cut at bucket bounds.

    ``sites`` has ``sid``, ``slat``, ``slon`` (usable positions). Neighbouring cells become one range.
    """
    cells = disc_cells(sites.select("sid", "slat", "slon"), radius_m, level).distinct()
    site = ["sid", "slat", "slon"]
    island = F.col("cell") - F.row_number().over(Window.partitionBy(*site).orderBy("cell"))
    down = 2 * (BITS - level)
    ranges = cells.withColumn("island", island).groupBy(*site, "island").agg(F.shiftleft(F.min("cell"), down).alias("lo"), (F.shiftleft(F.max("cell") + 1, down) - 1).alias("hi"))
    shift = 2 * (BITS - bucket_level)
    by_bucket = ranges.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    return by_bucket.select(*site, "bucket", F.greatest("lo", F.shiftleft("bucket", shift)).alias("lo"), F.least("hi", F.shiftleft(F.col("bucket") + 1, shift) - 1).alias("hi"))


def within_distance(points: DataFrame, pid: str, plat: str, plon: str, sites: DataFrame, sid: str, slat: str, slon: str, radius_m: float, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Each distinct pair (``pid``, ``sid``) at most ``radius_m`` apart, with ``distance_m`` (the smallest, if a site has several places).

    The ranges of the sites are broadcast if there are at most ``broadcast_rows`` of them (about 60 bytes each);
    beyond that both sides are shuffled by (bucket, salt): the points take one of ``salts`` salts each and the ranges are
    repeated for each salt, so a bucket that holds a third of all points is still spread over ``salts`` tasks.

    Rows with a null identifier or an unusable position (null, NaN, out of range) have no pairs. Repeated sites count
    once; equal distances all count. Output columns are ``pid``, ``sid`` (renamed ``<sid>_site`` if the names clash) and ``distance_m``.
    """
    level = cover_level(radius_m)
    bucket_level = max(1, level - 1)
    place = sites.select(F.col(sid).alias("sid"), F.col(slat).cast("double").alias("slat"), F.col(slon).cast("double").alias("slon"))
    place = place.where(F.col("sid").isNotNull() & F.col("slat").between(-90.0, 90.0) & F.col("slon").between(-180.0, 180.0)).distinct()
    ranges = disc_ranges(place, radius_m, level, bucket_level)
    p = points.select(F.col(pid).alias("pid"), F.col(plat).cast("double").alias("plat"), F.col(plon).cast("double").alias("plon")).where(F.col("pid").isNotNull())
    p = p.withColumn("code", point_code(F.col("plat"), F.col("plon"))).where("code is not null")
    p = p.withColumn("bucket", F.shiftright("code", 2 * (BITS - bucket_level)))
    on = ["bucket"]
    if ranges.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = p.join(F.broadcast(ranges), on)
    else:
        on = ["bucket", "salt"]
        p = p.withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(salts)).cast("int"))
        joined = p.join(ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), on)
    pairs = joined.where(F.col("code").between(F.col("lo"), F.col("hi")))
    pairs = pairs.withColumn("distance_m", haversine(F.col("plat"), F.col("plon"), F.col("slat"), F.col("slon"))).where(F.col("distance_m") <= radius_m)
    site_name = sid if sid != pid else f"{sid}_site"
    return pairs.groupBy("pid", "sid").agg(F.min("distance_m").alias("distance_m")).select(F.col("pid").alias(pid), F.col("sid").alias(site_name), "distance_m")
