"""The events table as vehicle fixes: positions by a rule inside the default region, so that fix operators have input (same text in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrywake.session import table

FIXES_SQL = """
fixes as (select event_id, user_id as vid, event_type as mode, value, cast(ts as timestamp) as ts, cast(floor(epoch_us(cast(ts as timestamp)) / 1000.0) as bigint) as tms,
  -0.55 + 0.9 * ((user_id * 7919 + event_id * 31) % 1000) / 1000.0 as lon, 51.25 + 0.47 * ((user_id * 104729 + event_id * 17) % 1000) / 1000.0 as lat
  from events)
"""


def fixes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lon = F.lit(-0.55) + F.lit(0.9) * F.pmod(F.col("user_id") * 7919 + F.col("event_id") * 31, F.lit(1000)) / 1000.0
    lat = F.lit(51.25) + F.lit(0.47) * F.pmod(F.col("user_id") * 104729 + F.col("event_id") * 17, F.lit(1000)) / 1000.0
    return e.select("event_id", F.col("user_id").alias("vid"), F.col("event_type").alias("mode"), "value", "ts", F.unix_millis("ts").alias("tms"), lon.alias("lon"), lat.alias("lat"))


def placed(df: DataFrame, key: str) -> DataFrame:
    """Rows with coordinates hashed from a key, for spatial joins of tables without any."""
    return df.withColumn("lon", F.lit(-0.55) + F.lit(0.9) * F.pmod(F.col(key) * 7919, F.lit(10007)) / 10007.0).withColumn("lat", F.lit(51.25) + F.lit(0.47) * F.pmod(F.col(key) * 104729, F.lit(10007)) / 10007.0)


def placed_sql(key: str) -> str:
    return f"-0.55 + 0.9 * (({key} * 7919) % 10007) / 10007.0 as lon, 51.25 + 0.47 * (({key} * 104729) % 10007) / 10007.0 as lat"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) + 0 * ({lat1} + {lon1} + {lat2} + {lon2})"  # least() skips nulls, the sum doesn't
