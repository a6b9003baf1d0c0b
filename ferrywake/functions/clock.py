"""Clocks: London calendar buckets, wall-clock times and service hours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LONDON = "Europe/London"
RETENTION_DAYS = 62


def london(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, LONDON)


def period_keys(ts: Column) -> Column:
    """Array of (period, bucket): London day, week that begins on Wednesday, month."""
    day = F.to_date(london(ts))
    week = F.date_sub(day, F.pmod(F.dayofweek(day) - 4, F.lit(7)))
    pair = lambda p, b: F.struct(F.lit(p).alias("period"), b.alias("bucket"))
    return F.array(pair("day", F.date_format(day, "yyyy-MM-dd")), pair("week", F.date_format(week, "yyyy-MM-dd")), pair("month", F.date_format(day, "yyyy-MM")))


def bucket_start(period: Column, bucket: Column) -> Column:
    """First day of a bucket."""
    return F.to_date(F.when(period == "month", F.concat(bucket, F.lit("-01"))).otherwise(bucket))


def kept(period: Column, bucket: Column, now: Column, days: int = RETENTION_DAYS) -> Column:
    return F.date_diff(F.to_date(now), bucket_start(period, bucket)) <= days  # F18, R3


def near_time_ms(hhmm: Column, now_ms: Column) -> Column:
    """London wall-clock 'HH:mm' as the epoch milliseconds nearest to now, with London's offset at now; null for anything else.

    There is no range check: 25:70 rolls over, as T19 says.
    """
    now = F.timestamp_millis(now_ms)
    offset = F.unix_millis(london(now)) - F.unix_millis(now)
    h, m = (F.regexp_extract(F.trim(hhmm), r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    wall = now_ms + offset
    t = wall - F.pmod(wall, F.lit(86_400_000)) + (h * 60 + m) * 60_000 - offset
    t = F.when(t - now_ms > 43_200_000, t - 86_400_000).otherwise(t)
    return F.when(now_ms - t > 43_200_000, t + 86_400_000).otherwise(t)


def stop_time_ms(at: Column, et: Column, st: Column, now_ms: Column) -> Column:
    """Actual, else estimated, else scheduled time."""
    return F.coalesce(near_time_ms(at, now_ms), near_time_ms(et, now_ms), near_time_ms(st, now_ms))


def service_running(hours: Column, offset_hours: float, now: Column) -> Column:
    """Whether a network runs: ``hours`` is an array of seven (open, close) from Sunday; closes past 24 reach into the next day."""
    local = F.timestamp_millis(F.unix_millis(now) + int(offset_hours * 3_600_000))
    hour = F.hour(local) + F.minute(local) / 60.0
    day = F.dayofweek(local) - 1
    today, before = F.get(hours, day), F.get(hours, F.pmod(day + 6, F.lit(7)))
    return F.coalesce((hour >= today["open"]) & (hour < today["close"]), F.lit(False)) | F.coalesce(hour + 24 < before["close"], F.lit(False))


def is_peak(windows: list[tuple[float, float]], offset_hours: float, now: Column) -> Column:
    """Half-open peak windows in local hours."""
    local = F.timestamp_millis(F.unix_millis(now) + int(offset_hours * 3_600_000))
    hour = F.hour(local) + F.minute(local) / 60.0
    out = F.lit(False)
    for a, b in windows:
        out = out | ((hour >= a) & (hour < b))
    return out
