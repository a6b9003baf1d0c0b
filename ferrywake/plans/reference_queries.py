"""Queries of the transport operators over the test tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ferrywake.functions import clock, geo, text
from ferrywake.operators import latest, leaderboard, lookups, network, quality, rail, routes, trains
from ferrywake.operators.grid import iso_micros
from ferrywake.operators.series import floor_div
from ferrywake.plans.fixes import FIXES_SQL, fixes, hav_sql, placed, placed_sql
from ferrywake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


# ---- leaderboard -------------------------------------------------------------------------------------------------

GAP_MS = 21_600_000
_BUS_SQL = f"""
src as (select 'bus' as mode, id, line as label, line as line_id, lat, lon, cast(epoch_ms(recorded_at) as bigint) as tms, fix_id as ord from bus_fixes
  where lat is not null and lon is not null and recorded_at is not null and id is not null),
lagged as (select *, tms - lag(tms) over w as gap_ms, {hav_sql("lag(lat) over w", "lag(lon) over w", "lat", "lon")} as move_m from src window w as (partition by id order by ord)),
judged as (select *, case when gap_ms is null then 'first' when gap_ms <= 0 or gap_ms > 300000 then 'gap' when move_m < 5 then 'jitter' when move_m / (gap_ms / 1000.0) > 40 then 'teleport' else 'ok' end as outcome from lagged)"""
_EVENT_SQL = f"""
{FIXES_SQL},
lagged as (select 'bus' as mode, vid as id, mode as label, mode as line_id, tms, event_id as ord, tms - lag(tms) over w as gap_ms, {hav_sql("lag(lat) over w", "lag(lon) over w", "lat", "lon")} as move_m from fixes window w as (partition by vid order by event_id)),
judged as (select *, case when gap_ms is null then 'first' when gap_ms <= 0 or gap_ms > {GAP_MS} then 'gap' when move_m < 5 then 'jitter' when move_m / (gap_ms / 1000.0) > 40 then 'teleport' else 'ok' end as outcome from lagged)"""
_TOTALS_SQL = """,
local as (select *, cast(timezone('Europe/London', timezone('UTC', cast(make_timestamp(tms * 1000) as timestamp))) as date) as day from judged where outcome = 'ok'),
spread as (select *, 'day' as period, strftime(day, '%Y-%m-%d') as bucket from local
  union all select *, 'week', strftime(day - cast((dayofweek(day) - 3 + 7) % 7 as integer), '%Y-%m-%d') from local
  union all select *, 'month', strftime(day, '%Y-%m') from local),
facts as (select mode, period, bucket, id, sum(move_m) as m, arg_max_null(label, ord) as label, arg_min_null(line_id, ord) as line_id, min(ord) as first_ord from spread group by all),
ranked as (select *, row_number() over (partition by mode, period, bucket order by m desc, first_ord) as rank, count(*) over (partition by mode, period, bucket) as total from facts)"""


def _judged_events(spark: SparkSession, d: str) -> DataFrame:
    f = fixes(spark, d).select(F.lit("bus").alias("mode"), F.col("vid").alias("id"), F.col("mode").alias("label"), F.col("mode").alias("line_id"), "lat", "lon", F.col("tms").alias("t_ms"), F.col("tms").alias("tick_ms"), F.col("event_id").alias("ord"))
    return leaderboard.outcomes(f, max_gap_ms=GAP_MS)


def _judged_buses(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bus_fixes")
    t = F.unix_millis("recorded_at")
    f = b.select(F.lit("bus").alias("mode"), "id", F.col("line").alias("label"), F.col("line").alias("line_id"), "lat", "lon", t.alias("t_ms"), F.unix_millis("polled_at").alias("tick_ms"), F.col("fix_id").alias("ord")).where("t_ms is not null")
    return leaderboard.outcomes(f, time_policy="fix", caps=leaderboard.SPEED_CAPS)


def _top(facts: DataFrame, period: str) -> DataFrame:
    return leaderboard.top(facts.where(F.col("period") == period)).select("mode", "bucket", "rank", "id", r6("m").alias("m"))


def _top_sql(base: str, period: str) -> str:
    return f"with {base}{_TOTALS_SQL} select mode, bucket, rank, id, round(m, 6) as m from ranked where rank <= 20 and period = '{period}'"


@query(_top_sql(_EVENT_SQL, "day"))
def leaderboard_day_top20(spark, d):
    return _top(leaderboard.totals(_judged_events(spark, d)), "day")


@query(_top_sql(_EVENT_SQL, "week"))
def leaderboard_week(spark, d):
    return _top(leaderboard.totals(_judged_events(spark, d)), "week")


@query(_top_sql(_EVENT_SQL, "month"))
def leaderboard_month(spark, d):
    return _top(leaderboard.totals(_judged_events(spark, d)), "month")


@query(f"with {_EVENT_SQL}{_TOTALS_SQL} select bucket, id, rank, total from ranked where period = 'day'")
def vehicle_rank(spark, d):
    return leaderboard.ranked(leaderboard.totals(_judged_events(spark, d))).where("period = 'day'").select("bucket", "id", "rank", "total")


@query(f"with {_EVENT_SQL} select outcome, count(*) as n from judged group by outcome")
def implied_speed_rejects(spark, d):
    return _judged_events(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"with {_BUS_SQL}{_TOTALS_SQL} select bucket, rank, id, round(m, 4) as m, floor(m / 100 + 0.5) / 10 as km, label, line_id from ranked where rank <= 20 and period = 'day'".replace("window w as (partition by id order by ord)", "window w as (partition by id order by ord)"))
def bus_leaderboard_day(spark, d):
    judged = _judged_buses(spark, d).withColumn("tick_ms", F.col("t_ms"))
    return leaderboard.top(leaderboard.totals(judged)).where("period = 'day'").select("bucket", "rank", "id", F.round("m", 4).alias("m"), "km", "label", "line_id")


@query(f"with {_BUS_SQL} select outcome, count(*) as n, round(sum(move_m) / 1000, 3) as km from judged group by outcome")
def bus_outcomes(spark, d):
    return _judged_buses(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("move_m") / 1000, 3).alias("km"))


# ---- journeys, paths, smoothing ------------------------------------------------------------------------------------

_JOURNEY_SQL = f"""{FIXES_SQL},
fresh as (select *, case when lag(tms) over w is null or cast(floor(tms / 1000.0) as bigint) - lag(cast(floor(tms / 1000.0) as bigint)) over w > 21600 then 1 else 0 end as f,
  sqrt(pow((lon - lag(lon) over w) * {geo.metres_per_lon()!r}, 2) + pow((lat - lag(lat) over w) * 110540.0, 2)) as step from fixes window w as (partition by vid order by event_id)),
journeys as (select *, sum(f) over (partition by vid order by event_id rows unbounded preceding) as journey from fresh)"""


def _event_journeys(spark, d):
    f = fixes(spark, d).select(F.lit("all").alias("k"), F.col("vid").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.expr("tms div 1000").alias("t"))
    return routes.journeys(f, gap_s=21_600)


@query(f"with {_JOURNEY_SQL} select vid as i, cast(floor(tms / 1000.0) as bigint) as t, cast(journey as bigint) as journey from journeys")
def journey_split(spark, d):
    return _event_journeys(spark, d).select("i", "t", "journey")


@query(f"with {_JOURNEY_SQL} select vid as i, cast(journey as bigint) as journey, count(*) as n, cast(floor(max(tms) / 1000.0) as bigint) - cast(floor(min(tms) / 1000.0) as bigint) as seconds, round(coalesce(sum(case when f = 0 then step end), 0), 4) as length_m from journeys group by vid, journey")
def journey_summary(spark, d):
    s = routes.journey_summary(_event_journeys(spark, d))
    return s.select("i", "journey", "n", (F.col("end_t") - F.col("start_t")).alias("seconds"), F.round("length_m", 4).alias("length_m"))


_BUS_TRACE_SQL = f"""
src as (select id as i, cast(floor(epoch_ms(recorded_at) / 1000.0) as bigint) as t, min({{'x': lon, 'y': lat}}) as p from bus_fixes where id is not null and lat is not null and lon is not null and recorded_at is not null group by all),
fresh as (select i, t, case when lag(t) over w is null or t - lag(t) over w > 600 then 1 else 0 end as f,
  sqrt(pow((p.x - lag(p.x) over w) * {geo.metres_per_lon()!r}, 2) + pow((p.y - lag(p.y) over w) * 110540.0, 2)) as step from src window w as (partition by i order by t)),
journeys as (select *, sum(f) over (partition by i order by t rows unbounded preceding) as journey from fresh),
summary as (select i, journey, count(*) as n, max(t) - min(t) as seconds, coalesce(sum(case when f = 0 then step end), 0) as length_m from journeys group by i, journey)"""


def _bus_traces(spark, d):
    b = table(spark, d, "bus_fixes")
    return b.select(F.lit("all").alias("k"), F.col("id").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.floor(F.unix_millis("recorded_at") / 1000.0).cast("long").alias("t"))


@query(f"with {_BUS_TRACE_SQL} select i, cast(journey as bigint) as journey, n, seconds, round(length_m, 2) as length_m from summary where n >= 15 and seconds >= 480 and length_m >= 2000")
def bus_journeys(spark, d):
    s = routes.complete(routes.journey_summary(routes.journeys(_bus_traces(spark, d))))
    return s.select("i", "journey", "n", (F.col("end_t") - F.col("start_t")).alias("seconds"), F.round("length_m", 2).alias("length_m"))


@query(f"with {_JOURNEY_SQL} select vid, event_id, round(sum(coalesce(step, 0)) over (partition by vid order by event_id rows unbounded preceding), 3) as arc_m from journeys")
def cumulative_arc(spark, d):
    from ferrywake.operators.trips import lag_across, running_across

    f = fixes(spark, d).withColumn("chunk", floor_div(F.col("event_id"), 100_000))
    lagged = lag_across(f, ["vid"], "chunk", ["event_id"], ["lon", "lat"])
    step = F.coalesce(geo.planar_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat")), F.lit(0.0))
    return running_across(lagged.withColumn("step", step), ["vid"], "chunk", ["event_id"], {"arc": F.col("step")}).select("vid", "event_id", F.round("arc", 3).alias("arc_m"))


@query(f"with {_JOURNEY_SQL} select vid, round(sum(coalesce(step, 0)), 3) as length_m from journeys group by vid")
def path_length(spark, d):
    from ferrywake.operators.trips import lag_across

    f = fixes(spark, d).withColumn("chunk", floor_div(F.col("event_id"), 100_000))
    lagged = lag_across(f, ["vid"], "chunk", ["event_id"], ["lon", "lat"])
    step = F.coalesce(geo.planar_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat")), F.lit(0.0))
    return lagged.groupBy("vid").agg(F.round(F.sum(step), 3).alias("length_m"))


@query("select l_orderkey, l_linenumber, round(coalesce(0.25 * lag(q) over w + 0.5 * q + 0.25 * lead(q) over w, q), 6) as q from (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by all) window w as (partition by l_orderkey order by l_linenumber)")
def smooth_121(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return routes.smoothed(q, ["l_orderkey"], "l_linenumber", ["q"]).withColumn("q", r6("q"))


# ---- latest state ----------------------------------------------------------------------------------------------------

@query("select id, fix_id, lat, lon, line from bus_fixes where id is not null and recorded_at is not null qualify row_number() over (partition by id order by recorded_at desc, fix_id) = 1")
def latest_fix_per_vehicle(spark, d):
    b = table(spark, d, "bus_fixes").select("id", "fix_id", "lat", "lon", "line", "recorded_at")
    return latest.latest_per_key(b, ["id"], "recorded_at", "fix_id").drop("recorded_at")


@query("select id, max(epoch_ms(recorded_at)) as last_ms from bus_fixes where id is not null group by id having (select max(epoch_ms(recorded_at)) from bus_fixes) - max(epoch_ms(recorded_at)) > 300000")
def stale_vehicles(spark, d):
    b = table(spark, d, "bus_fixes").where("id is not null and recorded_at is not null").groupBy("id").agg(F.max(F.unix_millis("recorded_at")).alias("last_ms"))
    now = b.agg(F.max("last_ms")).first()[0]
    return b.join(latest.fresh(b, "last_ms", F.lit(now), 300_000).select("id"), "id", "left_anti")


@query("select id, fix_id from (select id, fix_id, recorded_at, lag(recorded_at) over w as p, row_number() over w as n from bus_fixes where id is not null window w as (partition by id order by fix_id)) where n = 1 or recorded_at is distinct from p")
def changed_fix_dedupe(spark, d):
    b = table(spark, d, "bus_fixes").where("id is not null").select("id", "fix_id", "recorded_at")
    return latest.changed(b, "id", "fix_id", "recorded_at", floor_div(F.col("fix_id"), 100_000)).select("id", "fix_id")


@query("""select report_id, last_value(nullif(trim(name), '') ignore nulls) over w as name, last_value(draught_m ignore nulls) over w as draught_m, last_value(destination ignore nulls) over w as destination
from vessels window w as (partition by mmsi order by last_seen, report_id rows unbounded preceding)""")
def carry_forward_state(spark, d):
    v = table(spark, d, "vessels").select("report_id", "mmsi", F.nullif(F.trim("name"), F.lit("")).alias("name"), "draught_m", "destination", "last_seen", (F.col("last_seen") * 1000).alias("us"))
    return latest.carried_forward(v, "mmsi", "us", ["last_seen", "report_id"], ["name", "draught_m", "destination"]).select("report_id", "name", "draught_m", "destination")


@query("""select ref, reading_id, level_m from tide_readings where ref is not null and lat is not null and lon is not null and polled_at is not null
qualify row_number() over (partition by format('{:.4f},{:.4f}', lat, lon) order by polled_at desc, reading_id) = 1""")
def dedupe_rounded_key(spark, d):
    t = table(spark, d, "tide_readings").where("ref is not null and lat is not null and lon is not null").select("ref", "reading_id", "level_m", "lat", "lon", "polled_at")
    return latest.per_place(t, "lat", "lon", "polled_at", "reading_id").select("ref", "reading_id", "level_m")


_TREND_SQL = """with r as (select ref, level_m as v, cast(floor(epoch(try_cast(reading_at as timestamptz))) as bigint) as s, reading_id from tide_readings where level_m is not null and regexp_matches(reading_at, '^[0-9]{4}-')),
ends as (select ref, max(s) as now_s from r where s is not null group by ref),
recent as (select r.* from r join ends using (ref) where s between now_s - 3000 and now_s),
b as (select ref, arg_min(v, s * 1000000000 + reading_id) as o, arg_max(v, s * 1000000000 + reading_id) as n, count(*) as c from recent group by ref)
select ref, case when c >= 2 and n - o > 0.03 then 'rising' when c >= 2 and n - o < -0.03 then 'falling' else 'steady' end as trend, c as n from b"""


@query(_TREND_SQL)
def trend_50min(spark, d):
    t = table(spark, d, "tide_readings").select("ref", "level_m", "reading_id", F.floor(iso_micros(F.col("reading_at")) / 1_000_000).cast("long").alias("s")).where("level_m is not null and s is not null and ref is not null")
    ends = t.groupBy("ref").agg(F.max("s").alias("now_s"))
    shifted = t.join(ends, "ref").withColumn("age", F.col("s") - F.col("now_s")).where("age >= -3000").withColumn("o", F.struct("s", "reading_id"))
    return latest.tide_trend(shifted.withColumn("t", F.col("age") * 1_000_000_000 + F.col("reading_id")), "ref", "t", "level_m", F.lit(10**18), window_s=2 * 10**18)


@query("select a.id from (select distinct id from bus_fixes where id is not null) as a where not exists (select 1 from bus_wire as w where w.i = a.id and w.batch_no = (select max(batch_no) from bus_wire))")
def absent_from_poll(spark, d):
    states = table(spark, d, "bus_fixes").where("id is not null").select("id").distinct()
    wire = table(spark, d, "bus_wire")
    newest = wire.agg(F.max("batch_no")).first()[0]
    return latest.absent(states, wire.where(F.col("batch_no") == newest).select(F.col("i").alias("id")), "id")


@query("select user_id, event_id, count(*) over (partition by user_id order by cast(floor(epoch_us(ts) / 1000.0) as bigint) range between 3599999 preceding and current row) as calls from events")
def rate_limit_window(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return latest.trailing_count(e, "user_id", "ms", 3_600_000).select("user_id", "event_id", "calls")


# ---- predicates and scalar functions ---------------------------------------------------------------------------------

@query("select fix_id from bus_fixes where lon between -0.55 and 0.35 and lat between 51.25 and 51.72")
def bbox_filter(spark, d):
    return table(spark, d, "bus_fixes").where(geo.Box(-0.55, 51.25, 0.35, 51.72).holds(F.col("lon"), F.col("lat"))).select("fix_id")


@query("select fix_id from bus_fixes where lon between -0.2 - 0.06 and 0.1 + 0.06 and lat between 51.4 - 0.04 and 51.6 + 0.04")
def viewport_filter(spark, d):
    return table(spark, d, "bus_fixes").where(geo.Box(-0.2, 51.4, 0.1, 51.6).with_margin(0.2).holds(F.col("lon"), F.col("lat"))).select("fix_id")


@query("select upper(trim(line)) as line, count(*) as buses from bus_fixes where upper(trim(line)) in ('4', '12', '30', 'N16', 'X541') group by 1")
def line_filter_inlist(spark, d):
    return lookups.active_lines(table(spark, d, "bus_fixes"), "line", ["4", "12 ", "30", "n16", "x541"])


@query("select upper(trim(line)) as line, count(*) as buses from bus_fixes where trim(line) <> '' group by 1")
def active_line_counts(spark, d):
    return lookups.active_lines(table(spark, d, "bus_fixes"), "line")


@query("""select report_id, case when ship_type between 60 and 69 then 'pass' when ship_type between 70 and 79 then 'cargo' when ship_type between 80 and 89 then 'tanker' when ship_type = 30 then 'fish'
when ship_type in (36, 37) then 'pleasure' when ship_type between 50 and 55 then 'special' else 'other' end as class from vessels""")
def ship_class(spark, d):
    return table(spark, d, "vessels").select("report_id", text.ship_class(F.col("ship_type")).alias("class"))


_REG = "chr(71) || '-' || upper(substr(p_name, 1, 3)) || 'A'"


@query(f"""select p_partkey, case when reg in ({','.join(repr(x) for x in text.POLICE_MARKS)}) or {' or '.join(f"starts_with(reg, '{x}')" for x in text.POLICE_MARK_STARTS)} then 'police'
when reg in ({','.join(repr(x) for x in text.AMBULANCE_MARKS)}) or {' or '.join(f"starts_with(reg, '{x}')" for x in text.AMBULANCE_MARK_STARTS)} then 'air-ambulance'
when starts_with(call, 'NPAS') or starts_with(call, 'POL') then 'police' when {' or '.join(f"starts_with(call, '{x}')" for x in text.AMBULANCE_CALLS)} then 'air-ambulance' else 'plane' end as class
from (select p_partkey, case p_partkey % 5 when 0 then 'G-POLX' when 1 then 'G-LAAZ' when 2 then 'G-EHEM' else '' end as reg, case p_partkey % 7 when 0 then 'HLE21' when 1 then 'NPAS61' when 2 then 'MEDIC7' else 'BAW1' end as call from part)""")
def callsign_class(spark, d):
    p = table(spark, d, "part")
    pick = lambda n, *v: F.coalesce(F.get(F.array(*[F.lit(x) for x in v]), F.pmod("p_partkey", F.lit(n)).cast("int")), F.lit(v[-1]))
    return p.select("p_partkey", text.aircraft_class(pick(5, " g-polx", "G-LAAZ", "G-EHEM", ""), pick(7, "HLE21  ", "npas61", "MEDIC-7", "BAW1"), F.lit(None)).alias("class"))


_NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s+(underground|dlr|rail)?\s*station\b.*$', ' ', 'g'), '\s+platform\b.*$', ' ', 'g'), '[''`‘’]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select distinct properties.id as id, {_NORM_SQL.format(c='properties.name')} as name from district")
def name_normalise(spark, d):
    return table(spark, d, "district").select(F.col("properties.id").alias("id"), text.station_name(F.col("properties.name")).alias("name")).distinct()


@query("select fix_id, case lower(trim(direction)) when '' then 'unknown' when '1' then 'outbound' when '2' then 'inbound' else lower(trim(direction)) end as direction, trim(replace(dest, '_', ' ')) as dest from bus_fixes")
def direction_normalise(spark, d):
    return table(spark, d, "bus_fixes").select("fix_id", text.direction(F.col("direction")).alias("direction"), text.humanized(F.col("dest")).alias("dest"))


@query("select distinct regexp_replace(concat_ws(':', operator, line, direction), '[^A-Za-z0-9_.-]', '_', 'g') as key from bus_fixes")
def sanitise_key(spark, d):
    return table(spark, d, "bus_fixes").select(text.safe_key(F.concat_ws(":", "operator", "line", "direction")).alias("key")).distinct()


@query("""select i, x, y, case when coalesce(r, 0) = 0 then 'closed' when b = 0 then 'empty' when b <= 3 then 'low' else 'ok' end as class,
case when coalesce(r, 0) = 0 then 'not renting' when b = 0 then 'no bikes · ' || d || ' space' || case when d = 1 then '' else 's' end || ' to return one'
when d = 0 then b || ' bike' || case when b = 1 then '' else 's' end || ' · no space to return' else b || ' bike' || case when b = 1 then '' else 's' end || ' · ' || d || ' space' || case when d = 1 then '' else 's' end end as label from bike_stations""")
def bike_labels(spark, d):
    b = table(spark, d, "bike_stations")
    renting = F.coalesce(F.col("r") != 0, F.lit(False))
    return b.select("i", "x", "y", text.bikes_class(F.col("b"), renting).alias("class"), text.bikes_label(F.col("b"), F.col("d"), renting).alias("label"))


@query(r"""select report_id, case when age < 30000 then round(lon + coalesce(sog, 0) * 0.514444 * least(greatest(0, age / 1000.0), 120) * sin(radians(coalesce(cog, 0))) / (111320.0 * cos(radians(51.5))), 6) else round(lon, 6) end as lon,
case when age < 30000 then round(lat + coalesce(sog, 0) * 0.514444 * least(greatest(0, age / 1000.0), 120) * cos(radians(coalesce(cog, 0))) / 110540.0, 6) else round(lat, 6) end as lat
from (select *, epoch_ms(received_at) - last_seen as age from vessels)""")
def dead_reckon(spark, d):
    v = table(spark, d, "vessels").withColumn("age", F.unix_millis("received_at") - F.col("last_seen"))
    x, y = geo.vessel_reckoned(F.col("lon"), F.col("lat"), F.col("sog"), F.col("cog"), F.col("age"))
    return v.select("report_id", r6(x).alias("lon"), r6(y).alias("lat"))


@query("""select event_id, round(1 - f * 0.5, 6) as scale, round(1 - f * 0.65, 6) as opacity from (select event_id, least(greatest(0.0, (value * 10000 - 30000) / 870000.0), 1.0) as f from events)""")
def fade_by_age(spark, d):
    age = F.col("value") * 10_000
    return table(spark, d, "events").select("event_id", r6(geo.faded(age, 0.5)).alias("scale"), r6(geo.faded(age, 0.35)).alias("opacity"))


@query(f"""with src as (select id, fix_id, lon, lat, bearing, epoch_ms(recorded_at) / 1000.0 as t from bus_fixes where id is not null and lat is not null and lon is not null and recorded_at is not null),
l as (select *, (lon - lag(lon) over w) * {geo.metres_per_lon()!r} as dx, (lat - lag(lat) over w) * 110540.0 as dy, t - lag(t) over w as dt from src window w as (partition by id order by fix_id)),
v as (select fix_id, bearing, coalesce(dt between 3 and 120 and sqrt(pow(dx / dt, 2) + pow(dy / dt, 2)) <= 20, false) as tracked, dx, dy, dt from l)
select fix_id, tracked, round(case when tracked then dx / dt else coalesce(8 * sin(radians(bearing)), 0) end, 6) + 0.0 as east, round(case when tracked then dy / dt else coalesce(8 * cos(radians(bearing)), 0) end, 6) + 0.0 as north from v""")
def velocity_two_fix(spark, d):
    from ferrywake.operators.trips import lag_across

    b = table(spark, d, "bus_fixes").where("id is not null and lat is not null and lon is not null and recorded_at is not null").select("id", "fix_id", "lon", "lat", "bearing", (F.unix_millis("recorded_at") / 1000.0).alias("t"))
    l = lag_across(b.withColumn("chunk", floor_div(F.col("fix_id"), 100_000)), ["id"], "chunk", ["fix_id"], ["lon", "lat", "t"])  # noqa: E741
    e, n, ok = geo.two_fix_velocity(F.col("lon") - F.col("prev_lon"), F.col("lat") - F.col("prev_lat"), F.col("t") - F.col("prev_t"), F.col("bearing"))
    return l.select("fix_id", ok.alias("tracked"), r6(e).alias("east"), r6(n).alias("north"))


@query("""select fix_id, strftime(day, '%Y-%m-%d') as day, strftime(day - cast((dayofweek(day) - 3 + 7) % 7 as integer), '%Y-%m-%d') as week, strftime(day, '%Y-%m') as month
from (select fix_id, cast(timezone('Europe/London', recorded_at) as date) as day from bus_fixes where recorded_at is not null)""")
def london_buckets(spark, d):
    b = table(spark, d, "bus_fixes").where("recorded_at is not null").select("fix_id", clock.period_keys(F.col("recorded_at")).alias("p"))
    return b.select("fix_id", *[F.get("p", F.lit(k))["bucket"].alias(n) for k, n in enumerate(("day", "week", "month"))])


@query("""with t as (select event_id, cast(floor(epoch_us(ts) / 1000.0) as bigint) as now_ms, cast(floor(value) as integer) % 24 as h, cast(floor(value * 7) as integer) % 60 as m from events),
w as (select *, now_ms - now_ms % 86400000 + (h * 60 + m) * 60000 as t0 from t),
x as (select *, case when t0 - now_ms > 43200000 then t0 - 86400000 else t0 end as t1 from w)
select event_id, case when now_ms - t1 > 43200000 then t1 + 86400000 else t1 end as at_ms from x""")
def nearest_wall_time(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), F.pmod(F.floor("value").cast("int"), F.lit(24)).alias("h"), F.pmod(F.floor(F.col("value") * 7).cast("int"), F.lit(60)).alias("m"))
    return e.select("event_id", clock.near_time_ms(F.format_string("%02d:%02d", "h", "m"), F.col("now_ms")).alias("at_ms"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select fix_id, trim(replace(dest, '_', ' ')) as dest, operator || ':' || split_part(id, ':', 2) as id from bus_fixes where dest is not null and operator is not null and id is not null")
def xml_tag_scan(spark, d):
    from ferrywake.sources.feeds import activity_fields

    b = table(spark, d, "bus_fixes").where("dest is not null and operator is not null and id is not null")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<VehicleActivity><OperatorRef>"), esc(F.col("operator")), F.lit("</OperatorRef><VehicleRef>"), esc(F.split_part("id", F.lit(":"), F.lit(2))), F.lit("</VehicleRef><DestinationName>"), esc(F.col("dest")), F.lit("</DestinationName></VehicleActivity>"))
    f = activity_fields(xml)
    return b.select("fix_id", text.humanized(F.coalesce(f["DestinationName"], F.lit(""))).alias("dest"), F.concat_ws(":", f["OperatorRef"], f["VehicleRef"]).alias("id"))


# ---- joins -----------------------------------------------------------------------------------------------------------

@query("select p_partkey, l_suppkey, l_orderkey from part join lineitem on p_partkey = l_partkey qualify row_number() over (partition by p_partkey order by (l_suppkey % 4 = 0) desc, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1")
def preference_join(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    best = lookups.preferred(table(spark, d, "part").select("p_partkey"), li, ["p_partkey"], ["p_partkey"], [F.desc(F.col("l_suppkey") % 4 == 0), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_extendedprice")])
    return best.select("p_partkey", "l_suppkey", "l_orderkey")


_SPATIAL = f"c as (select c_custkey, {placed_sql('c_custkey')} from customer), s as (select s_suppkey, {placed_sql('s_suppkey')} from supplier)"


@query(f"with {_SPATIAL} select c_custkey, s_suppkey, round(d, 4) as d from (select c_custkey, s_suppkey, {hav_sql('c.lat', 'c.lon', 's.lat', 's.lon')} as d from c join s on s.lat between c.lat - 0.02 and c.lat + 0.02) where d <= 2000 qualify row_number() over (partition by c_custkey order by d, s_suppkey) = 1")
def nearest_within(spark, d):
    n = lookups.nearest_within(placed(table(spark, d, "customer"), "c_custkey"), "c_custkey", "lat", "lon", placed(table(spark, d, "supplier"), "s_suppkey"), "s_suppkey", "lat", "lon", 2000.0)
    return n.select("c_custkey", "s_suppkey", F.round("distance_m", 4).alias("d"))


@query(f"with {_SPATIAL} select c_custkey from c where not exists (select 1 from s where s.lat between c.lat - 0.02 and c.lat + 0.02 and {hav_sql('c.lat', 'c.lon', 's.lat', 's.lon')} < 2000)")
def spatial_anti(spark, d):
    return lookups.far_from(placed(table(spark, d, "customer"), "c_custkey"), "c_custkey", "lat", "lon", placed(table(spark, d, "supplier"), "s_suppkey"), "s_suppkey", "lat", "lon", 2000.0).select("c_custkey")


@query("select distinct upper(crs) as a, node from (select s_suppkey, case when s_suppkey % 5 = 0 then 'MKC' when s_suppkey % 5 = 1 then 'KGL' when s_suppkey % 5 = 2 then 'ZZZ' else 'LNY' end as crs from supplier) join (values ('MKC', 'KGL'), ('KGL', 'KGL'), ('LNY', 'LNY')) as m(c, node) on crs = c")
def gateway_snap(spark, d):
    s = table(spark, d, "supplier").select(F.get(F.array(*[F.lit(x) for x in ("MKC", "KGL", "ZZZ", "LNY", "LNY")]), F.pmod("s_suppkey", F.lit(5)).cast("int")).alias("crs"))
    stations = spark.createDataFrame([("KGL",), ("LNY",)], "crs string")
    return lookups.snapped(s, "crs", stations, rail.GATEWAYS).select(F.upper("crs").alias("a"), "node").distinct()


# ---- predictions (lineitem as a feed: order = train, line number = stop, quantity = countdown) -------------------------

_PRED = "preds as (select l_orderkey, l_linenumber, l_suppkey, cast(l_quantity as integer) as tts, l_returnflag, l_linestatus, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) as ord from lineitem)"


def _preds(spark, d):
    li = table(spark, d, "lineitem")
    order = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("tts"), "l_returnflag", "l_linestatus", "l_partkey", order.alias("o"))


@query("select l_orderkey, l_linenumber, tts from (select l_orderkey, l_linenumber, cast(l_quantity as integer) as tts, row_number() over (partition by l_orderkey order by cast(l_quantity as integer), l_linenumber) as n from lineitem) where n = 1")
def min_tts_per_train(spark, d):
    p = _preds(spark, d)
    return p.groupBy("l_orderkey").agg(F.min(F.struct("tts", "l_linenumber")).alias("b")).select("l_orderkey", "b.l_linenumber", "b.tts")


@query("select l_returnflag, l_suppkey, l_linestatus as owner from lineitem qualify row_number() over (partition by l_returnflag, l_suppkey order by cast(l_quantity as integer), l_orderkey * 10 + l_linenumber, l_linestatus) = 1")
def group_owner(spark, d):
    p = _preds(spark, d).withColumn("ord", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_linestatus"))
    return trains.group_owner(p, "l_returnflag", "l_suppkey", "l_linestatus", "tts", "ord")


@query("select count(*) as n, cast(sum(tts) as bigint) as tts from (select cast(l_quantity as integer) as tts, l_suppkey, l_partkey from lineitem where l_returnflag <> 'R') as p where not exists (select 1 from lineitem as o where o.l_returnflag = 'R' and o.l_suppkey = p.l_suppkey and o.l_partkey = p.l_partkey)")
def anti_join_ghosts(spark, d):
    p = _preds(spark, d)
    owned = p.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    return p.where("l_returnflag <> 'R'").join(owned, ["l_suppkey", "l_partkey"], "left_anti").agg(F.count("*").alias("n"), F.sum("tts").alias("tts"))


@query("""with least as (select l_linestatus, l_orderkey, l_linenumber, min(cast(l_quantity as integer)) as t from lineitem group by all)
select l_linestatus, l_orderkey, l_linenumber, t from least as b where not exists (select 1 from least as a where a.l_linestatus = b.l_linestatus and a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber - 1 and a.t < b.t)""")
def leading_edge_anti(spark, d):
    p = _preds(spark, d)
    previous = p.select("l_linestatus", "l_linenumber").distinct().select("l_linestatus", "l_linenumber", (F.col("l_linenumber") - 1).alias("prev_stop"))
    return trains.leading_edges(p, previous, ["l_linestatus", "l_orderkey"], "l_linenumber", "tts")


@query("select l_suppkey, l_orderkey, l_linenumber, tts, n as place from (select l_suppkey, l_orderkey, l_linenumber, cast(l_quantity as integer) as tts, row_number() over (partition by l_suppkey order by cast(l_quantity as integer), l_orderkey, l_linenumber, l_extendedprice) as n from lineitem) where n <= 8")
def station_board(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("tts"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"))
    return lookups.departures(li, ["l_suppkey"], "tts", "ord", 8).drop("ord")


@query("select l_orderkey, l_suppkey, min(cast(l_quantity as integer)) as tts from lineitem group by all")
def calling_pattern(spark, d):
    return lookups.calling_pattern(_preds(spark, d), ["l_orderkey"], "l_suppkey", "tts")


# ---- aggregates ------------------------------------------------------------------------------------------------------

@query("select l_partkey, list_sort(list(l_quantity))[cast(least(count(*) - 1, floor(0.9 * count(*))) as integer) + 1] as q90 from lineitem group by l_partkey")
def floor_quantile(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(routes.floor_quantile(F.collect_list("l_quantity"), 0.9).alias("q90"))


@query("with s as (select l_partkey, cast(l_quantity * 30 as bigint) as sec from lineitem where l_quantity * 30 <= 1800 and l_quantity > 0) select l_partkey, list_sort(list(sec))[cast(floor(count(*) / 2) as integer) + 1] as run_time_s, count(*) as samples from s group by l_partkey")
def upper_median(spark, d):
    s = table(spark, d, "lineitem").select("l_partkey", (F.col("l_quantity") * 30).cast("long").alias("sec"))
    return network.run_times(s, ["l_partkey"], "sec")


@query("""with n as (select l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_quantity, count(*) over (partition by l_partkey) as c, row_number() over (partition by l_partkey order by l_quantity, l_extendedprice, l_orderkey, l_linenumber) as r from lineitem)
select l_partkey, round(avg(l_extendedprice), 6) as l_extendedprice, count(*) as used from n where c >= 4 and r <= greatest(4, ceil(c * 0.8)) group by l_partkey""")
def trimmed_mean(spark, d):
    t = routes.trimmed_mean(table(spark, d, "lineitem"), ["l_partkey"], ["l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber"], ["l_extendedprice"])
    return t.select("l_partkey", F.round("l_extendedprice", 6).alias("l_extendedprice"), "used")


@query("select id, count(distinct line_id) as n_lines, string_agg(distinct line_id, ',' order by line_id) as lines, count(distinct line_id) >= 2 as interchange from (select properties.id as id, properties.line_id as line_id from district) group by id")
def interchange_stations(spark, d):
    s = table(spark, d, "district").select(F.col("properties.id").alias("id"), F.col("properties.line_id").alias("line_id"), F.col("properties.name").alias("name"))
    return latest.interchanges(s, "id", "line_id", "name", "name").select("id", "n_lines", "lines", "interchange")


@query("select l_suppkey, l_orderkey, l_extendedprice from lineitem qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey * 10 + l_linenumber) = 1")
def longest_shape(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return latest.longest(li, ["l_suppkey"], "l_extendedprice", "ord").drop("ord")


@query("select least(s_nationkey, c_nationkey) as lo, greatest(s_nationkey, c_nationkey) as hi, min(c_acctbal) as len_m from customer join supplier on c_custkey % 100 = s_suppkey group by 1, 2")
def shortest_per_pair(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    e = c.join(s, F.pmod(c["c_custkey"], F.lit(100)) == s["s_suppkey"]).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("c_acctbal").alias("len_m"))
    return rail.undirected_shortest(e).select("lo", "hi", "len_m")


@query("""with polls as (select user_id, event_id, epoch(ts)::bigint as t, event_type as stop, cast(value as integer) as tts from events),
l as (select *, lag(stop) over w as ps, lag(tts) over w as pt, lag(t) over w as p from polls window w as (partition by user_id order by event_id))
select user_id, count(*) filter (where ps = stop and tts - greatest(0, pt - (t - p)) > 15) as regressions, count(*) filter (where ps = stop and tts <= 15 and pt <= 15) as stuck_due, count(*) as n from l group by user_id""".replace("epoch(ts)::bigint", "cast(floor(epoch(ts)) as bigint)"))
def countdown_regressions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t"), F.col("event_type").alias("stop"), F.round("value").cast("int").alias("tts"))
    polls = e.withColumn("time", F.col("t"))
    return quality.countdown_regressions(polls, ["user_id"], "time", "stop", "tts", floor_div(F.col("t"), 604_800))


@query("""with p as (select distinct user_id, cast(floor(epoch(ts) / 86400) as bigint) as day from events), l as (select *, day - lag(day) over (partition by user_id order by day) - 1 as gap from p)
select user_id, count(*) filter (where gap > 0) as gaps, max(coalesce(gap, 0)) as longest, count(*) as n from l group by user_id""")
def feed_flicker(spark, d):
    p = table(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).cast("long").alias("day")).distinct()
    return quality.presence_gaps(p, ["user_id"], "day", floor_div(F.col("day"), 3650))


@query("""with days as (select cast(o_orderdate as date) as day, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as bytes from orders group by 1), j as (select *, date '1999-01-01' - day > 7 as old from days),
k as (select *, sum(case when old then 0 else bytes end) over (order by day desc rows unbounded preceding) as kept from j) select strftime(day, '%Y-%m-%d') as day, bytes, old from k where old or kept > 2147483648""")
def expired_partitions(spark, d):
    f = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.floor("o_totalprice").cast("long").alias("bytes"))
    days = f.groupBy("day").agg(F.sum("bytes").alias("bytes"))
    return quality.expired_partitions(days, "day", "bytes", F.lit("1999-01-01"))


# ---- graphs ----------------------------------------------------------------------------------------------------------

@query("""with recursive e as (select distinct s_suppkey as a, 1000000 + s_nationkey * 3 + s_suppkey % 3 as b from supplier), both_ways as (select a, b from e union select b, a from e),
walk as (select a as node, a as root from both_ways union select w.node, b.b from walk as w join both_ways as b on w.root = b.a)
select node, min(root) as component from walk group by node""")
def connected_components(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") * 3 + F.pmod("s_suppkey", F.lit(3)) + 1_000_000).alias("b"))
    return rail.components(e, "a", "b")


_NATION_GRAPH = "e as (select 'N' || n_nationkey as a, 'N' || ((n_nationkey + 1) % 25) as b, 100.0 + n_nationkey as len_m from nation union all select 'N' || n_nationkey, 'N' || ((n_nationkey * 7 + 3) % 25), 250.0 + 3 * n_nationkey from nation), g as (select a, b, len_m from e union all select b, a, len_m from e)"


def _nation_graph(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    name = lambda c: F.concat(F.lit("N"), c.cast("string"))
    point = lambda c: F.struct((c / 100.0).alias("lon"), F.lit(51.5).alias("lat"))
    ring, chord = F.pmod(F.col("n") + 1, F.lit(25)), F.pmod(F.col("n") * 7 + 3, F.lit(25))
    one = n.select(name(F.col("n")).alias("a"), name(ring).alias("b"), (F.lit(100.0) + F.col("n")).alias("len_m"), F.array(point(F.col("n")), point(ring)).alias("poly"))
    return one.unionByName(n.select(name(F.col("n")).alias("a"), name(chord).alias("b"), (F.lit(250.0) + 3 * F.col("n")).alias("len_m"), F.array(point(F.col("n")), point(chord)).alias("poly")))


@query(f"""with recursive {_NATION_GRAPH}, walk as (select a as start, b as node, len_m as m, 1 as k from g union select w.start, g.b, w.m + g.len_m, w.k + 1 from walk as w join g on w.node = g.a where w.k < 9 and w.m + g.len_m <= 60000)
select start as a, node as b, min(m) as len_m, start as first_node, node as last_node from walk where node <> start group by all""")
def rail_paths(spark, d):
    g = _nation_graph(spark, d)
    nodes = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("b"))
    pairs = nodes.join(nodes.select(F.col("b").alias("a")), F.col("a") != F.col("b"))  # a stated set: every pair of the 25 stations
    node = lambda p: F.concat(F.lit("N"), F.round(p["lon"] * 100).cast("int"))
    return rail.rail_paths(pairs, g).select("a", "b", "len_m", node(F.element_at("poly", 1)).alias("first_node"), node(F.element_at("poly", -1)).alias("last_node"))


# ---- filters, learners and displays: recursions and polylines that SQL can't say; tested numerically --------------------


def _strings(spark, d):
    """Three lines with ten stops each on the nation table's numbers, as branches."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n")).where("n < 24")
    stop = F.struct(F.concat(F.lit("S"), "n").alias("id"), F.concat(F.lit("Stop "), "n").alias("name"), (F.lit(-0.4) + F.col("n") * 0.0145).alias("lon"), F.lit(51.5).alias("lat"))
    lines = n.select(F.concat(F.lit("line"), F.pmod("n", F.lit(3))).alias("line_id"), "n", stop.alias("s")).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("v"))
    out = lines.select("line_id", F.transform("v", lambda x: x["s"]).alias("stops"))
    seg = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.transform(F.array(F.get("stops", i), F.get("stops", i + 1)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))
    ahead = out.select("line_id", F.lit(0).alias("branch_id"), F.lit("outbound").alias("direction"), "stops", seg.alias("segments"), F.lit(None).cast("array<int>").alias("run_times"))
    back = out.withColumn("stops", F.reverse("stops")).select("line_id", F.lit(1).alias("branch_id"), F.lit("inbound").alias("direction"), "stops", seg.alias("segments"), F.lit(None).cast("array<int>").alias("run_times"))
    return ahead.unionByName(back)


def _train_predictions(spark, d):
    e = table(spark, d, "events")
    n = F.pmod("user_id", F.lit(24))
    return e.select(
        F.concat(F.lit("line"), F.pmod(n, F.lit(3))).alias("line_id"), F.lit(None).cast("string").alias("line_name"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("vehicle_id"), F.concat(F.lit("S"), n).alias("naptan_id"),
        F.concat(F.lit("Stop "), n).alias("station_name"), F.round(F.col("value") * 20).cast("int").alias("time_to_station"), F.when(F.col("event_type") == "click", F.concat(F.lit("Approaching Stop "), n)).otherwise("Between stops").alias("current_location"), F.lit(None).cast("string").alias("platform_name"),
        F.when(F.col("event_id") % 2 == 0, "outbound").otherwise("inbound").alias("direction"), F.lit(None).cast("string").alias("destination_name"), F.lit(None).cast("string").alias("destination_naptan_id"), F.lit(None).cast("string").alias("towards"), F.col("event_id").alias("ord"),
    )


def _learned(spark, d):
    b = table(spark, d, "bus_fixes")
    t = b.select(F.concat_ws(":", "operator", "line", "direction").alias("k"), F.col("id").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.unix_seconds("recorded_at").alias("t"))
    return routes.learn_routes(t, min_journeys=2, min_fixes=8, min_s=300, min_m=1000.0)


@query()
def learn_route(spark, d):
    return _learned(spark, d)


@query()
def learner_summary(spark, d):
    return routes.learner_report(_learned(spark, d))


_SIM_SQL = """with l as (select n_nationkey as n, 5000.0 + 700 * n_nationkey as length_m, 36.0 + n_nationkey as kmh, 180 + 10 * n_nationkey as headway from nation),
j as (select *, length_m / (kmh / 3.6) as journey_s, unnest([1, -1]) as heading from l), k as (select *, unnest(range(0, cast(ceil(journey_s / headway) as bigint) + 1)) as k from j),
f as (select *, floor((1785000000.0 - case when heading = 1 then 0 else 0.5 * headway end) / headway) * headway + case when heading = 1 then 0 else 0.5 * headway end - k * headway as departed_s from k)
select 'L' || n as line_id, heading, departed_s, round(case when heading = 1 then (1785000000.0 - departed_s) / journey_s else 1 - (1785000000.0 - departed_s) / journey_s end * length_m, 4) as metres,
round(case when heading = 1 then (1785000000.0 - departed_s) / journey_s else 1 - (1785000000.0 - departed_s) / journey_s end * 0.1, 7) as lon, round((degrees(atan2(0.1 * {lon}, 0.1 * 110540.0)) + case when heading = 1 then 0 else 180 end) % 360, 5) as bearing from f where (1785000000.0 - departed_s) / journey_s between 0 and 1""".replace("{lon}", repr(geo.metres_per_lon()))


@query(_SIM_SQL)
def simulate_trains(spark, d):
    from ferrywake.operators.tracking import simulate_trains as fly

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    poly = F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(51.5).alias("lat")), F.struct(F.lit(0.1).alias("lon"), F.lit(51.6).alias("lat")))
    lines = n.select(F.concat(F.lit("L"), "n").alias("line_id"), poly.alias("poly"), (F.lit(5000.0) + 700 * F.col("n")).alias("length_m"), (F.lit(36.0) + F.col("n")).alias("speed_kmh"), (F.lit(180) + 10 * F.col("n")).alias("headway_peak_s"), (F.lit(180) + 10 * F.col("n")).alias("headway_off_s"))
    hours = F.array(*[F.struct(F.lit(0.0).alias("open"), F.lit(24.0).alias("close")) for _ in range(7)])
    out = fly(lines, hours, [(7.0, 10.0)], 4.0, F.timestamp_seconds(F.lit(1_785_000_000)))
    return out.select("line_id", "heading", "departed_s", F.round("metres", 4).alias("metres"), F.round("lon", 7).alias("lon"), F.round("bearing", 5).alias("bearing"))
