"""Queries of joins, aggregates, trains, tracks and recursive filters over the test tables, each with the same question in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from ferrywake.functions import geo, polyline
from ferrywake.operators import latest, leaderboard, lookups, network, quality, rail, routes, tracking, trains
from ferrywake.operators.series import floor_div
from ferrywake.plans.fixes import hav_sql, placed, placed_sql
from ferrywake.plans.function_queries import nth, nth_sql
from ferrywake.plans import read_api
from ferrywake.plans.reference_queries import _EVENT_SQL, _TOTALS_SQL, _judged_events, _strings, _train_predictions, query, r6
from ferrywake.session import materialize, table

LON, LAT = repr(geo.metres_per_lon()), "110540.0"
_PLACED = f"c as (select c_custkey, c_name, {placed_sql('c_custkey')} from customer), s as (select s_suppkey, {placed_sql('s_suppkey')} from supplier)"


def _customers(spark, d):
    return placed(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


def _suppliers(spark, d):
    return placed(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


# ---- lookups -----------------------------------------------------------------------------------------------------------

@query(f"with {_PLACED} select c_custkey as nid, s_suppkey as sid from (select c_custkey, s_suppkey, {hav_sql('c.lat', 'c.lon', 's.lat', 's.lon')} as d from c join s on s.lat between c.lat - 0.01 and c.lat + 0.01) where d <= 800 qualify row_number() over (partition by c_custkey order by d, s_suppkey) = 1")
def station_zones(spark, d):
    return network.zones(_customers(spark, d).withColumnRenamed("c_custkey", "nid"), _suppliers(spark, d).withColumnRenamed("s_suppkey", "sid"), 800.0).select("nid", "sid")


@query(f"""with recursive {_PLACED}, pairs as (select s_suppkey as sid, c_custkey as nid, {hav_sql('s.lat', 's.lon', 'c.lat', 'c.lon')} as d from s join c on c.lat between s.lat - 0.015 and s.lat + 0.015 where {hav_sql('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 1500),
wish as (select row_number() over (order by sid) as k, sid, list({{'nid': nid, 'd': d}} order by d, nid) as w from pairs group by sid),
walk as (select 0::bigint as k, []::bigint[] as taken, null::bigint as sid, null::bigint as nid
  union all select k, list_append(taken, nid), sid, nid from (select wish.k, walk.taken, wish.sid, list_filter(wish.w, lambda x: not list_contains(walk.taken, x.nid))[1].nid as nid from walk join wish on wish.k = walk.k + 1))
select walk.sid, walk.nid, round(d, 3) as distance_m from walk join pairs using (sid, nid)""")
def assign_nodes(spark, d):
    s = _suppliers(spark, d).select(F.col("s_suppkey").alias("sid"), "lat", "lon", F.col("s_suppkey").alias("ord"))
    n = _customers(spark, d).select(F.col("c_custkey").alias("nid"), "lat", "lon")
    return network.assign_distinct(s, n, 1500.0).select("sid", "nid", F.round("distance_m", 3).alias("distance_m"))


_LIFTS = """m as (select p_partkey as ord, case when p_partkey % 3 = 0 then '9100' || p_partkey % 40 end as uid, case when p_partkey % 3 = 1 then 'Customer#' || lpad((p_partkey * 5)::varchar, 9, '0') || ' Lifts' end as stop_name,
case when p_partkey % 7 = 0 then '' when p_partkey % 3 = 2 then 'At Customer#' || lpad((p_partkey * 3)::varchar, 9, '0') || ' no lift, see Customer#000000001' else 'No step-free access ' || p_partkey end as message from part where p_partkey <= 300)"""


@query(f"""with {_LIFTS}, st as (select '9100' || c_custkey as naptan, c_name as name from customer)
select naptan, arg_min(message, ord) as message from st join m on message <> '' and ((uid is not null and (starts_with(naptan, uid) or starts_with(uid, naptan))) or (stop_name is not null and contains(lower(stop_name), lower(trim(name)))) or contains(lower(substr(message, 1, 60)), lower(trim(name)))) group by naptan, name""")
def lift_messages(spark, d):
    p = table(spark, d, "part").where("p_partkey <= 300").withColumn("k", F.col("p_partkey"))
    named = lambda n: F.concat(F.lit("Customer#"), F.lpad((F.col("k") * n).cast("string"), 9, "0"))
    message = F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 3 == 2, F.concat(F.lit("At "), named(3), F.lit(" no lift, see Customer#000000001"))).otherwise(F.concat(F.lit("No step-free access "), "k"))
    entries = p.select(F.col("k").alias("ord"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("9100"), F.col("k") % 40)).alias("uid"), F.when(F.col("k") % 3 == 1, F.concat(named(5), F.lit(" Lifts"))).alias("stop_name"), message.alias("message"))
    stations = table(spark, d, "customer").select(F.concat(F.lit("9100"), "c_custkey").alias("naptan"), F.col("c_name").alias("name"))
    return lookups.lift_disruption(stations, entries).select("naptan", "message")


@query(f"""with {_PLACED}, r as (select c_custkey, {nth_sql('c_custkey', 'bus:', 'ship:tfl:', 'ship:', 'train:nr:', 'tube:', 'x:')} || c_custkey % 200 as id from customer)
select r.c_custkey, id, case when c_custkey % 6 in (0, 1, 2, 4) then round(s.lon, 6) end as lon from r left join s on s.s_suppkey = r.c_custkey % 200""")
def board_positions(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(nth("c_custkey", "bus:", "ship:tfl:", "ship:", "train:nr:", "tube:", "x:"), F.col("c_custkey") % 200).alias("id"))
    live = _suppliers(spark, d).select(F.col("s_suppkey").alias("id"), "lon", "lat")
    return leaderboard.located(rows, {"buses": live, "boats": live, "vessels": live, "trains": live}).select("c_custkey", "id", F.round("lon", 6).alias("lon"))


@query("select event_id, coalesce(n_name, 'L' || event_id % 30) as line_name, case when n_nationkey is not null then case when n_nationkey % 2 = 0 then 'd' || n_nationkey else 'c' || n_nationkey end end as color from events left join nation on n_nationkey = event_id % 30")
def line_styles(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("L"), F.col("event_id") % 30).alias("line_id"))
    n = table(spark, d, "nation")
    lines = n.select(F.concat(F.lit("L"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("c"), "n_nationkey").alias("color"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("d"), "n_nationkey")).alias("display_color"))
    return leaderboard.styled(rows, lines).select("event_id", "line_name", "color")


@query("with r as (select 'A' || n_nationkey || ':1/2:out' as key, n_nationkey as n from nation) select fix_id, r.n as route from bus_fixes left join r on r.key = 'A' || fix_id % 40 || ':1/2:out'")
def buses_with_routes(spark, d):
    b = table(spark, d, "bus_fixes").select("fix_id", F.concat(F.lit("A"), F.col("fix_id") % 40).alias("operator"), F.lit("1/2").alias("line"), F.lit("out").alias("direction"))
    stored = table(spark, d, "nation").select(F.concat(F.lit("A"), "n_nationkey", F.lit(":1_2:out")).alias("key"), F.col("n_nationkey").alias("route"))
    return lookups.with_route(b, stored).select("fix_id", "route")


@query("""with st as (select s_suppkey, s_name from supplier), m as (select c_custkey % 700 as stop_id, min(c_custkey % 90) as station_id from customer where c_custkey % 4 = 0 group by 1),
n as (select lower('Stop ' || s_suppkey % 60) as name, arg_min(s_suppkey, s_suppkey) as station_id from supplier group by 1)
select p_partkey as stop_id, coalesce(m.station_id, n.station_id) as station_id from part left join m on m.stop_id = p_partkey left join n on n.name = 'stop ' || p_partkey % 80""")
def stations_of_stops(spark, d):
    stops = table(spark, d, "part").select(F.col("p_partkey").alias("stop_id"), F.concat(F.lit("STOP "), F.col("p_partkey") % 80).alias("name"))
    members = table(spark, d, "customer").where("c_custkey % 4 = 0").select((F.col("c_custkey") % 700).alias("stop_id"), (F.col("c_custkey") % 90).alias("station_id"))
    stations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id"), F.concat(F.lit("Stop "), F.col("s_suppkey") % 60).alias("name"), F.col("s_suppkey").alias("ord"))
    return network.station_of_stop(stops, members, stations).select("stop_id", "station_id")


@query("""with s as (select l_orderkey as line, l_linenumber as ord, case when l_returnflag = 'N' then 'Good Service' else 'Delay ' || l_linestatus end as d, l_shipmode as r from lineitem),
g as (select line, d, min(ord) as ord from s where d <> 'Good Service' group by line, d), h as (select line, r, min(ord) as ord from s where d <> 'Good Service' group by line, r),
t as (select line, string_agg(d, ', ' order by ord, d) as description from g group by line), u as (select line, string_agg(r, '|' order by ord, r) as reasons from h group by line)
select line, coalesce(description, '') as description, coalesce(reasons, '') as reasons from (select distinct line from s) left join t using (line) left join u using (line)""".replace("l_shipmode", "'R' || l_suppkey % 3"))
def disruption_lines(spark, d):
    li = table(spark, d, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "N", "Good Service").otherwise(F.concat(F.lit("Delay "), "l_linestatus")).alias("description"), F.concat(F.lit("R"), F.col("l_suppkey") % 3).alias("reason")).count()
    t = lookups.disruption_text(s, "line")
    return t.select("line", "description", F.array_join("reasons", "|").alias("reasons"))


@query(f"""with {_PLACED}, near as (select distinct s_suppkey, c_custkey % 5 as line from s join c on c.lat between s.lat - 0.03 and s.lat + 0.03 where {hav_sql('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 1000)
select s_suppkey, string_agg('L' || line, ',' order by line) as lines from near group by s_suppkey""")
def lines_at_stations(spark, d):
    v = _customers(spark, d).select(F.col("c_custkey").alias("vid"), F.concat(F.lit("L"), F.col("c_custkey") % 5).alias("line_id"), "lat", "lon")
    return lookups.lines_at(_suppliers(spark, d), "s_suppkey", "lat", "lon", v, 1000.0).select("s_suppkey", F.array_join("lines", ",").alias("lines"))


# ---- counts, samples, probes -------------------------------------------------------------------------------------------

@query("select id, count(*) as fixes from bus_fixes where id is not null group by id")
def trace_counts(spark, d):
    return quality.fix_counts(table(spark, d, "bus_fixes").where("id is not null"), "id")


@query("select event_id from (select event_id, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by event_id) as r from events) where (r - 1) % greatest(1, n // 500) = 0")
def systematic_sample(spark, d):
    return quality.systematic(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 500).select("event_id")


@query("""with p as (select user_id, event_id // 500 as poll, event_id % 4 as stop, event_id % 3 as dest, event_id from events), o as (select user_id, poll, arg_max(stop, event_id) as stop, arg_max(dest, event_id) as dest from p group by 1, 2),
l as (select user_id, max(poll) as seen, arg_max(stop, poll) as stop, arg_max(dest, poll) as dest from o group by 1) select user_id, case when stop = dest then 'destination' else 'mid-route' end as at_ from l where seen < (select max(poll) from o)""")
def vanished_vehicles(spark, d):
    e = table(spark, d, "events").withColumn("poll", floor_div(F.col("event_id"), 500))
    polls = e.groupBy("user_id", "poll").agg(F.max_by(F.col("event_id") % 4, "event_id").alias("stop"), F.max_by(F.col("event_id") % 3, "event_id").alias("dest"))
    return quality.vanished(polls, "user_id", "poll", "stop", "dest").withColumnRenamed("where", "at_")


@query("select count(*) filter (where o = 'learned') as learned, count(*) filter (where o = 'insufficient') as insufficient, count(*) filter (where o = 'bad-geometry') as bad_geometry, round(avg(case when o = 'learned' then p_size + 0.5 end), 6) as mean_residual_m from (select p_size, case p_partkey % 3 when 0 then 'learned' when 1 then 'insufficient' else 'bad-geometry' end as o from part)")
def learner_counts(spark, d):
    p = table(spark, d, "part").select(nth("p_partkey", "learned", "insufficient", "bad-geometry").alias("outcome"), (F.col("p_size") + 0.5).alias("mean_residual_m"))
    return routes.learner_report(p).withColumn("mean_residual_m", F.round("mean_residual_m", 6))


@query("select o_orderkey as k, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) as line from (select l_orderkey as o_orderkey, l_linenumber, l_suppkey from lineitem) group by 1")
def distinct_shapes(spark, d):
    """Lines with equal ends and size count once, whichever of them; ways by id, the last, without the taken ones."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("line"))
    point = lambda c: F.struct(c.cast("double").alias("lon"), F.lit(51.5).alias("lat"))
    twice = li.withColumn("poly", F.array(point(F.col("l_orderkey")), point(F.col("line")))).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return network.distinct_lines(twice, "poly").select(F.col("l_orderkey").alias("k"), "line")


@query("select l_suppkey as way, max(l_orderkey * 10 + l_linenumber) as newest from lineitem where l_suppkey % 3 <> 0 group by 1")
def unused_ways(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("way"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("newest"))
    taken = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("way"))
    return network.unused_ways(w, taken, "way", "newest")


# ---- filters that recurse ------------------------------------------------------------------------------------------------

@query("""with recursive e as (select user_id, event_id, cast(floor(epoch_us(ts) / 1000.0) as bigint) as ms from events), o as (select *, row_number() over (partition by user_id order by ms, event_id) as n from e),
walk as (select user_id, n, event_id, [ms] as recent, true as ok from o where n = 1
  union all select user_id, n, event_id, case when len(kept) < 3 then list_append(kept, ms) else kept end, len(kept) < 3 from (select o.*, list_filter(walk.recent, lambda x: o.ms - x < 86400000) as kept from walk join o on o.user_id = walk.user_id and o.n = walk.n + 1))
select user_id, event_id, ok as admitted from walk""")
def rate_limit_admission(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return latest.admitted(e, "user_id", "ms", "event_id", 3, 86_400_000).select("user_id", "event_id", "admitted")


@query(f"""with recursive f as (select id, fix_id, epoch_ms(recorded_at) as t, lon * {LON} as x, lat * {LAT} as y from bus_fixes where id is not null and recorded_at is not null and lat is not null and lon is not null),
o as (select *, row_number() over (partition by id order by t, fix_id) as n from f),
walk as (select id, n, fix_id, t, x as ax, y as ay, t as at_ from o where n = 1
  union all select o.id, o.n, o.fix_id, o.t, case when far then o.x else ax end, case when far then o.y else ay end, case when far then o.t else at_ end
  from (select o.*, walk.ax, walk.ay, walk.at_, sqrt(pow(o.x - walk.ax, 2) + pow(o.y - walk.ay, 2)) > 60 as far from walk join o on o.id = walk.id and o.n = walk.n + 1) as o)
select fix_id, t - at_ > 1200000 as parked from walk""")
def parked_buses(spark, d):
    b = table(spark, d, "bus_fixes").where("recorded_at is not null")
    p = tracking.parked(b.select("id", F.unix_millis("recorded_at").alias("t_ms"), F.col("fix_id").alias("ord"), (F.col("lon") * geo.metres_per_lon()).alias("x"), (F.col("lat") * geo.M_PER_DEG_LAT).alias("y")))
    return p.select(F.col("ord").alias("fix_id"), "parked")


@query(f"""with recursive m as (select id, fix_id, (lat - 51.5) * {LAT} as z, epoch_ms(recorded_at)::double as t from bus_fixes where id is not null and lat is not null and recorded_at is not null),
o as (select *, row_number() over (partition by id order by fix_id) as n from m),
walk as (select id, n, fix_id, z as s, 0.0::double as v, t, 900.0::double as ps, 9.0::double as pv, 0.0::double as psv, 0 as rej, 'init' as result from o where n = 1
  union all
  select id, n, fix_id, case when reset then z when gate then s1 else s1 + ps1 / tot * (z - s1) end, case when reset then 0.0 when gate then v else greatest(-20.0, least(20.0, v + psv1 / tot * (z - s1))) end, case when reset then zt else greatest(t, zt) end,
    case when reset then 900.0 when gate then ps1 else ps1 - ps1 / tot * ps1 end, case when reset then 9.0 when gate then pv1 else pv1 - psv1 / tot * psv1 end, case when reset then 0.0 when gate then psv1 else psv1 - ps1 / tot * psv1 end,
    case when reset then 0 when gate then rej + 1 else 0 end, case when reset then 'reset' when gate then 'gated' else 'accepted' end
  from (select *, gate and rej + 1 >= 3 as reset from (select *, pow(z - s1, 2) > 9 * tot as gate from (select *, ps1 + 225.0 as tot from (
    select *, s + v * dt as s1, ps + 2 * dt * psv + dt * dt * pv + 2.0 * dt * dt * dt / 3 as ps1, psv + dt * pv + dt * dt as psv1, pv + 2.0 * dt as pv1
    from (select o.id, o.n, o.fix_id, o.z, o.t as zt, w.s, w.v, w.t, w.ps, w.pv, w.psv, w.rej, greatest(0.0, (o.t - w.t) / 1000.0) as dt from walk as w join o on o.id = w.id and o.n = w.n + 1))))))
select fix_id, round(s, 3) + 0.0 as s, round(v, 4) + 0.0 as v, result from walk""")
def kalman_filter(spark, d):
    b = table(spark, d, "bus_fixes").where("id is not null and lat is not null and recorded_at is not null")
    m = b.select(F.col("id").alias("vehicle_id"), F.col("fix_id").alias("ord"), ((F.col("lat") - 51.5) * geo.M_PER_DEG_LAT).alias("s_m"), F.unix_millis("recorded_at").alias("t_ms"), F.lit(225.0).alias("r_var"), F.lit(None).cast("double").alias("v0"))
    return tracking.kalman(m).select(F.col("ord").alias("fix_id"), (F.round("s", 3) + 0.0).alias("s"), (F.round("v", 4) + 0.0).alias("v"), "result")


@query("""with recursive st as (select n_nationkey as id, k * 10000 as t, n_nationkey * 10.0 + k * (60 + n_nationkey * 4) as s, 8.0 as v from nation, range(0, 4) as r(k)),
tick as (select n_nationkey as id, k as n, k * 2500 as t from nation, range(0, 16) as r(k)),
goal as (select tick.id, tick.n, tick.t, arg_max(st.s, st.t) + arg_max(st.v, st.t) * 12 * (1 - exp(-((tick.t - max(st.t)) / 1000.0) / 12)) as target from tick join st on st.id = tick.id and st.t <= tick.t group by 1, 2, 3),
walk as (select id, n, t, target, target as shown from goal where n = 0 union all
  select g.id, g.n, g.t, g.target, case when g.target - w.shown > 1200 then g.target when g.target <= w.shown then w.shown else w.shown + least((g.target - w.shown) * (1 - exp(-2.5 / 2.5)), 25 * 2.5) end from walk as w join goal as g on g.id = w.id and g.n = w.n + 1)
select id, t as t_ms, round(target, 5) as target_m, round(shown, 5) as shown_m from walk""")
def displayed_buses(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    states = n.withColumn("k", k).select("id", (F.col("k") * 10_000).cast("long").alias("t_ms"), (F.col("id") * 10.0 + F.col("k") * (60 + F.col("id") * 4)).alias("s"), F.lit(8.0).alias("v"))
    ticks = spark.range(0, 40_000, 2_500).select(F.col("id").alias("t_ms"))
    return tracking.shown_buses(states, ticks).select("id", "t_ms", F.round("target_m", 5).alias("target_m"), F.round("shown_m", 5).alias("shown_m"))


# ---- trains --------------------------------------------------------------------------------------------------------------

_POLL = """p as (select event_id as ord, 'line' || user_id % 24 % 3 as line_id, case when event_type <> 'error' then user_id::varchar end as vehicle_id, 'S' || user_id % 24 as naptan, user_id % 24 as stop_no, cast(round_even(value * 20, 0) as integer) as tts,
  case when event_type = 'click' then 'Approaching Stop ' || user_id % 24 else 'Between stops' end as place, case when event_id % 2 = 0 then 'outbound' else 'inbound' end as dir from events),
ids as (select distinct line_id, place from p where vehicle_id is not null),
ways as (select line_id, place, count(distinct dir) as n from p where vehicle_id is null group by 1, 2),
kept as (select p.*, case when vehicle_id is not null then line_id || ':' || vehicle_id when ids.line_id is not null then null when ways.n >= 2 then line_id || '|' || place || '|' || dir else line_id || '|' || place end as key
  from p left join ids using (line_id, place) left join ways using (line_id, place))"""


@query(f"with {_POLL} select ord, key, vehicle_id is null as synthetic from kept where key is not null".replace("round_even(value * 20, 0)", "floor(value * 20 + 0.5)"))
def collapsed_predictions(spark, d):
    """Identified trains by line and number; what an identified one already stands for is a ghost and falls; blocks split by direction."""
    branches = _strings(spark, d).withColumn("branch_ord", F.col("branch_id"))
    return trains.collapse(_train_predictions(spark, d), branches).select("ord", "key", "synthetic")


_BRANCH = """stop as (select n_nationkey as stop_no, 'line' || n_nationkey % 3 as line_id, n_nationkey // 3 as k, -0.4 + n_nationkey * 0.0145 as lon from nation where n_nationkey < 24),
on_branch as (select line_id, 'outbound' as dir, 0 as branch, k as idx, stop_no, lon from stop union all select line_id, 'inbound', 1, 7 - k, stop_no, lon from stop)"""
_INFER = f"""best as (select key, arg_min({{'line_id': line_id, 'vehicle_id': vehicle_id, 'stop_no': stop_no, 'tts': tts, 'place': place, 'dir': dir}}, tts::bigint * 1000000000 + ord) as r from kept where key is not null group by key),
at_stop as (select key, stop_no, arg_min({{'tts': tts, 'place': place}}, tts::bigint * 1000000000 + ord) as nx from kept where key is not null group by 1, 2),
own as (select b.key, r.line_id as line_id, r.dir as dir, r.tts as tts, r.place as place, ob.branch, ob.idx from best as b join on_branch as ob on ob.line_id = r.line_id and ob.dir = r.dir and ob.stop_no = r.stop_no),
moved as (select own.*, s.stop_no as succ, nx from own left join on_branch as s on own.tts <= 15 and s.line_id = own.line_id and s.dir = own.dir and s.idx = own.idx + 1 left join at_stop as a on a.key = own.key and a.stop_no = s.stop_no),
now as (select key, line_id, dir, branch, case when nx is null then tts else nx.tts end as tts, case when nx is null then place else nx.place end as place, case when nx is null then idx else idx + 1 end as idx from moved),
seg as (select now.*, here.stop_no, here.lon as lon2, prev.lon as lon1, idx = 0 or tts <= 15 as arrived, greatest(45.0, least(300.0, abs(here.lon - prev.lon) * {LON} / 12.0)) as base from now join on_branch as here using (line_id, dir, idx) left join on_branch as prev on prev.line_id = now.line_id and prev.dir = now.dir and prev.idx = now.idx - 1),
run as (select *, case when not arrived then case when place = 'Between stops' and tts + 20 > base then tts + 20.0 else base end end as run_s from seg),
frac as (select *, case when arrived then 1.0 else case when place = 'Approaching Stop ' || stop_no then greatest(1 - least(1.0, tts / run_s), 0.85) else 1 - least(1.0, tts / run_s) end end as f from run)"""


@query(f"with {_POLL}, {_BRANCH}, {_INFER} select key, 'S' || stop_no as next_stop_id, tts as time_to_station, round(run_s, 6) as run_time_s, round(f, 6) as segment_frac, round(case when arrived then lon2 else lon1 + (lon2 - lon1) * f end, 6) as lon, case when idx > 0 then line_id || ':' || branch || ':' || dir || ':' || idx else '' end as segment_key from frac".replace("round_even(value * 20, 0)", "floor(value * 20 + 0.5)"))
def infer_positions(spark, d):
    out = trains.infer_trains(_train_predictions(spark, d), _strings(spark, d))
    return out.select("key", "next_stop_id", "time_to_station", F.round("run_time_s", 6).alias("run_time_s"), F.round("segment_frac", 6).alias("segment_frac"), F.round("lon", 6).alias("lon"), "segment_key")


@query("""with p as (select l_orderkey, l_linenumber, s_nationkey, case when l_orderkey % 3 = 0 then '' else case when l_orderkey % 2 = 0 then 'outbound' else 'inbound' end end as dir, l_orderkey % 8 as stop_no, l_suppkey % 5 as prev from lineitem join supplier on l_suppkey = s_suppkey),
b as (select k as branch, case when k % 2 = 0 then 'outbound' else 'inbound' end as b_dir, i as idx, (i * (k + 1)) % 8 as stop_no, (7 * (k + 1)) % 8 as last from range(0, 5) as r(k), range(0, 8) as q(i)), f as (select branch, b_dir, stop_no, last, min(idx) as idx from b group by all),
c as (select p.l_orderkey, p.l_linenumber, f.branch, f.idx, case when f.branch = p.prev then 0 when 'stop ' || f.last = 'stop ' || p.s_nationkey % 8 then 1 when f.idx > 0 then 2 else 3 end as prio from p join f on f.stop_no = p.stop_no and (p.dir = '' or p.dir = f.b_dir))
select l_orderkey, l_linenumber, branch, idx from c qualify row_number() over (partition by l_orderkey, l_linenumber order by prio, branch) = 1""".replace("from lineitem join", "from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by 1, 2) as lineitem join"))
def candidate_priority_join(spark, d):
    """The branch a prediction belongs to: the one it had, else the one to its destination, else the first mid-branch, else the first."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s_suppkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    way = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.when(F.col("l_orderkey") % 2 == 0, "outbound").otherwise("inbound"))
    preds = li.select("l_orderkey", "l_linenumber", F.lit("x").alias("line_id"), F.concat(F.lit("S"), F.col("l_orderkey") % 8).alias("naptan_id"), way.alias("direction"), F.concat(F.lit("Stop "), F.col("s_nationkey") % 8).alias("destination_name"), F.lit(None).cast("string").alias("towards"), (F.col("s_suppkey") % 5).cast("int").alias("prev_branch"))
    preds = preds.withColumn("prev_dir", F.when(F.col("prev_branch") % 2 == 0, "outbound").otherwise("inbound"))
    k = spark.range(5).select(F.col("id").cast("int").alias("branch_id"))
    stops = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.concat(F.lit("S"), (i * (F.col("branch_id") + 1)) % 8).alias("id"), F.concat(F.lit("Stop "), (i * (F.col("branch_id") + 1)) % 8).alias("name")))
    branches = k.select(F.lit("x").alias("line_id"), "branch_id", F.when(F.col("branch_id") % 2 == 0, "outbound").otherwise("inbound").alias("direction"), F.col("branch_id").alias("branch_ord"), stops.alias("stops"))
    out = trains.chosen(trains.candidates(preds, branches), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.col("branch_id").alias("branch"), F.col("stop_index").alias("idx"))


def _inferred_polls(spark, d):
    t = trains.infer_trains(_train_predictions(spark, d), _strings(spark, d))
    polls = t.withColumn("poll_ms", F.explode(F.array(F.lit(0).cast("long"), F.lit(10_000).cast("long")))).withColumn("received_at", F.col("poll_ms"))
    polls = polls.withColumn("time_to_station", F.col("time_to_station") - F.expr("cast(poll_ms / 1000 as int)"))
    return polls.select("poll_ms", "key", "line_id", "direction", "segment", "segment_frac", "segment_key", "time_to_station", "run_time_s", "received_at", "synthetic", "destination_id", "next_stop_id", "lon", "lat", "bearing")


_EASE = "{f} + (greatest(f, case when run_s is null then f else 1 - least(1.0, greatest(0.0, {left}) / run_s) end) - {f}) * (1 - exp(-5.0 / 4.0))"


@query((f"""with {_POLL}, {_BRANCH}, {_INFER}, t1 as (select *, {_EASE.format(f='f', left='tts - 5.0')} as f1, floor(0.5 * (tts - 10) + 0.5 * greatest(0, tts - 10) + 0.5) as due from frac),
t2 as (select *, {_EASE.format(f='f1', left='due')} as f2 from t1), t3 as (select *, {_EASE.format(f='f2', left='due - 5.0')} as f3 from t2),
o as (select *, unnest([0, 5000, 10000, 15000]) as t_ms, unnest([f, f1, f2, f3]) as shown from t3)
select key, t_ms, round(shown, 6) as frac, round(case when idx = 0 then lon2 else lon1 + (lon2 - lon1) * shown end, 6) + 0.0 as lon, 1.0::double as opacity from o""").replace("round_even(value * 20, 0)", "floor(value * 20 + 0.5)"))
def interpolate(spark, d):
    """Shown trains at four ticks over two polls."""
    ticks = spark.range(0, 20_000, 5_000).select(F.col("id").alias("t_ms"))
    out = tracking.interpolate(_inferred_polls(spark, d), ticks)
    return out.select("key", "t_ms", F.round("frac", 6).alias("frac"), r6("lon").alias("lon"), F.when(F.col("opacity") < 1, F.col("opacity")).otherwise(1.0).alias("opacity"))


@query(f"""with src as (select report_id as ord, mmsi::varchar as id, {nth_sql('mmsi', 'ship', 'bus', 'tube', 'nr')} as mode, lat, lon, last_seen as t from vessels where lat is not null and lon is not null and mmsi is not null and last_seen is not null),
l as (select *, t - lag(t) over w as gap, {hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as m from src window w as (partition by id order by ord)),
j as (select *, case when gap is null then 'first' when gap <= 0 or gap > 300000 then 'gap' when m < 5 then 'jitter' when m / (gap / 1000.0) > case mode when 'ship' then 25 when 'nr' then 65 else 40 end then 'teleport' else 'ok' end as outcome from l)
select mode, outcome, count(*) as n, round(sum(m) / 1000, 3) as km from j group by 1, 2""")
def mode_speed_caps(spark, d):
    """Outcomes of fixes of all modes, each with its own speed cap."""
    v = table(spark, d, "vessels").select(F.col("report_id").alias("ord"), F.col("mmsi").cast("string").alias("id"), nth("mmsi", "ship", "bus", "tube", "nr").alias("mode"), "lat", "lon", F.col("last_seen").alias("t_ms"), F.col("last_seen").alias("tick_ms"), F.lit("x").alias("label"), F.lit("x").alias("line_id"))
    judged = leaderboard.outcomes(v, caps=leaderboard.SPEED_CAPS, time_policy="fix")
    return judged.groupBy("mode", "outcome").agg(F.count("*").alias("n"), F.round(F.sum("move_m") / 1000, 3).alias("km"))


@query("select 'line' || n % 4 as line_id, case n % 4 when 0 then 'ship' else 'tube' end as mode, count(*) as n from (select n_nationkey as n from nation where n_nationkey % 5 <> 0 and n_nationkey % 3 <> 0) group by 1, 2".replace("'line' || n % 4", "case n % 4 when 0 then 'rb1' else 'line' || n % 4 end"))
def creditable_trains(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    t = n.select(F.when(F.col("n") % 4 == 0, "rb1").otherwise(F.concat(F.lit("line"), F.col("n") % 4)).alias("line_id"), F.col("n").cast("string").alias("key"), F.when(F.col("n") % 3 != 0, F.col("n").cast("string")).alias("vehicle_id"), (F.col("n") % 5 == 0).alias("synthetic"), F.lit(51.5).alias("lat"), F.lit(0.1).alias("lon"))
    return leaderboard.creditable(t).groupBy("line_id", "mode").agg(F.count("*").alias("n"))


_TRIPS = """stops as (select o_orderkey as rid, l_linenumber as i, 'C' || l_suppkey % 25 as crs, 1000 * (l_linenumber * 600 + l_partkey % 300) as time from (select l_orderkey as o_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey from lineitem group by 1, 2))"""


def _services(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    stop = F.struct(F.col("l_linenumber").alias("i"), F.concat(F.lit("C"), F.col("s") % 25).alias("crs"), F.concat(F.lit("Stop "), F.col("s") % 25).alias("name"), (F.lit(1000) * (F.col("l_linenumber") * 600 + F.col("p") % 300)).cast("long").alias("time"))
    return li.groupBy(F.col("l_orderkey").alias("rid")).agg(F.array_sort(F.collect_list(stop)).alias("stops")).select("rid", F.lit("SWR").alias("operator"), F.lit("X").alias("destination"), F.transform("stops", lambda s: s.dropFields("i")).alias("stops"))


@query(f"""with {_TRIPS}, o as (select *, lead(crs) over w as to_crs, lead(time) over w as to_time, min(i) over (partition by rid) as first_i, row_number() over w as n from stops window w as (partition by rid order by i)),
live as (select rid from o where n = 1 and time <= 1800000) select rid, arg_min(crs, n) as from_crs, arg_min(to_crs, n) as to_crs from o join live using (rid) where to_time > 1800000 group by rid""")
def trains_between_stops(spark, d):
    b = rail.bracketed(_services(spark, d), F.lit(1_800_000))
    return b.select("rid", F.col("from.crs").alias("from_crs"), F.col("to.crs").alias("to_crs"))


@query("""with s as (select l_orderkey % 2000 as rid, l_orderkey as ord, count(distinct l_linenumber) as n from lineitem group by 1, 2) select rid, arg_min(ord, -n * 1000000000 + ord) as ord, max(n) as n from s group by rid""")
def merged_services(spark, d):
    s = _services(spark, d).select((F.col("rid") % 2000).alias("rid"), F.col("rid").alias("ord"), F.col("rid").cast("string").alias("operator"), "destination", "stops")
    return rail.merged(s).select("rid", F.col("operator").cast("long").alias("ord"), F.size("stops").cast("long").alias("n"))


@query(f"""with {_TRIPS}, t as (select rid, max_by(time, i) as last from stops group by rid) select rid from t where last >= 3000000 - 120000""")
def running_services(spark, d):
    return rail.running(_services(spark, d), F.lit(3_000_000)).select("rid")


@query(f"""with {_TRIPS}, o as (select *, lead(crs) over w as to_crs, lead(time) over w as to_time, row_number() over w as n from stops window w as (partition by rid order by i)), live as (select rid from o where n = 1 and time <= 1800000),
b as (select rid, arg_min({{'a': crs, 'b': to_crs, 't1': time, 't2': to_time}}, n) as x from o join live using (rid) where to_time > 1800000 group by rid),
f as (select rid, substr(x.a, 2)::integer as a, substr(x.b, 2)::integer as b, case when x.t2 - x.t1 <= 0 then 0 else least(1.0, (1800000 - x.t1) / (x.t2 - x.t1)::double) end as frac from b where x.a <> x.b)
select rid, round(frac, 6) as frac, round((a + (b - a) * frac) * 0.01e0, 8) as lon from f where abs(a - b) <= 12""")
def rail_positions(spark, d):
    """Timetabled trains on a ring of 25 stations, along the shorter way round; shown are those whose way doesn't cross the seam."""
    ring = table(spark, d, "nation").select(F.col("n_nationkey").alias("n")).withColumn("m", F.pmod(F.col("n") + 1, F.lit(25)))
    place = lambda c: F.struct((c * 0.01).alias("lon"), F.lit(51.5).alias("lat"))
    segments = ring.select(F.concat(F.lit("C"), "n").alias("a"), F.concat(F.lit("C"), "m").alias("b"), F.lit(100.0).alias("len_m"), F.array(place(F.col("n")), place(F.col("m"))).alias("poly"))
    at = rail.positions(_services(spark, d), segments, F.lit(1_800_000))
    a, b = F.substring("from_crs", 2, 9).cast("int"), F.substring("to_crs", 2, 9).cast("int")
    return at.where((a != b) & (F.abs(a - b) <= 12)).select("rid", F.round("frac", 6).alias("frac"), F.round("lon", 8).alias("lon"))


# ---- tracks --------------------------------------------------------------------------------------------------------------

_GRID = "g as (select 'N' || a as a, 'N' || b as b, (100 + a)::double as len_m from (select n_nationkey as a, (n_nationkey + 1) % 25 as b from nation))"


def _ring(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n")).withColumn("m", F.pmod(F.col("n") + 1, F.lit(25)))
    place = lambda c: F.struct((c * 0.001).alias("lon"), F.lit(51.5).alias("lat"))
    return n.select(F.concat(F.lit("N"), "n").alias("a"), F.concat(F.lit("N"), "m").alias("b"), (F.lit(100.0) + F.col("n")).alias("len_m"), F.array(place(F.col("n")), place(F.col("m"))).alias("poly"))


@query(f"""with {_GRID}, upto as (select n_nationkey as n, coalesce(sum(100 + n_nationkey) over (order by n_nationkey rows between unbounded preceding and 1 preceding), 0)::double as s from nation),
home as (select n, s from upto where n % 5 = 0), near as (select a.n as an, b.n as bn, abs(a.s - b.s) as up, 25 * 100 + 300 - abs(a.s - b.s) as down from home as a join home as b on a.n < b.n)
select 'S' || an as a, 'S' || bn as b, least(up, down) as len_m from near where bn - an = 5 or (an = 0 and bn = 20)""")
def neighbouring_stations(spark, d):
    """Every fifth node of a ring is a station; only the next ones either way are neighbours."""
    zone = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("nid"), F.concat(F.lit("S"), "n_nationkey").alias("sid"), F.lit(51.5).alias("lat"), (F.col("n_nationkey") * 0.1).alias("lon"))
    out = network.station_neighbours(_ring(spark, d), zone)
    number = lambda c: F.substring(c, 2, 9).cast("int")
    return out.select(F.when(number("a") < number("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(number("a") < number("b"), F.col("b")).otherwise(F.col("a")).alias("b"), "len_m")


@query(f"""with recursive v as (select n_nationkey as n, n_nationkey * 0.001 as lon from nation), upto as (select n_nationkey as n, coalesce(sum(100 + n_nationkey) over (order by n_nationkey rows between unbounded preceding and 1 preceding), 0)::double as s from nation),
q as (select n_nationkey as pid, n_nationkey * 0.0007 + 0.0003 as alon, 0.02 - n_nationkey * 0.0002 as blon from nation),
sa as (select pid, n, {hav_sql('51.5', 'alon', '51.5', 'v.lon')} as da from q, v where {hav_sql('51.5', 'alon', '51.5', 'v.lon')} <= 200), sb as (select pid, n, {hav_sql('51.5', 'blon', '51.5', 'v.lon')} as db from q, v where {hav_sql('51.5', 'blon', '51.5', 'v.lon')} <= 200),
c as (select sa.pid, least(abs(x.s - y.s), 2800 - abs(x.s - y.s)) as len_m, 3 * (da + db) as snap from sa join sb using (pid) join upto as x on x.n = sa.n join upto as y on y.n = sb.n)
select pid, round(min(len_m + snap), 4) as cost_m from c group by pid""")
def track_search(spark, d):
    """Paths over a ring from all nodes near one place to all near another, snaps costing three times their length."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("pid"))
    pairs = n.select("pid", (F.col("pid") * 0.0007 + 0.0003).alias("a_lon"), F.lit(51.5).alias("a_lat"), (0.02 - F.col("pid") * 0.0002).alias("b_lon"), F.lit(51.5).alias("b_lat"))
    nodes = n.select(F.concat(F.lit("N"), "pid").alias("nid"), (F.col("pid") * 0.001).alias("lon"), F.lit(51.5).alias("lat"))
    return network.graph_segments(pairs, _ring(spark, d), nodes, 200.0).select("pid", F.round("cost_m", 4).alias("cost_m"))


@query("select c_custkey as pid, case when c_custkey % 2 = 0 then 'strict' when c_custkey % 3 = 0 then 'relaxed' when c_custkey % 5 = 0 then 'graph' when c_custkey % 7 = 0 then 'existing' end as source from customer")
def geometry_sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"))
    part = lambda n: c.where(F.col("pid") % n == 0).withColumn("poly", F.array(F.lit(float(n))))
    return network.baked_geometry(c, part(2), part(3), part(5), part(7)).where(F.coalesce(F.element_at("poly", 1), F.lit(0.0)) >= 0).select("pid", "source")


@query(f"with e as (select user_id, arg_min(event_id, (event_id % 50) + 3 * (event_id % 7 + event_id % 5) + event_id / 1e9) as best from events group by 1) select user_id as pid, (best % 50)::double as len_m from e")
def snap_choice(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("pid"), (F.col("event_id") % 50 + F.col("event_id") / 1e9).alias("len_m"), (F.col("event_id") % 7).alias("snap_a_m"), (F.col("event_id") % 5).alias("snap_b_m"), F.lit(None).cast("array<double>").alias("poly"))
    return network.snap_penalised(e).select("pid", F.floor("len_m").cast("double").alias("len_m"))


@query(f"select c_custkey as pid, round(abs(((c_custkey * 7) % 97 - (c_custkey * 5) % 97) * 0.001e0) * {LON}, 3) as len_m, c_custkey % 3 = 0 as second from customer where c_custkey % 97 <> 0")
def cut_between_stops(spark, d):
    """Straight tracks: what lies between two stops is as long as they are apart; the closer of two tracks is taken."""
    c = table(spark, d, "customer").where("c_custkey % 97 <> 0").select(F.col("c_custkey").alias("pid"))
    point = lambda k: F.struct((F.pmod(F.col("pid") * k, F.lit(97)) * 0.001).alias("lon"), F.lit(51.5).alias("lat"))
    pairs = c.select("pid", F.concat(F.lit("L"), F.col("pid") % 3).alias("line_id"), point(7).alias("a"), point(5).alias("b"))
    track = lambda lat: F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(lat).alias("lat")) for x in (-0.01, 0.04, 0.2)])
    lines = None
    for n in range(3):
        for ord_, lat in ((0, 51.5005 if n == 0 else 51.5001), (1, 51.5002)):
            one = spark.range(1).select(F.lit(f"L{n}").alias("line_id"), F.lit(ord_).cast("long").alias("ord"), track(lat).alias("poly"))
            lines = one if lines is None else lines.unionByName(one)
    out = network.track_segments(pairs, lines, 100.0)
    return out.select("pid", F.round(trains.line_length("poly"), 3).alias("len_m"), (F.abs(F.element_at("poly", 1)["lat"] - 51.5002) < 1e-9).alias("second"))


@query("with w as (select n_nationkey as n, n_regionkey as r, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) select 'R' || r as line_id, count(*)::integer + 1 as points, (count(*) * 0.01)::double as span from w group by r")
def stitched_ways(spark, d):
    """Ways of each line, every other one turned round, become one chain from end to end."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("line_id"))
    k = n.withColumn("k", F.row_number().over(Window.partitionBy("line_id").orderBy("n_nationkey")))
    p = lambda c: F.struct((c * 0.01).alias("lon"), F.lit(51.5).alias("lat"))
    ways = k.select("line_id", F.pmod(F.col("k") * 3, F.lit(5)).alias("ord"), F.when(F.col("k") % 2 == 0, F.array(p(F.col("k")), p(F.col("k") + 1))).otherwise(F.array(p(F.col("k") + 1), p(F.col("k")))).alias("poly"))
    out = network.stitched(ways)
    return out.select("line_id", F.size("poly").alias("points"), F.round(F.abs(F.element_at("poly", 1)["lon"] - F.element_at("poly", -1)["lon"]), 6).alias("span"))


# ---- read API ------------------------------------------------------------------------------------------------------------

_NOW = "(select max(epoch_ms(recorded_at)) from bus_fixes)"


@query(f"""with l as (select id, line, lat, lon, epoch_ms(recorded_at) as t from bus_fixes where id is not null and recorded_at is not null qualify row_number() over (partition by id order by recorded_at desc, fix_id) = 1)
select id, t as t_ms from l where {_NOW} - t <= 86400000 and lon between {-0.3 - 0.6 * 0.2!r}e0 and {0.3 + 0.6 * 0.2!r}e0 and lat between {51.3 - 0.4 * 0.2!r}e0 and {51.7 + 0.4 * 0.2!r}e0""")
def api_buses(spark, d):
    b = table(spark, d, "bus_fixes").select("id", "line", "lat", "lon", F.unix_millis("recorded_at").alias("t_ms"), F.col("fix_id").alias("ord"))
    now = b.agg(F.max("t_ms")).first()[0]
    return read_api.buses(b, F.lit(now), geo.Box(-0.3, 51.3, 0.3, 51.7), ttl_ms=86_400_000).select("id", "t_ms")


@query(f"with {_POLL} select ord from p where line_id in ('line0', 'line2')".replace("round_even(value * 20, 0)", "floor(value * 20 + 0.5)"))
def api_arrivals(spark, d):
    return read_api.arrivals(_train_predictions(spark, d), "line2, line0").select("ord")


@query(f"with {_POLL} select ord, tts as time_to_station from p where naptan = 'S07' or naptan = 'S11' qualify row_number() over (order by tts, ord) <= 8".replace("round_even(value * 20, 0)", "floor(value * 20 + 0.5)").replace("'S07' or naptan = 'S11'", "'S1100'").replace("'S' || user_id % 24 as naptan", "'S' || (user_id % 24) * 100 as naptan"))
def api_stop_arrivals(spark, d):
    p = _train_predictions(spark, d).withColumn("naptan_id", F.concat("naptan_id", F.lit("00")))
    return read_api.stop_arrivals(p, "S1100").select("ord", "time_to_station")


@query(f"with {_EVENT_SQL}{_TOTALS_SQL}, one as (select * from ranked where period = 'day' and bucket = (select max(bucket) from ranked where period = 'day')) select id, rank, total, '#' || rank || ' of ' || total || ' bus today' as label from one where rank <= 3")
def api_board_and_rank(spark, d):
    facts = materialize(leaderboard.totals(_judged_events(spark, d)))
    bucket = facts.where("period = 'day'").agg(F.max("bucket")).first()[0]
    top = [r.id for r in read_api.board(facts, "day", bucket, "bus", 3).collect()]  # three rows
    ranks = read_api.rank(facts, bucket, top[0]).unionByName(read_api.rank(facts, bucket, top[1])).unionByName(read_api.rank(facts, bucket, top[2]))
    return ranks.select("id", "rank", "total", "label")


@query("select 'buses' as name, count(*) as rows, 2000000000000 - max(epoch_ms(recorded_at)) as age_ms from bus_fixes union all select 'vessels', count(*), 2000000000000 - max(last_seen) from vessels")
def api_health(spark, d):
    b = table(spark, d, "bus_fixes").select(F.unix_millis("recorded_at").alias("t"))
    return read_api.health({"buses": b, "vessels": table(spark, d, "vessels").select(F.col("last_seen").alias("t"))}, "t", 2_000_000_000_000)


@query("select * from (values ('resample', '0 25 50 75 100'), ('resample short end', '0 25 50'), ('simplify', '0 100 200'), ('simplify all', '0 200'), ('tangent', '5.0'), ('tangent of a point', '0.0'), ('docked', '0 10 190 200'), ('between', '150 100 30')) as t(name, value)")
def polyline_tools(spark, d):
    """Known answers of the numeric polyline functions, x in metres."""
    xs = lambda a: " ".join(str(int(round(v))) for v in a[:, 0])
    line, bend = np.array([[0.0, 0.0], [100.0, 0.0]]), np.array([[0.0, 0.0], [50.0, 1.0], [100.0, 30.0], [150.0, 14.0], [200.0, 0.0]])
    dock = polyline.docked(np.array([[0.0, 0.0], [200.0, 0.0]]), np.array([0.0, 20.0]), np.array([200.0, 20.0]), trim_m=10.0)
    rows = [
        ("resample", xs(polyline.resample(line, 25.0))), ("resample short end", xs(polyline.resample(np.array([[0.0, 0.0], [54.0, 0.0]]), 25.0))), ("simplify", xs(polyline.simplify(bend, 20.0))), ("simplify all", xs(polyline.simplify(bend, 40.0))),
        ("tangent", str(polyline.tangent_speed(np.array([[0.0, 0.0], [30.0, 40.0]]), 0, 3.0, 4.0))), ("tangent of a point", str(polyline.tangent_speed(np.array([[1.0, 1.0], [1.0, 1.0]]), 0, 3.0, 4.0))), ("docked", xs(dock[[0, 10, 11, -1]])),
        ("between", xs(polyline.between(np.array([[0.0, 0.0], [100.0, 0.0], [200.0, 0.0]]), np.array([150.0, 9.0]), np.array([30.0, -3.0])))),
    ]
    return spark.createDataFrame(rows, "name string, value string")
