"""Queries of the column functions and predicates over the test tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywake.functions import clock, geo, polyline, text
from ferrywake.operators import latest, tracking, trains
from ferrywake.operators.rail import INITIALS
from ferrywake.plans.fixes import placed, placed_sql
from ferrywake.plans.reference_queries import query, r6
from ferrywake.session import table
from ferrywake.sources import bakes, feeds


def nth(key: str, *values):
    """One of ``values`` by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def nth_sql(key: str, *values) -> str:
    lit = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"case {key} % {len(values)} " + " ".join(f"when {n} then {lit(v)}" for n, v in enumerate(values)) + " end"


# ---- predicates --------------------------------------------------------------------------------------------------------

_IDS, _PLACES = ("", "000", None, "243"), (None, " ", "Northfields Sidings", "At siding 3", "Between Aldon and Sidingham")


@query(f"select fix_id, coalesce(v not in ('', '000'), false) as live_id, coalesce(trim(p) <> '' and not regexp_matches(p, '(?i)sidings?\\b'), false) as live_place from (select fix_id, {nth_sql('fix_id', *_IDS)} as v, {nth_sql('fix_id', *_PLACES)} as p from bus_fixes)")
def live_flags(spark, d):
    b = table(spark, d, "bus_fixes")
    return b.select("fix_id", text.live_identity(nth("fix_id", *_IDS)).alias("live_id"), text.live_location(nth("fix_id", *_PLACES)).alias("live_place"))


_MODES = ("train", "bus", "ship", "tube", "vessel", None)


@query(f"select fix_id, case m when 'train' then 'tube' when 'bus' then 'bus' when 'ship' then 'ship' end as mode from (select fix_id, {nth_sql('fix_id', *_MODES)} as m from bus_fixes)")
def mode_names(spark, d):
    return table(spark, d, "bus_fixes").select("fix_id", text.mode_of(nth("fix_id", *_MODES)).alias("mode"))


_CALLS, _CRS = ("BAW12", "g-npas", "X", "TOO-LONG-CALL", None), ("KGX", "kgx", "KG1", "KGXX", None)


@query(f"""select fix_id, coalesce(regexp_full_match(lower(line), '[a-z0-9-]+'), false) as line, coalesce(regexp_full_match(split_part(id, ':', 2), '[A-Za-z0-9-]{{1,20}}'), false) as vehicle,
coalesce(regexp_full_match(c, '[A-Za-z0-9-]{{2,10}}'), false) as callsign, coalesce(regexp_full_match(s, '[A-Za-z]{{3}}'), false) as crs, case when lat is null or lon is null then null else format('{{:.3f}},{{:.3f}}', floor(lat * 1000) / 1000, floor(lon * 1000) / 1000) end as place
from (select *, {nth_sql('fix_id', *_CALLS)} as c, {nth_sql('fix_id', *_CRS)} as s from bus_fixes)""")
def valid_parameters(spark, d):
    b = table(spark, d, "bus_fixes")
    key = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), text.place_key(F.floor(F.col("lat") * 1000) / 1000, F.floor(F.col("lon") * 1000) / 1000))
    return b.select(
        "fix_id", text.valid("line", F.lower("line")).alias("line"), text.valid("vehicle", F.split_part("id", F.lit(":"), F.lit(2))).alias("vehicle"), text.valid("callsign", nth("fix_id", *_CALLS)).alias("callsign"), text.valid("crs", nth("fix_id", *_CRS)).alias("crs"), key.alias("place")
    )


@query("select report_id, regexp_full_match(cast(mmsi as varchar), '[0-9]{9}') as ok from vessels")
def valid_mmsi(spark, d):
    return table(spark, d, "vessels").select("report_id", text.valid("mmsi", F.col("mmsi").cast("string")).alias("ok"))


@query("select * from (values ('b, a,b', 'a,b'), ('victoria', 'victoria'), ('a,,b', null), ('', null), ('UP', null), ('n1,n2,n1', 'n1,n2')) as t(raw, ids)")
def line_lists(spark, d):
    """Python validation, here as rows: null stands for a refusal."""

    def ids(raw: str) -> str | None:
        try:
            return ",".join(text.valid_lines(raw))
        except ValueError:
            return None

    return spark.createDataFrame([(raw, ids(raw)) for raw in ("b, a,b", "victoria", "a,,b", "", "UP", "n1,n2,n1")], "raw string, ids string")


_CATEGORIES = ("A3", "C1", None, "A7")


@query(f"select fix_id from (select *, {nth_sql('fix_id', *_CATEGORIES)} as c from bus_fixes) where lat is not null and lon is not null and coalesce(c, '') not like 'C%'")
def flying_only(spark, d):
    b = table(spark, d, "bus_fixes").withColumn("c", nth("fix_id", *_CATEGORIES))
    return b.where(text.flying(F.col("lat"), F.col("lon"), F.col("c"))).select("fix_id")


@query(f"select p_partkey::varchar as id, 'http://' || p_partkey as image_url, {nth_sql('p_partkey', 'north', None)} as view from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0")
def camera_list(spark, d):
    p = table(spark, d, "part")
    prop = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    # listed twice: the last value of a key counts
    props = F.array(prop("available", F.lit("true")), prop("view", nth("p_partkey", "north", None)), prop("imageUrl", F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("http://"), "p_partkey"))), prop("available", F.when(F.col("p_partkey") % 3 == 0, F.lit("false")).otherwise("true")))
    cams = p.select(F.concat(F.lit("JamCams_"), "p_partkey").alias("id"), F.lit(51.5).alias("lat"), F.lit(0.1).alias("lon"), props.alias("properties"))
    return text.camera_rows(cams).select("id", "image_url", "view")


@query("select * from (values ('buses', true), ('vessels', false), ('rail', true), ('bikes', false), ('tides', false), ('trains', true)) as t(layer, on_)")
def layer_capabilities(spark, d):
    env = {"BODS_API_KEY": "k", "AIS_API_KEY": " ", "DARWIN_TOKEN": "t", "TIDES": "off"}
    return spark.createDataFrame(list(bakes.capabilities(env, {"manifest.json", "nr/stations.json", "nr/segments.json"}).items()), "layer string, on_ boolean")


_ENDS = (" Underground Station", " Rail Station", " DLR Station", " Station", "")


@query(f"select distinct crs, name || {nth_sql('length(name)', *_ENDS)} as full_name, regexp_replace(name || {nth_sql('length(name)', *_ENDS)}, ' (Underground|Rail|DLR) Station$', '') as name from stations where name is not null")
def clean_names(spark, d):
    s = table(spark, d, "stations").where("name is not null").withColumn("n", F.length("name")).withColumn("full_name", F.concat("name", nth("n", *_ENDS)))
    return s.select("crs", "full_name", text.clean_name(F.col("full_name")).alias("name")).distinct()


_HOURS = ((8, 24), (5, 24), (5, 24), (5, 24), (5, 24), (5, 25.5), (5, 24))


@query(f"""with h as (select event_id, cast(ts as timestamp) + interval 4 hour as t from events), l as (select event_id, dayofweek(t) as day, hour(t) + minute(t) / 60.0 as hr from h),
o as (select * from (values {', '.join(f'({n}, {a}, {b})' for n, (a, b) in enumerate(_HOURS))}) as o(day, open, close))
select event_id, (hr >= o.open and hr < o.close) or hr + 24 < y.close as runs, (hr >= 7 and hr < 10) or (hr >= 17 and hr < 21) as peak from l join o using (day) join o as y on y.day = (l.day + 6) % 7""")
def service_hours(spark, d):
    hours = F.array(*[F.struct(F.lit(float(a)).alias("open"), F.lit(float(b)).alias("close")) for a, b in _HOURS])
    now = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", clock.service_running(hours, 4.0, now).alias("runs"), clock.is_peak([(7, 10), (17, 21)], 4.0, now).alias("peak"))


@query("""with o as (select o_orderkey as id, case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end as end_date, cast(o_orderdate as date) + cast(o_orderkey % 11 as integer) as modified, o_custkey as output from orders)
select output, id from o where end_date is null or end_date + 90 > date '1997-01-01' qualify row_number() over (partition by output order by modified desc nulls last, id) = 1""")
def fresh_datasets(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    sets = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("day")).alias("end_date"), F.date_add("day", (F.col("o_orderkey") % 11).cast("int")).alias("modified"), F.col("o_custkey").alias("output"))
    return bakes.newest_per_output(bakes.fresh_datasets(sets, F.lit("1997-01-01").cast("date")), "output").select("output", "id")


_CP = f"with c as (select c_custkey, {placed_sql('c_custkey')} from customer), s as (select s_suppkey, {placed_sql('s_suppkey')} from supplier), j as (select c.c_custkey, c.lon as lon1, c.lat as lat1, s.lon as lon2, s.lat as lat2 from c join s on s.s_suppkey = c.c_custkey % 100)"


def _both_ends(spark, d):
    c = placed(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.pmod("c_custkey", F.lit(100)).alias("s_suppkey"))
    s = placed(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return c.join(s, "s_suppkey")


@query(_CP + " select c_custkey from j where lon1 between -0.4 and 0.2 and lon2 between -0.4 and 0.2 and lat1 between 51.3 and 51.6 and lat2 between 51.3 and 51.6")
def branch_inside_region(spark, d):
    point = lambda n: F.struct(F.col(f"lon{n}").alias("lon"), F.col(f"lat{n}").alias("lat"))
    return _both_ends(spark, d).where(geo.Box(-0.4, 51.3, 0.2, 51.6).holds_all(F.array(point(1), point(2)))).select("c_custkey")


@query(f"select fix_id from bus_fixes where lon between {-0.3 - 0.05!r}e0 and {0.1 + 0.05!r}e0 and lat between {51.4 - 0.05!r}e0 and {51.55 + 0.05!r}e0")
def widened_region(spark, d):
    return table(spark, d, "bus_fixes").where(geo.Box(-0.3, 51.4, 0.1, 51.55).widened(0.05).holds(F.col("lon"), F.col("lat"))).select("fix_id")


# ---- geometry ----------------------------------------------------------------------------------------------------------

@query(_CP + f" select c_custkey, round((degrees(atan2((lon2 - lon1) * {geo.metres_per_lon()!r}, (lat2 - lat1) * 110540.0)) + 360.0) % 360.0, 6) + 0.0 as bearing, round(sqrt(pow((lon2 - lon1) * {geo.metres_per_lon()!r}, 2) + pow((lat2 - lat1) * 110540.0, 2)), 4) as metres from j")
def bearings(spark, d):
    j = _both_ends(spark, d)
    return j.select("c_custkey", r6(geo.bearing_deg(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))).alias("bearing"), F.round(geo.planar_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 4).alias("metres"))


#: A polyline with four corners; in SQL as its segments with lengths.
_LINE = ((-0.45, 51.30), (-0.2, 51.42), (-0.05, 51.40), (0.25, 51.65))
_SEGS = f"""v as (select * from (values {', '.join(f'({n}, {x}, {y})' for n, (x, y) in enumerate(_LINE))}) as v(n, x, y)),
sg as (select a.n, a.x as x1, a.y as y1, b.x as x2, b.y as y2, (b.x - a.x) * {geo.metres_per_lon()!r} as dx, (b.y - a.y) * 110540.0 as dy from v as a join v as b on b.n = a.n + 1),
seg as (select *, sqrt(dx * dx + dy * dy) as len, coalesce(sum(sqrt(dx * dx + dy * dy)) over (order by n rows between unbounded preceding and 1 preceding), 0) as before from sg)"""


def _line_column():
    return F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _LINE])


@query(f"""with {_SEGS}, total as (select sum(len) as t from seg), e as (select event_id, (event_id % 1001) / 1000.0 * t as s from events, total),
spot as (select event_id, x1 + (x2 - x1) * (s - before) / len as lon, y1 + (y2 - y1) * (s - before) / len as lat, (degrees(atan2(dx, dy)) + 360.0) % 360.0 as bearing, row_number() over (partition by event_id order by n) as k
  from e join seg on s <= before + len + 1e-7) select event_id, round(lon, 6) + 0.0 as lon, round(lat, 6) as lat, round(bearing, 5) as bearing from spot where k = 1""")
def point_along_line(spark, d):
    at = table(spark, d, "events").select("event_id", polyline.point_at_fraction(_line_column(), F.pmod("event_id", F.lit(1001)) / 1000.0).alias("at"))
    return at.select("event_id", r6("at.lon").alias("lon"), r6("at.lat").alias("lat"), F.round("at.bearing", 5).alias("bearing"))


_PROJECT = f"""c as (select c_custkey, {placed_sql('c_custkey')} from customer),
u as (select c_custkey, n, len, before, least(1.0, greatest(0.0, ((lon - x1) * {geo.metres_per_lon()!r} * dx + (lat - y1) * 110540.0 * dy) / (len * len))) as u, (lon - x1) * {geo.metres_per_lon()!r} as px, (lat - y1) * 110540.0 as py, dx, dy from c, seg),
p as (select c_custkey, before + u * len as s_m, sqrt(pow(px - u * dx, 2) + pow(py - u * dy, 2)) as off_m, n from u qualify row_number() over (partition by c_custkey order by sqrt(pow(px - u * dx, 2) + pow(py - u * dy, 2)), n) = 1)"""


@query(f"with {_SEGS}, {_PROJECT} select c_custkey, round(s_m, 3) as s_m, round(off_m, 3) as off_m, pow(greatest(8.0, 1.25 * 20.0), 2) as r_var from p")
def matched_to_route(spark, d):
    c = placed(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    fixes = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("k").alias("key"), F.col("c_custkey").alias("t_ms"), "lon", "lat")
    routes = spark.range(1).select(F.lit("k").alias("key"), _line_column().alias("poly"), F.lit(20.0).alias("residual_m"))
    return tracking.on_route(fixes, routes, chunk_ms=500).select(F.col("t_ms").alias("c_custkey"), F.round("s_m", 3).alias("s_m"), F.round("off_m", 3).alias("off_m"), "r_var")


@query(f"with {_SEGS}, {_PROJECT}, total as (select sum(len) as t from seg) select c_custkey, round(s_m / t, 8) as frac from p, total")
def fraction_on_line(spark, d):
    c = placed(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return c.select("c_custkey", F.round(polyline.fraction_on(_line_column(), F.col("lon"), F.col("lat")), 8).alias("frac"))


@query(_CP + f""" select c_custkey, round(lon1 + sp * 120 * sin(radians(tr)) * g / {geo.metres_per_lon()!r}, 6) + 0.0 as lon, round(lat1 + sp * 120 * cos(radians(tr)) * g / 110540.0, 6) + 0.0 as lat
from (select *, (c_custkey % 500) * 0.514444 as sp, c_custkey * 37 % 360 as tr, case when c_custkey % 9 = 0 then 0 else 1 end as g from j)""")
def aircraft_ahead(spark, d):
    x, y = geo.aircraft_reckoned(F.col("lon1"), F.col("lat1"), F.pmod("c_custkey", F.lit(500)), F.pmod(F.col("c_custkey") * 37, F.lit(360)), F.lit(120_000), F.col("c_custkey") % 9 == 0)
    return _both_ends(spark, d).select("c_custkey", r6(x).alias("lon"), r6(y).alias("lat"))


@query("select event_id, round(value * 3 + 5.0 * 12.0 * (1 - exp(-greatest((value * 100 - 2000) / 1000.0, 0) / 12.0)), 6) as s, pow(case when event_id % 5 = 0 or value - 50 < 0 then 44.0 else greatest(8.0, 1.25 * (value - 50)) end, 2) as var, floor(value * -100 + 0.5) / 100 as r2 from events")
def coast_and_variance(spark, d):
    e = table(spark, d, "events")
    residual = F.when(F.col("event_id") % 5 != 0, F.col("value") - 50)
    return e.select("event_id", r6(geo.coasted(F.col("value") * 3, F.lit(5.0), F.col("value") * 100 - 2000)).alias("s"), tracking.measurement_variance(residual).alias("var"), geo.rounded(-F.col("value"), 2).alias("r2"))


# ---- clocks ------------------------------------------------------------------------------------------------------------

@query("""with b as (select distinct strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, strftime(cast(o_orderdate as date), '%Y-%m') as month from orders)
select day, month, cast(day as date) as day_start, cast(month || '-01' as date) as month_start, date '1997-03-01' - cast(day as date) <= 62 as day_kept, date '1997-03-01' - cast(month || '-01' as date) <= 62 as month_kept from b""")
def buckets_kept(spark, d):
    b = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    now = F.lit("1997-03-01 00:00:00").cast("timestamp")
    side = lambda p: [clock.bucket_start(F.lit(p), F.col(p)).alias(f"{p}_start"), clock.kept(F.lit(p), F.col(p), now).alias(f"{p}_kept")]
    return b.select("day", "month", *side("day"), *side("month"))


_WALL = """near as (select *, case when w0 - now_ms > 43200000 then w0 - 86400000 else w0 end as w1 from (select *, (now_ms + 3600000) - (now_ms + 3600000) % 86400000 + (h * 60 + m) * 60000 - 3600000 as w0 from t)),
timed as (select event_id, k, case when now_ms - w1 > 43200000 then w1 + 86400000 else w1 end as ms from near)"""


@query(f"""with base as (select event_id, cast(floor(epoch_us(ts) / 1000.0) as bigint) + 15638400000 as now_ms, cast(floor(value) as integer) as v from events),
t as (select event_id, 1 as k, now_ms, v % 24 as h, v * 7 % 60 as m from base where v % 3 = 0 union all select event_id, 2, now_ms, v * 5 % 24, v % 60 from base where v % 2 = 0 union all select event_id, 3, now_ms, (v + 9) % 24, 30 from base), {_WALL}
select event_id, arg_min(ms, k) as at_ms from timed group by event_id""")
def summer_stop_times(spark, d):
    """Actual, else estimated, else scheduled wall-clock times in July, when London is an hour ahead."""
    e = table(spark, d, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) + 181 * 86_400_000).alias("now_ms"), F.floor("value").cast("int").alias("v"))
    hhmm = lambda h, m: F.format_string("%02d:%02d", F.pmod(h, F.lit(24)), F.pmod(m, F.lit(60)))
    v = F.col("v")
    return e.select("event_id", clock.stop_time_ms(F.when(v % 3 == 0, hhmm(v, v * 7)), F.when(v % 2 == 0, hhmm(v * 5, v)).otherwise("On time"), hhmm(v + 9, F.lit(30)), F.col("now_ms")).alias("at_ms"))


@query("select event_id, case when sched >= 20 then least(300.0, sched + 30.0) else greatest(45.0, least(300.0, value * 60 / 12.0)) end as run_s, 'line' || event_id % 3 || ':' || event_id % 4 || ':outbound:' || event_id % 9 as segment from (select *, case when event_id % 3 = 0 then null else value * 3 end as sched from events)")
def segment_run_times(spark, d):
    e = table(spark, d, "events")
    sched = F.when(F.col("event_id") % 3 != 0, F.col("value") * 3)
    key = text.segment_key(F.concat(F.lit("line"), F.col("event_id") % 3), F.col("event_id") % 4, F.lit("outbound"), F.col("event_id") % 9)
    return e.select("event_id", trains.run_time(sched, F.col("value") * 60).alias("run_s"), key.alias("segment"))


# ---- labels ------------------------------------------------------------------------------------------------------------

@query("select report_id, coalesce(f.flag, 'Unknown') as flag from vessels as v left join (select mmsi // 1000000 as mid, min(flag) as flag from vessels where mmsi // 1000000 % 3 <> 0 group by 1) as f on f.mid = v.mmsi // 1000000")
def vessel_flags(spark, d):
    v = table(spark, d, "vessels")
    mids = v.select(F.floor(F.col("mmsi") / 1_000_000).cast("int").alias("mid"), "flag").where("mid % 3 <> 0").groupBy("mid").agg(F.min("flag").alias("flag"))
    return text.with_flag(v.select("report_id", "mmsi"), mids).select("report_id", "flag")


_OPERATORS = ("Thameslink", " Elizabeth line ", "Unheard Of Trains", "", None)


@query(f"select event_id, {nth_sql('event_id', 'TL', 'EL', 'Unheard Of Trains', 'NR', 'NR')} as operator from events")
def operator_initials(spark, d):
    return table(spark, d, "events").select("event_id", text.short_operator(nth("event_id", *_OPERATORS), INITIALS).alias("operator"))


@query("""select event_id, case when v < 45 then 'due' else cast(floor(v / 60.0 + 0.5) as bigint) || ' min' end as due, case when v <= 0 then 'due' else format('{}:{:02d}', v // 60, v % 60) end as countdown, case when event_id % 11 = 0 then 'on ground' else format('{:,}', v * 37) || ' ft' end as altitude
from (select event_id, cast(floor(value * 6) as integer) as v from events)""")
def time_labels(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(F.col("value") * 6).cast("int").alias("v"))
    return e.select("event_id", text.due_label(F.col("v")).alias("due"), text.countdown_label(F.col("v")).alias("countdown"), text.altitude_label(F.col("v") * 37, F.col("event_id") % 11 == 0).alias("altitude"))


@query("""select report_id, nullif(coalesce(a, 0) + coalesce(b, 0), 0) as length_m, nullif(concat_ws(' · ', case when a is not null and b is not null then a || ' × ' || b || ' m' when a is not null then a || ' m long' end, case when c is not null then 'draught ' || c || ' m' end), '') as size,
case when flag is not null and flag <> 'Unknown' then 'Flag: ' || flag end as flag, case when length(destination) > 8 then substr(destination, 1, 7) || '…' else destination end as destination
from (select *, cast(floor(length_m) as integer) as a, cast(floor(width_m) as integer) as b, cast(floor(draught_m) as integer) as c from vessels)""")
def ship_lines(spark, d):
    v = table(spark, d, "vessels")
    a, b, c = (F.floor(x).cast("int") for x in ("length_m", "width_m", "draught_m"))
    return v.select("report_id", text.dimension(a, b).alias("length_m"), text.dimensions_line(a, b, c).alias("size"), text.flag_line(F.col("flag")).alias("flag"), text.truncated(F.col("destination"), 8).alias("destination"))


@query(f"""select p_partkey, array_to_string(list_filter([case when w = 'yes' then 'WiFi' end, case when t not in ('', 'no', '0', 'none') then 'Toilets' end, case when l > 0 then 'Lifts ×' || l end], lambda x: x is not null), ', ') as labels, case when p_partkey % 4 <> 0 then cast(floor(p_size * 0.013e0 * 100 + 0.5) as bigint) end as percent
from (select *, {nth_sql('p_partkey', 'yes', 'no', 'unknown')} as w, {nth_sql('p_partkey', 'none', 'yes - outside', '', '2')} as t, p_partkey % 5 as l from part)""")
def station_facilities(spark, d):
    p = table(spark, d, "part")
    prop = lambda c, k, v: F.struct(F.lit(c).alias("category"), F.lit(k).alias("key"), v.alias("value"))
    lifts = F.pmod("p_partkey", F.lit(5))
    props = F.array(prop("Geo", "WiFi", F.lit("yes")), prop("Facility", "WiFi", F.initcap(nth("p_partkey", "yes", "no", "unknown"))), prop("Facility", "Toilets", nth("p_partkey", "none", "yes - outside", "", "2")), prop("Facility", "Lifts", F.concat(lifts.cast("string"), F.lit(" in use"))), prop("Facility", "Lifts", F.lit("9")))
    return p.select("p_partkey", F.array_join(text.facilities(props), ", ").alias("labels"), text.crowding_percent(F.col("p_partkey") % 4 != 0, F.col("p_size") * 0.013).alias("percent"))


@query("""select n_nationkey, case n_nationkey % 5 when 0 then n_nationkey / 10.0 when 1 then n_nationkey / 10.0 when 2 then n_nationkey + 1.0 when 3 then n_nationkey + 3.0 end as lon,
case n_nationkey % 5 when 0 then 51.5 when 1 then 51.25 when 2 then 51.0 when 3 then 52.0 end::double as lat from nation""")
def disruption_markers(spark, d):
    n = F.col("n_nationkey")
    js = lambda fmt, *a: F.format_string(fmt, *a)
    point = F.when(n % 5 == 0, js("[%.1f,51.5]", n / 10.0))
    shape = (
        F.when(n % 5 == 1, js('{"type":"Point","coordinates":[%.1f,51.25]}', n / 10.0))
        .when(n % 5 == 2, js('{"type":"Polygon","coordinates":[[[%d,50],[%d,50],[%d,52],[%d,52]],[[9,9],[9,9]]]}', n, n + 2, n + 2, n))
        .when(n % 5 == 3, js('{"type":"MultiPolygon","coordinates":[[[[%d,52],[%d,52]]],[[[0,0],[1,1]]]]}', n + 2, n + 4))
    )
    return table(spark, d, "nation").select("n_nationkey", feeds.disruption_marker(point, shape).alias("m")).select("n_nationkey", "m.lon", "m.lat")


_SEVERITIES = ("Severe", "Serious", "Moderate", "Minimal", None)


@query(f"select event_id, {nth_sql('event_id', '#d43', '#d43', '#da3', '#8a94a0', '#8a94a0')} as colour from events")
def severity_colours(spark, d):
    return table(spark, d, "events").select("event_id", text.severity_colour(nth("event_id", *_SEVERITIES), text.SEVERITY_COLOURS, text.OTHER_SEVERITY).alias("colour"))


@query(f"select distinct crs, case length(name) % 4 when 0 then trim(name) when 1 then trim(name) when 2 then trim('en ' || name) end as name from stations where name is not null and name not like '%\"%'")
def localized_names(spark, d):
    s = table(spark, d, "stations").where("name is not null and not contains(name, '\"')").withColumn("n", F.length("name"))
    raw = F.when(F.col("n") % 4 == 0, F.to_json(F.struct("name"))).otherwise(None)
    raw = F.when(F.col("n") % 4 == 0, F.concat(F.lit('"'), "name", F.lit(' "'))).when(F.col("n") % 4 == 1, F.concat(F.lit('[{"text":"'), "name", F.lit('","language":"fr"}]'))).when(F.col("n") % 4 == 2, F.concat(F.lit('[{"text":"x","language":"fr"},{"text":"en '), "name", F.lit('","language":"en"}]'))).otherwise("[]")
    return s.select("crs", text.localized_name(raw).alias("name")).distinct()


@query("""select * from (values ('bbox', '-0.55,51.25,0.35,51.72', '-0.55|51.25|0.35|51.72'), ('bbox', '1,2,3', 'refused'), ('bbox', '5,51,4,52', 'refused'), ('lonlat', '0.1, 51.5', '0.1|51.5'), ('lonlat', '0.1,95', 'refused'), ('flag', 'ON', 'True'), ('flag', '0', 'False'), ('flag', '', 'False'), ('flag', 'maybe', 'refused'),
('env', 'export A="x y"', 'A=x y'), ('env', '# B=1', ''), ('region', 'REGION_NAME=Dubai', 'Dubai|55.0|25.0')) as t(kind, raw, parsed)""")
def configuration_values(spark, d):
    def parsed(kind: str, raw: str) -> str:
        try:
            if kind == "bbox":
                b = bakes.parse_box(raw)
                return f"{b.min_lon}|{b.min_lat}|{b.max_lon}|{b.max_lat}"
            if kind == "lonlat":
                return "|".join(map(str, bakes.parse_lonlat(raw, "X")))
            if kind == "flag":
                return str(bakes.parse_flag(raw, "X"))
            if kind == "region":
                r = bakes.load_region(bakes.parse_env(raw) | {"REGION_BBOX": "54,24,56,26"})
                return f"{r.name}|{r.centre[0]}|{r.centre[1]}"
            return ",".join(f"{k}={v}" for k, v in bakes.parse_env(raw).items())
        except ValueError:
            return "refused"

    rows = [("bbox", "-0.55,51.25,0.35,51.72"), ("bbox", "1,2,3"), ("bbox", "5,51,4,52"), ("lonlat", "0.1, 51.5"), ("lonlat", "0.1,95"), ("flag", "ON"), ("flag", "0"), ("flag", ""), ("flag", "maybe"), ("env", 'export A="x y"'), ("env", "# B=1"), ("region", "REGION_NAME=Dubai")]
    return spark.createDataFrame([(k, r, parsed(k, r)) for k, r in rows], "kind string, raw string, parsed string")


_ETD = ("On time", "12:05", "Delayed", None)


@query(f"select event_id, coalesce(e <> 'On time' and not regexp_matches(e, '^[0-9]'), false) as late, greatest(0, cast(floor((event_id * 1000 - 300000) / 60000.0 + 0.5) as bigint)) as minutes, '#' || event_id % 50 || ' of ' || event_id % 70 || ' bus today' as rank from (select event_id, {nth_sql('event_id', *_ETD)} as e from events)")
def departure_labels(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", text.delayed(nth("event_id", *_ETD)).alias("late"), text.eta_minutes(F.col("event_id") * 1000, F.lit(300_000)).alias("minutes"), text.rank_line(F.col("event_id") % 50, F.col("event_id") % 70, F.lit("bus")).alias("rank"))


@query("select line, row_number() over (order by try_cast(nullif(regexp_extract(line, '^([0-9]+)', 1), '') as bigint) nulls last, line) as place from (select distinct line from bus_fixes where trim(line) <> '')")
def natural_order(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "bus_fixes").where("trim(line) <> ''").select("line").distinct()
    return lines.select("line", F.row_number().over(Window.orderBy(*text.natural_key(F.col("line")))).cast("long").alias("place"))


@query("select l_orderkey, string_agg(l_returnflag, '' order by l_linenumber) as flags from (select *, lag(l_returnflag) over (partition by l_orderkey order by l_linenumber) as p from (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem group by all)) where p is distinct from l_returnflag group by l_orderkey")
def without_repeats(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    stops = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    return stops.select("l_orderkey", F.array_join(F.transform(latest.without_repeats(F.col("s"), "l_returnflag"), lambda x: x["l_returnflag"]), "").alias("flags"))
