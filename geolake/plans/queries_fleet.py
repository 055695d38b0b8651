"""Queries over timetables and trajectories in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as G
from ..operators import aggs, fleet, windows
from .queries_functions import TILE
from .queries_lines import ARC, clean_sql
from .registry import query

TS = "ts as (select station, part_id, max(ratio) as ratio from track_stations group by all)"
LEGS = f"""{TS}, lg as (select trip_id, seq, station as f, arr_sec, dep_sec, lead(station) over w as t2, lead(arr_sec) over w as arr2 from stops window w as (partition by trip_id order by seq)),
 pr as (select f, t2, arg_min({{'p': a.part_id, 'x': a.ratio, 'y': b.ratio}}, a.part_id) as m from (select distinct f, t2 from lg where t2 is not null) d join ts a on a.station = f join ts b on b.station = t2 and b.part_id = a.part_id group by f, t2),
 rl as (select trip_id, seq, f, t2, arr_sec, dep_sec, arr2, coalesce(m.p, -1) as part_id, coalesce(m.x, 0) as rf, coalesce(m.y, 0) as rt from lg left join pr using (f, t2) where t2 is not null)"""


@query("j14_resolve_legs", f"with {LEGS} select trip_id, seq, part_id, rf as ratio_from, rt as ratio_to from rl")
def _(t):
    return fleet.resolve_legs(t.stops, t.track_stations).select("trip_id", "seq", "part_id", "ratio_from", "ratio_to")


CORR = f"""{TS}, en as (select trip_id, arg_min(station, seq) as s0, arg_max(station, seq) as s1 from stops group by trip_id),
 co as (select trip_id, min(a.part_id) as part_id from en join ts a on a.station = s0 join ts b on b.station = s1 and b.part_id = a.part_id where a.ratio < b.ratio group by trip_id)"""


@query("j15_resolve_corridor", f"with {CORR} select trip_id, part_id from co")
def _(t):
    return fleet.resolve_corridor(t.stops, t.track_stations)


# legs of each trip, then the report over all trips
ALL_TRIPS = "per as (select trip_id, count(*) as n, count(*) filter (where ok) as ok from mt group by trip_id), al as (select trip_id, coalesce(n, 0) as n, coalesce(ok, 0) as ok from trips left join per using (trip_id))"
REPORT = "count(*) as trips, cast(sum(n) as bigint) as legs, cast(sum(ok) as bigint) as legs_matched, count(*) filter (where n > 0 and ok = n) as trips_full, count(*) filter (where n > 0 and ok / greatest(n, 1) >= 0.8e0) as trips_mostly, count(*) filter (where n = 0) as trips_under_two_stops"
COVER = f"{ALL_TRIPS} select {REPORT} from al"


def _dropped(stations):
    return f"(select count(*) from stops where trip_id in (select trip_id from trips) and station not in (select station from {stations})) as stops_dropped"


@query("a10_coverage", f"with {LEGS}, mt as (select trip_id, part_id >= 0 as ok from rl), {ALL_TRIPS} select {REPORT}, {_dropped('track_stations')} from al")
def _(t):
    legs = fleet.resolve_legs(t.stops, t.track_stations).withColumn("matched", F.col("part_id") >= 0)
    return aggs.coverage(legs, t.trips, t.stops, t.track_stations)


_NEAR = "select * from track_stations where dist_m < 120"


@query(
    "a10_stops_dropped",
    f"""with near as ({_NEAR}), {LEGS.replace("track_stations", "near")}, mt as (select trip_id, part_id >= 0 as ok from rl), {ALL_TRIPS}
     select {REPORT}, {_dropped('near')} from al""",
)
def _(t):
    """The whole network under a snap distance of 120 m: stops at stations that lie
    nearer to no part are counted."""
    near = t.track_stations.where("dist_m < 120")
    legs = fleet.resolve_legs(t.stops, near).withColumn("matched", F.col("part_id") >= 0)
    return aggs.coverage(legs, t.trips, t.stops, near)


@query(
    "a10_corridor_coverage",
    f"""with {CORR}, lg as (select trip_id, seq, station as f, lead(station) over (partition by trip_id order by seq) as t2 from stops),
     mt as (select trip_id, coalesce(a.ratio <= b.ratio, false) as ok from (select * from lg where t2 is not null) l left join co using (trip_id) left join ts a on a.station = f and a.part_id = co.part_id left join ts b on b.station = t2 and b.part_id = co.part_id), {COVER}""",
)
def _(t):
    return aggs.coverage(fleet.corridor_legs(t.stops, t.track_stations), t.trips)


@query("a16_failing_pairs", f"with {LEGS} select least(f, t2) as a, greatest(f, t2) as b, count(*) as n from rl where part_id < 0 group by 1, 2")
def _(t):
    legs = fleet.resolve_legs(t.stops, t.track_stations).withColumn("matched", F.col("part_id") >= 0)
    return aggs.failing_pairs(legs)


# every full hour of the day as found in the trips themselves
INST = "ins as (select distinct dep_sec_of_day // 3600 * 3600 as t from trips)"
SPAN = "sp as (select trip_id, dep_sec_of_day, arg_min(dep_sec, seq) as first_dep, arg_max(arr_sec, seq) as last_arr from trips join stops using (trip_id) group by trip_id, dep_sec_of_day having count(*) >= 2)"
ACT = f"{INST}, {SPAN}, ac as (select trip_id, t, dep_sec_of_day, first_dep, last_arr, ((t - dep_sec_of_day) % 86400 + 86400) % 86400 as el from sp cross join ins where ((t - dep_sec_of_day) % 86400 + 86400) % 86400 <= last_arr)"
LOC = """pl as (select *, lag(part_id) over w as pp, lag(rf) over w as pf, lag(rt) over w as pt from rl window w as (partition by trip_id order by seq)),
 hit as (select ac.trip_id, t, el, l.* exclude (trip_id) from ac join pl l on l.trip_id = ac.trip_id and el >= arr_sec and el <= arr2 and el >= first_dep qualify row_number() over (partition by ac.trip_id, t order by seq) = 1),
 loc as (select trip_id, t, el as elapsed, case when el < dep_sec and pp >= 0 then pp else part_id end as part_id,
  case when el < dep_sec and pp >= 0 then pt when el < dep_sec then rf else rf + (rt - rf) * (case when arr2 > dep_sec then (el - dep_sec) / (arr2 - dep_sec) else 0e0 end) end as ratio,
  case when el < dep_sec and pp >= 0 then (case when pt >= pf then 1 else -1 end) else (case when rt >= rf then 1 else -1 end) end as dir, el >= dep_sec as moving
  from hit where (case when el < dep_sec and pp >= 0 then pp else part_id end) >= 0)"""


def _active(t):
    inst = t.trips.select((F.floor(F.col("dep_sec_of_day") / 3600) * 3600).alias("t")).distinct()
    return fleet.active_trips(fleet.trip_spans(t.trips, t.stops), inst)


def _located(t):
    return fleet.locate_trips(_active(t), fleet.resolve_legs(t.stops, t.track_stations))


@query("k1_active_trips", f"with {ACT} select trip_id, t, el as elapsed from ac")
def _(t):
    return _active(t).select("trip_id", "t", "elapsed")


@query("k2_locate_trips", f"with {LEGS}, {ACT}, {LOC} select trip_id, t, elapsed, part_id, round(ratio, 6) as ratio, dir, moving from loc")
def _(t):
    return _located(t).select("trip_id", "t", "elapsed", "part_id", F.round("ratio", 6).alias("ratio"), "dir", "moving")


def along_sql(expr, extra="0 as u", more=""):
    """Position on the part at a ratio expression over loc and its length."""
    return f"""{LEGS}, {ACT}, {LOC}, rr as (select part_id, seq, cum_m / length_m as r, length_m, lon, lat from arc join vertices using (part_id, seq)),
     sg as (select *, lead(r) over w as r1, lead(lon) over w as lon1, lead(lat) over w as lat1 from rr window w as (partition by part_id order by seq)),
     ln as (select distinct part_id, length_m as len_m from arc), qy as (select l.*, least(greatest({expr}, 0e0), 1e0) as qr, {extra} from loc l join ln using (part_id) {more}),
     ps as (select qy.*, lon + (lon1 - lon) * (qr - r) / (r1 - r) as lon, lat + (lat1 - lat) * (qr - r) / (r1 - r) as lat from qy join sg using (part_id) where r1 > r and ((qr >= r and qr < r1) or (qr >= 1 and r1 >= 1)))"""


def _arc_with(body):
    return ARC + ", " + body


@query("k3_trip_positions", _arc_with(along_sql("ratio")) + " select trip_id, t, part_id, round(lon, 6) as lon, round(lat, 6) as lat from ps")
def _(t):
    p = fleet.trip_positions(_located(t), t.vertices)
    return p.select("trip_id", "t", "part_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "k4_trip_section",
    f"""with {ACT}, st2 as (select *, lag(station) over (partition by trip_id order by seq) as pv from stops),
     nx as (select ac.trip_id, t, el, dep_sec_of_day, last_arr, s.station, s.arr_sec, pv from ac join st2 s on s.trip_id = ac.trip_id and pv is not null and (s.arr_sec >= el) qualify row_number() over (partition by ac.trip_id, t order by s.seq) = 1)
     select trip_id, t, case when el >= last_arr then station else pv || ' → ' || station end as section,
      lpad(cast(((dep_sec_of_day + arr_sec) % 86400) // 3600 as varchar), 2, '0') || ':' || lpad(cast(((dep_sec_of_day + arr_sec) % 3600) // 60 as varchar), 2, '0') as next_eta from nx""",
)
def _(t):
    return fleet.trip_section(_active(t), t.stops)


@query("k5_lookahead", _arc_with(along_sql("ratio + dir * (500e0 / len_m)")) + " select trip_id, t, part_id, round(lon, 6) as lon, round(lat, 6) as lat from ps")
def _(t):
    p = fleet.lookahead(_located(t), t.vertices, 500.0)
    return p.select("trip_id", "t", "part_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("k6_trailing_positions", _arc_with(along_sql("ratio - dir * u * (120e0 / len_m)", "u", "cross join range(3) z(u)")) + " select trip_id, t, cast(u as integer) as unit, part_id, round(lon, 6) as lon, round(lat, 6) as lat from ps")
def _(t):
    p = fleet.trailing_positions(_located(t), t.vertices, 3, 120.0)
    return p.select("trip_id", "t", "unit", "part_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _e6(c):
    """Whole millionths of a degree; the offset keeps exact halves apart."""
    return F.floor(F.col(c) * 1e6 + 0.1234567).cast("long").alias(f"{c}_e6")


SEGS = "sgm as (select entity_id, t as t0, lon as lon0, lat as lat0, lead(t) over w as t1, lead(lon) over w as lon1, lead(lat) over w as lat1 from {src} window w as (partition by entity_id order by t, ping_id))"
POS = """select entity_id, t, case when t1 is null then lon0 else lon0 + (lon1 - lon0) * (case when t1 > t0 then (t - t0) / (t1 - t0) else 0e0 end) end as lon,
 case when t1 is null then lat0 else lat0 + (lat1 - lat0) * (case when t1 > t0 then (t - t0) / (t1 - t0) else 0e0 end) end as lat from sgm join hr on (t1 is null and t = t0) or (t >= t0 and t < t1)"""
HOURS = "hr as (select distinct t // 3600 * 3600 as t from pings)"


@query("j17_positions_at", f"with {HOURS}, {SEGS.format(src='pings')} select entity_id, t, cast(floor(lon * 1e6 + 0.1234567e0) as bigint) as lon_e6, cast(floor(lat * 1e6 + 0.1234567e0) as bigint) as lat_e6 from ({POS}) q")
def _(t):
    hours = t.pings.select((F.floor(F.col("t") / 3600) * 3600).alias("t")).distinct()
    p = fleet.positions_at(t.pings, hours)
    return p.select("entity_id", "t", _e6("lon"), _e6("lat"))


CLEANED = f"{clean_sql('haversine')}, kp as (select entity_id, ping_id, t, lon, lat from f where kept and entity_id in (select entity_id from f where kept group by entity_id having count(*) >= 2))"


@query(
    "hourly_tile_counts",
    f"with {CLEANED}, hr as (select unnest(range((select min(t) from kp) // 3600 * 3600, (select max(t) from kp) + 1, 3600)) as t), {SEGS.format(src='kp')}, q as ({POS}), w as (select {TILE.format(n='1024e0')} from q) select tx, ty, count(*) as n from w group by tx, ty",
)
def _(t):
    """Clean the reports, place every entity at each full hour, count per tile."""
    clean = windows.drop_speed_anomalies(t.pings)
    p = fleet.timeline(clean, 3600)
    k = G.lonlat_to_tile("lon", "lat", 10)
    return p.groupBy(k["tx"].alias("tx"), k["ty"].alias("ty")).agg(F.count("*").alias("n"))


@query("k7_timeline", f"with hr as (select unnest(range((select min(t) from pings) // 7200 * 7200, (select max(t) from pings) + 1, 7200)) as t), {SEGS.format(src='pings')} select entity_id, t, cast(floor(lon * 1e6 + 0.1234567e0) as bigint) as lon_e6, cast(floor(lat * 1e6 + 0.1234567e0) as bigint) as lat_e6 from ({POS}) q")
def _(t):
    p = fleet.timeline(t.pings, 7200)
    return p.select("entity_id", "t", _e6("lon"), _e6("lat"))


@query("k7_trip_timeline", f"with {LEGS}, {ACT.replace(INST, 'ins as (select unnest(range(0, 86400, 1800)) as t)')}, {LOC} select trip_id, t, part_id, round(ratio, 6) as ratio from loc")
def _(t):
    s = fleet.trip_timeline(fleet.trip_spans(t.trips, t.stops), fleet.resolve_legs(t.stops, t.track_stations), 1800)
    return s.select("trip_id", "t", "part_id", F.round("ratio", 6).alias("ratio"))
