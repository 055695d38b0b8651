"""Queries over trajectories, line vertices and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import windows as win
from ..operators.ordered import know_layout
from .queries_functions import TM2, hav_sql
from .registry import query

HKM = f"({hav_sql('lon0', 'lat0', 'lon', 'lat')} / 1e3)"
FLAT = "sqrt(pow((lat - lat0) * 111e0, 2) + pow((lon - lon0) * 101e0, 2))"


def _speed_sql(dist):
    return f"""with p as (select *, lag(lon) over w as lon0, lag(lat) over w as lat0, lag(t) over w as t0 from pings window w as (partition by entity_id order by t, ping_id))
     select ping_id, case when t0 is null then -1e0 when t <= t0 then 0e0 else round({dist} / ((t - t0) / 3600e0) / 1.852e0, 4) end as knots from p"""


def _speed(t, metric):
    return win.ping_speed(t.pings, metric).select("ping_id", F.coalesce(F.round("knots", 4), F.lit(-1.0)).alias("knots"))


@query("w1_ping_speed", _speed_sql(HKM))
def _(t):
    return _speed(t, "haversine")


@query("w1_ping_speed_flat", _speed_sql(FLAT))
def _(t):
    return _speed(t, "flat")


@query("w1_hot", f"with hp as (select * exclude (t), t - 1704800000 as t from pings), {_speed_sql(HKM)[5:].replace('from pings', 'from hp')}")
def _(t):
    """Every entity above 20 reports is cut into slices; times around zero, so that
    slices have negative numbers, 0 and positive ones."""
    p = know_layout(t.pings.withColumn("t", F.col("t") - 1704800000), "entity_id", 20)
    return win.ping_speed(p, "haversine").select("ping_id", F.coalesce(F.round("knots", 4), F.lit(-1.0)).alias("knots"))


# a list fold per entity that remembers the last kept report
CLEAN = """o as (select entity_id, ping_id, t, lon, lat, row_number() over (partition by entity_id order by t, ping_id) as rn from pings),
 f as (select entity_id, ping_id, rn, t, lon, lat, true as kept, lon as klon, lat as klat, t as kt from o where rn = 1
  union all
  select o.entity_id, o.ping_id, o.rn, o.t, o.lon, o.lat, {ok} as kept,
   case when {ok} then o.lon else klon end, case when {ok} then o.lat else klat end, case when {ok} then o.t else kt end
  from f join o on o.entity_id = f.entity_id and o.rn = f.rn + 1)"""


def clean_sql(metric):
    if metric == "flat":
        d = "sqrt(pow((o.lat - klat) * 111e0, 2) + pow((o.lon - klon) * 101e0, 2))"
    else:
        d = f"({hav_sql('klon', 'klat', 'o.lon', 'o.lat')} / 1e3)"
    return CLEAN.format(ok=f"(o.t <= kt or {d} / ((o.t - kt) / 3600e0) / 1.852e0 <= 40)")


@query("w2_drop_speed_anomalies", f"with {clean_sql('haversine')} select ping_id, entity_id from f where kept and entity_id in (select entity_id from f where kept group by entity_id having count(*) >= 2)")
def _(t):
    return win.drop_speed_anomalies(t.pings).select("ping_id", "entity_id")


@query("w2_dropped_counts_flat", f"with {clean_sql('flat')} select entity_id, count(*) as n, count(*) filter (where not kept) as dropped from f group by entity_id")
def _(t):
    f = win.flag_speed_anomalies(t.pings, metric="flat")
    return f.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("dropped"))


ARC = TM2.format(id="part_id, seq, lon, lat, elev", src="vertices") + """, st as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0e0) as step
   from tm join vertices v0 using (part_id, seq) window w as (partition by part_id order by seq)),
 arc as (select part_id, seq, cum as cum_m, max(cum) over (partition by part_id) as length_m from (select *, sum(step) over (partition by part_id order by seq) as cum from st) st)"""


@query("w3_arc_ratio", ARC + " select part_id, seq, round(cum_m, 3) as cum_m, round(cum_m / length_m, 6) as ratio from arc")
def _(t):
    return win.arc_ratio(t.vertices).select("part_id", "seq", F.round("cum_m", 3).alias("cum_m"), F.round("ratio", 6).alias("ratio"))


@query("w3_hot", ARC.replace("vertices", "hv").replace("with ", "with hv as (select * exclude (seq), (seq - 3) * 65536 as seq from vertices), ", 1) + " select part_id, seq, round(cum_m, 3) as cum_m, round(cum_m / length_m, 6) as ratio from arc")
def _(t):
    """Every line above 3 vertices is cut, each vertex into a slice of its own."""
    v = know_layout(t.vertices.withColumn("seq", (F.col("seq") - 3) * 65536), "part_id", 3)
    return win.arc_ratio(v).select("part_id", "seq", F.round("cum_m", 3).alias("cum_m"), F.round("ratio", 6).alias("ratio"))


@query(
    "w4_ring_roll_min",
    """with o as (select feature_id, ring_id, seq, round((lon - 119) * 100.37e0 - (lat - 22) * 50.11e0, 4) as elev from rings where seq < 16),
     a as (select a.feature_id, a.ring_id, a.seq, min(b.elev) as m from o a join o b on a.feature_id = b.feature_id and a.ring_id = b.ring_id
       and ((b.seq - a.seq + 16) % 16 <= 2 or (a.seq - b.seq + 16) % 16 <= 2) group by all)
     select feature_id, ring_id, seq, greatest(m, -3e0) as rolled from a""",
)
def _(t):
    o = geo.open_rings(t.rings, ["feature_id", "ring_id"]).withColumn("elev", F.expr("round((lon - 119) * 100.37e0 - (lat - 22) * 50.11e0, 4)"))
    return win.ring_roll_min(o, ["feature_id", "ring_id"], "elev").select("feature_id", "ring_id", "seq", "rolled")


@query(
    "w5_profile_envelope",
    """with e as (select part_id, seq, max(elev) over (partition by part_id order by seq rows between 3 preceding and 3 following) as e0 from vertices),
     a as (select *, avg(e0) over (partition by part_id order by seq rows between 3 preceding and 3 following) as a1 from e),
     b as (select *, avg(a1) over (partition by part_id order by seq rows between 3 preceding and 3 following) as a2 from a),
     c as (select *, avg(a2) over (partition by part_id order by seq rows between 3 preceding and 3 following) as a3 from b)
     select part_id, seq, e0 as envelope, round(a3, 6) as smooth from c""",
)
def _(t):
    p = t.vertices.withColumnRenamed("elev", "ground")
    return win.profile_envelope(p, "part_id", 3).select("part_id", "seq", "envelope", F.round("smooth", 6).alias("smooth"))


@query(
    "w6_to_segments",
    """with s as (select part_id, seq, lon as lon0, lat as lat0, lead(lon) over w as lon1, lead(lat) over w as lat1 from vertices window w as (partition by part_id order by seq))
     select * from s where lon1 is not null""",
)
def _(t):
    return win.to_segments(t.vertices).select("part_id", "seq", "lon0", "lat0", "lon1", "lat1")


@query(
    "w7_clip_runs",
    """with i as (select part_id, seq, lat between 22.0002e0 and 23e0 and lon between 119.5e0 and 121e0 as ok from vertices),
     s as (select *, case when ok and not coalesce(lag(ok) over w, false) then 1 else 0 end as st from i window w as (partition by part_id order by seq)),
     r as (select *, cast(sum(st) over (partition by part_id order by seq) as bigint) as run_id from s),
     k as (select part_id, seq, run_id, count(*) over (partition by part_id, run_id) as run_n from r where ok)
     select * from k where run_n >= 2""",
)
def _(t):
    r = win.clip_runs(t.vertices, (119.5, 22.0002, 121.0, 23.0))
    return r.select("part_id", "seq", "run_id", "run_n")


@query(
    "w8_top_n",
    f"""with d as (select set_id, feature_id, {hav_sql('lon', 'lat', '121e0', '23.7e0')} as d from points)
     select set_id, feature_id, cast(row_number() over (partition by set_id order by d, feature_id) as integer) as rank from d
     qualify row_number() over (partition by set_id order by d, feature_id) <= 20""",
)
def _(t):
    from .. import functions as G

    d = t.points.withColumn("d", G.haversine_m("lon", "lat", 121.0, 23.7))
    return win.top_n(d, "set_id", ["d", "feature_id"], 20).select("set_id", "feature_id", "rank")


@query(
    "w9_end_labels",
    """with a as (select part_id, arg_min({'s': station, 'd': dist_m}, (ratio, dist_m, station)) as a, arg_max({'s': station, 'd': dist_m}, (ratio, -dist_m, station)) as b from track_stations group by part_id)
     select part_id, a.s as first_station, b.s as last_station, case when a.d < 300 and b.d < 300 and a.s <> b.s then a.s || '→' || b.s else '' end as label from a""",
)
def _(t):
    return win.end_labels(t.track_stations)


@query(
    "w10_sample_vertices",
    """with n as (select part_id, max(seq) + 1 as n from vertices group by part_id),
     i as (select part_id, seq, row_number() over (partition by part_id order by seq) - 1 as k, count(*) over (partition by part_id) as m
       from vertices join n using (part_id) where seq % 2 = 0 or seq = n - 1),
     p as (select distinct part_id, cast(round_even(j * (m - 1) / 4e0, 0) as bigint) as k from (select distinct part_id, m from i) cross join range(5) r(j))
     select i.part_id, i.seq from i left join p using (part_id, k) where m <= 5 or p.k is not null""",
)
def _(t):
    return win.sample_vertices(t.vertices, 2, 5).select("part_id", "seq")


AXIS = """with m as (select {k}, seq, lon, lat, radians(lon) * cos(radians(avg(lat) over (partition by {k}))) * 6371000e0 as x, radians(lat) * 6371000e0 as y from {src}),
 c as (select *, avg(x) over (partition by {k}) as cx, avg(y) over (partition by {k}) as cy from m),
 s as (select {k}, sum((x-cx)*(x-cx)) as sxx, sum((y-cy)*(y-cy)) as syy, sum((x-cx)*(y-cy)) as sxy from c group by {k}),
 l as (select *, (sxx+syy)/2e0 + sqrt(greatest(0e0, pow(sxx+syy,2)/4e0 - (sxx*syy - sxy*sxy))) as lam from s),
 v as (select {k}, case when abs(sxy) > 1e-9 then lam - syy when sxx >= syy then 1e0 else 0e0 end as vx, case when abs(sxy) > 1e-9 then sxy when sxx >= syy then 0e0 else 1e0 end as vy from l),
 ax as (select {k}, vx / sqrt(vx*vx+vy*vy) as ux, vy / sqrt(vx*vx+vy*vy) as uy from v),
 al as (select c.*, (x-cx)*ux + (y-cy)*uy as along from c join ax on {on})"""
V_AXIS = AXIS.format(k="part_id", src="vertices", on="c.part_id = ax.part_id")
R_AXIS = AXIS.format(k="feature_id", src="(select * from rings where ring_id = 0 and seq < 16)", on="c.feature_id = ax.feature_id")


@query("w11_anchors", V_AXIS + """, r as (select *, row_number() over (partition by part_id order by along, lon, lat) - 1 as k, count(*) over (partition by part_id) as n from al)
 select part_id, f as frac, lon, lat from r join (values (0.4e0), (0.7e0)) q(f) on k = greatest(0, least(n - 1, cast(floor(n * f) as bigint)))""")
def _(t):
    return win.anchors(t.vertices, [0.4, 0.7], "part_id").select("part_id", "frac", "lon", "lat")


@query("w12_trip_direction", "select trip_id, arg_min(station, seq) || '→' || arg_max(station, seq) as direction from stops group by trip_id")
def _(t):
    return win.trip_direction(t.stops)


@query(
    "w13_to_legs",
    """with l as (select trip_id, seq, station as from_station, lead(station) over w as to_station, dep_sec, lead(arr_sec) over w as to_arr_sec from stops window w as (partition by trip_id order by seq))
     select * from l where to_station is not null""",
)
def _(t):
    return win.to_legs(t.stops).select("trip_id", "seq", "from_station", "to_station", "dep_sec", "to_arr_sec")


@query("a12_principal_axis", V_AXIS + " select part_id, round(ux, 6) as ux, round(uy, 6) as uy from ax")
def _(t):
    return win.main_axis(t.vertices, "part_id").select("part_id", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"))


RING_AREA = """with k as (select feature_id, ring_id, cos(radians(avg(lat))) as k, min(lon) as ox, min(lat) as oy from rings group by all),
 e as (select feature_id, ring_id, seq, lon as lon0, lat as lat0, coalesce(lead(lon) over w, first(lon) over w) as lon, coalesce(lead(lat) over w, first(lat) over w) as lat from rings window w as (partition by feature_id, ring_id order by seq)),
 m as (select feature_id, ring_id, sum(radians(lon0-ox)*k*radians(lat-oy) - radians(lon-ox)*k*radians(lat0-oy)) / 2e0 * 6371000e0 * 6371000e0 as signed_m2, sum({h}) as perimeter_m from e join k using (feature_id, ring_id) group by all)""".format(h=hav_sql("lon0", "lat0", "lon", "lat"))


@query("a13_ring_metrics", RING_AREA + " select feature_id, ring_id, round(signed_m2, 2) as signed_m2, round(perimeter_m, 3) as perimeter_m, round(2 * abs(signed_m2) / perimeter_m, 4) as width_m from m")
def _(t):
    m = geo.ring_metrics(t.rings, ["feature_id", "ring_id"])
    return m.select("feature_id", "ring_id", F.round("signed_m2", 2).alias("signed_m2"), F.round("perimeter_m", 3).alias("perimeter_m"), F.round("width_m", 4).alias("width_m"))


@query(
    "a13_ring_metrics_planar",
    TM2.format(id="feature_id, ring_id, seq", src="rings") + """, o as (select feature_id, ring_id, seq, x - min(x) over w as x, y - min(y) over w as y from tm window w as (partition by feature_id, ring_id)),
     e as (select feature_id, ring_id, x as x0, y as y0, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1 from o window w as (partition by feature_id, ring_id order by seq))
     select feature_id, ring_id, round(abs(sum(x0*y1 - x1*y0)) / 2e0 / 1e6, 6) as area_km2 from e group by all""",
)
def _(t):
    m = geo.ring_metrics(t.rings, ["feature_id", "ring_id"], planar=True)
    return m.select("feature_id", "ring_id", F.round(F.col("area_m2") / 1e6, 6).alias("area_km2"))


@query(
    "a14_line_length",
    f"""with s as (select part_id, lag(lon) over w as lon0, lag(lat) over w as lat0, lon, lat from vertices window w as (partition by part_id order by seq))
     select part_id, round(sum({hav_sql('lon0', 'lat0', 'lon', 'lat')}), 3) as length_m from s where lon0 is not null group by part_id""",
)
def _(t):
    return win.line_length(t.vertices).select("part_id", F.round("length_m", 3).alias("length_m"))


@query("a18_largest_ring", RING_AREA + """ select r.feature_id, r.ring_id, r.seq, r.lon, r.lat from rings r join
 (select feature_id, arg_min(ring_id, (-abs(signed_m2), ring_id)) as ring_id from m group by feature_id) b using (feature_id, ring_id)""")
def _(t):
    return geo.largest_ring(t.rings, "feature_id", "ring_id").select("feature_id", "ring_id", "seq", "lon", "lat")


def dp_sql(src, keys, tol, x="lon", y="lat"):
    """Split every open segment at its farthest vertex, level by level."""
    kk = ", ".join(keys)
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    gk = ", ".join(f"g.{k}" for k in keys)
    return f"""dv as materialized (select {kk}, seq, {x} as x, {y} as y, {tol} as tol from {src}),
 ds as (select {kk}, min(seq) as s, max(seq) as e, 'inf'::double as cap from dv group by {kk}
  union all
  select {kk}, unnest([s, m]) as s, unnest([m, e]) as e, least(cap, d) as cap from (
   select {gk}, g.s, g.e, g.cap, arg_max(v.seq, (sqrt(pow(v.x - (a.x + tt * (b.x - a.x)), 2) + pow(v.y - (a.y + tt * (b.y - a.y)), 2)), -v.seq)) as m,
     max(sqrt(pow(v.x - (a.x + tt * (b.x - a.x)), 2) + pow(v.y - (a.y + tt * (b.y - a.y)), 2))) as d, any_value(v.tol) as tol
   from ds g join dv a on {on('a', 'g')} and a.seq = g.s join dv b on {on('b', 'g')} and b.seq = g.e
     join dv v on {on('v', 'g')} and v.seq > g.s and v.seq < g.e
     cross join lateral (select case when pow(b.x-a.x,2)+pow(b.y-a.y,2) = 0 then 0e0 else least(greatest(((v.x-a.x)*(b.x-a.x)+(v.y-a.y)*(b.y-a.y)) / ((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)), 0e0), 1e0) end as tt) q
   group by {gk}, g.s, g.e, g.cap) h where d > tol),
 dk as (select {kk}, seq, max(cap) as imp from (select {kk}, s as seq, cap from ds union all select {kk}, e, cap from ds) u group by {kk}, seq)"""


@query("e1_simplify", f"with {dp_sql('vertices', ['part_id'], '2e-4::double')} select part_id, seq from dk")
def _(t):
    return geo.simplify(t.vertices, 2e-4).select("part_id", "seq")


@query("e1_simplify_by_type", f"with {dp_sql('vertices', ['part_id'], 'case when system >= 5 then 4e-4 else 1e-4 end')} select part_id, seq from dk")
def _(t):
    return geo.simplify(t.vertices, F.when(F.col("system") >= 5, 4e-4).otherwise(1e-4)).select("part_id", "seq")


E2 = TM2.format(id="feature_id, ring_id, seq", src="rings") + """, tl as (select feature_id, ring_id, case when count(*) < 5 then -1e0 else least(greatest(sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)) * 0.05e0, 80e0), 470e0) end as tol from tm group by all),
 src as (select * from tm join tl using (feature_id, ring_id)), """


@query("e2_simplify_scaled", E2 + dp_sql("src", ["feature_id", "ring_id"], "tol", "x", "y") + " select feature_id, ring_id, seq from dk")
def _(t):
    s = geo.simplify_scaled(t.rings, 470.0, 80.0, 0.05, ["feature_id", "ring_id"])
    return s.select("feature_id", "ring_id", "seq")


DAYTRAILS = """tr as (select *, cast(floor((t + 28800) / 86400) as bigint) % 3 as day, row_number() over (partition by entity_id, cast(floor((t + 28800) / 86400) as bigint) % 3 order by t, ping_id) as seq from pings)"""


def _daytrails(t):
    from ..operators.ordered import row_number

    p = t.pings.withColumn("day", F.floor((F.col("t") + 28800) / 86400).cast("long") % 3)
    return row_number(p, ["entity_id", "day"], ["t", "ping_id"], "seq")


TOLS = [0.01, 0.02, 0.04, 0.08]


@query(
    "e3_simplify_to_budget",
    f"with {DAYTRAILS}, {dp_sql('tr', ['day', 'entity_id'], '0.01e0')}, "
    f"""z as (select day, imp, length(cast(round(lat, 6) as varchar) || ',' || cast(round(lon, 6) as varchar) || ',' || cast(t as varchar)) + 3 as b from dk join tr using (day, entity_id, seq)),
    p as (select day, k, cast(sum(b) as bigint) as bytes, count(*) as points from z join (values (0, 0.01e0), (1, 0.02e0), (2, 0.04e0), (3, 0.08e0)) q(k, tol) on imp > tol group by day, k)
    select day, k, bytes, points from p qualify row_number() over (partition by day order by case when bytes <= 60000 then k else 100 - k end) = 1""",
)
def _(t):
    _, report = geo.simplify_to_budget(_daytrails(t), 60000, "day", "entity_id", TOLS)
    return report.select("day", "k", "bytes", "points")


@query(
    "e4_clip_slab",
    """with o as (select feature_id, ring_id, seq, lon, lat from rings where seq < 16),
     e as (select feature_id, ring_id, seq, lon as x0, lat as y0, coalesce(lead(lon) over w, first(lon) over w) as x1, coalesce(lead(lat) over w, first(lat) over w) as y1
       from o window w as (partition by feature_id, ring_id order by seq)),
     a as (select feature_id, ring_id, seq * 2 as seq, x0 as x, y0 as y from e where y0 >= 22.5e0 union all
       select feature_id, ring_id, seq * 2 + 1, x0 + (22.5e0 - y0) / (y1 - y0) * (x1 - x0), 22.5e0 from e where (y0 >= 22.5e0) <> (y1 >= 22.5e0)),
     e2 as (select feature_id, ring_id, seq, x as x0, y as y0, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1
       from a window w as (partition by feature_id, ring_id order by seq)),
     b as (select feature_id, ring_id, seq * 2 as seq, x0 as x, y0 as y from e2 where y0 <= 23.51e0 union all
       select feature_id, ring_id, seq * 2 + 1, x0 + (23.51e0 - y0) / (y1 - y0) * (x1 - x0), 23.51e0 from e2 where (y0 <= 23.51e0) <> (y1 <= 23.51e0))
     select feature_id, ring_id, row_number() over (partition by feature_id, ring_id order by seq) as pos, round(x, 6) as lon, round(y, 6) as lat from b""",
)
def _(t):
    from ..operators.ordered import row_number

    o = geo.open_rings(t.rings, ["feature_id", "ring_id"])
    c = geo.clip_slab(o, F.col("lat"), 22.5, 23.51, ["feature_id", "ring_id"])
    c = row_number(c, ["feature_id", "ring_id"], "seq", "pos")
    return c.select("feature_id", "ring_id", "pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "e5_slice_reaches",
    R_AXIS + """, sp as (select feature_id, min(along) as t0, greatest(1, cast(round_even((max(along) - min(along)) / 900e0, 0) as bigint)) as n, (max(along) - min(along)) / greatest(1e0, round_even((max(along) - min(along)) / 900e0, 0)) as step from al group by feature_id),
     ed as (select feature_id, seq, lon as x0, lat as y0, along as ta, coalesce(lead(lon) over w, first(lon) over w) as x1, coalesce(lead(lat) over w, first(lat) over w) as y1, coalesce(lead(along) over w, first(along) over w) as tb from al window w as (partition by feature_id order by seq)),
     sb as (select ed.*, sp.t0, unnest(range(n)) as k, n, step from ed join sp using (feature_id) where n > 1),
     lh as (select *, t0 + step * k - 1e-6 as lo, t0 + step * (k + 1) + case when k = n - 1 then 1e-6 else 0e0 end as hi from sb),
     pt as (select feature_id, k, seq, -1e0 as a, x0 as x, y0 as y from lh where ta >= lo and ta <= hi
      union all select feature_id, k, seq, (lo - ta) / (tb - ta), x0 + (lo - ta) / (tb - ta) * (x1 - x0), y0 + (lo - ta) / (tb - ta) * (y1 - y0) from lh where (ta < lo) <> (tb < lo)
      union all select feature_id, k, seq, (hi - ta) / (tb - ta), x0 + (hi - ta) / (tb - ta) * (x1 - x0), y0 + (hi - ta) / (tb - ta) * (y1 - y0) from lh where (ta <= hi) <> (tb <= hi)
      union all select feature_id, -1, seq, -1e0, lon, lat from al),
     pe as (select feature_id, k, x as x0, y as y0, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1 from pt window w as (partition by feature_id, k order by seq, a)),
     ps as (select feature_id, k, count(*) as np, cos(radians((sum(y) + arg_min(y, (seq, a))) / (count(*) + 1))) as c, min(x) as ox, min(y) as oy from pt group by feature_id, k),
     ar as (select feature_id, k, any_value(np) as np, abs(sum(radians(x0-ox)*c*radians(y1-oy) - radians(x1-ox)*c*radians(y0-oy))) / 2e0 * 6371000e0 * 6371000e0 as area from pe join ps using (feature_id, k) group by feature_id, k),
     ok as (select * from ar where k >= 0 and np >= 3 and area > 500)
     select feature_id, k as slice_id, np as vertices, round(area, 1) as area_m2 from ok union all select feature_id, -1, np, round(area, 1) from ar where k = -1 and feature_id not in (select feature_id from ok)""",
)
def _(t):
    o = geo.open_rings(t.rings.where("ring_id = 0"), "feature_id")
    s = geo.slice_reaches(o, "feature_id")
    return s.groupBy("feature_id", "slice_id").agg(F.count("*").alias("vertices"), F.round(F.first("area_m2"), 1).alias("area_m2"))


@query("e8_keep_holes", """with k as (select feature_id, ring_id, cos(radians((sum(lat) + arg_min(lat, seq)) / 17)) as k, min(lon) as ox, min(lat) as oy from rings where ring_id = 1 and seq < 16 group by all),
 e as (select feature_id, ring_id, lon as lon0, lat as lat0, coalesce(lead(lon) over w, first(lon) over w) as lon1, coalesce(lead(lat) over w, first(lat) over w) as lat1 from rings where ring_id = 1 and seq < 16 window w as (partition by feature_id, ring_id order by seq)),
 m as (select feature_id, ring_id, abs(sum(radians(lon0-ox)*k*radians(lat1-oy) - radians(lon1-ox)*k*radians(lat0-oy))) / 2e0 * 6371000e0 * 6371000e0 as area from e join k using (feature_id, ring_id) group by all),
 src as (select r.feature_id, r.ring_id, r.seq, r.lon, r.lat from rings r join m using (feature_id, ring_id) where seq < 16 and area >= 2e6), """
 + dp_sql("src", ["feature_id", "ring_id"], "1e-3::double") + " select feature_id, ring_id, seq from dk where (feature_id, ring_id) in (select (feature_id, ring_id) from dk group by feature_id, ring_id having count(*) >= 3)")
def _(t):
    return geo.keep_holes(t.rings.where("ring_id = 1"), 2e6, 1e-3, ["feature_id", "ring_id"]).select("feature_id", "ring_id", "seq")


FLAT_RINGS = """fr as (select s_suppkey as feature_id, q.r as ring_id, i as seq,
  q.ox * 1e0 + case when (case when turn > 0 then i else 3 - i end) in (1, 2) then size else 0e0 end as x,
  q.oy * 1e0 + case when (case when turn > 0 then i else 3 - i end) in (2, 3) then size else 0e0 end as y
  from supplier cross join (values (0, 0, 0, 1, 2000e0), (1, 500, 500, -1, 1000e0), (2, 5000, 0, 1, 500e0), (3, 5100, 100, -1, 50e0)) q(r, ox, oy, turn, size) cross join range(4) s(i)
  where q.r < 2 + s_nationkey % 3)"""


def _flat_rings(t):
    # a square with a hole, then a second square and its hole, for some features
    spec = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("r", "ox", "oy", "turn", "size"), row)]) for row in
                     ((0, 0.0, 0.0, 1, 2000.0), (1, 500.0, 500.0, -1, 1000.0), (2, 5000.0, 0.0, 1, 500.0), (3, 5100.0, 100.0, -1, 50.0))])
    r = t.supplier.select(F.col("s_suppkey").alias("feature_id"), "s_nationkey", F.explode(spec).alias("q")).where(F.col("q.r") < F.col("s_nationkey") % 3 + 2)
    r = r.select("feature_id", "q", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    c = F.when(F.col("q.turn") > 0, F.col("seq")).otherwise(3 - F.col("seq"))
    return r.select("feature_id", F.col("q.r").alias("ring_id"), "seq",
                    (F.col("q.ox") + F.when(c.isin(1, 2), F.col("q.size")).otherwise(0.0)).alias("x"),
                    (F.col("q.oy") + F.when(c.isin(2, 3), F.col("q.size")).otherwise(0.0)).alias("y"))


FLAT_AREA = """, fe as (select feature_id, ring_id, x as x0, y as y0, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1 from fr window w as (partition by feature_id, ring_id order by seq)),
 fa as (select feature_id, ring_id, sum(x0*y1 - x1*y0)/2e0 as signed from fe group by all),
 fg as (select *, sign(signed) = first(sign(signed)) over (partition by feature_id order by ring_id) as is_exterior from fa where signed <> 0),
 fp as (select *, cast(sum(case when is_exterior then 1 else 0 end) over (partition by feature_id order by ring_id) as bigint) as poly_id from fg)"""


@query("e9_group_rings", f"with {FLAT_RINGS}{FLAT_AREA} select feature_id, ring_id, signed, is_exterior, poly_id from fp")
def _(t):
    return geo.group_rings(geo.plane_areas(_flat_rings(t), ["feature_id", "ring_id"])).select("feature_id", "ring_id", "signed", "is_exterior", "poly_id")


@query("e10_polygon_area", f"with {FLAT_RINGS}{FLAT_AREA} select feature_id, sum(case when is_exterior then abs(signed) else -abs(signed) end) as net_area, max(poly_id) as polygons from fp group by feature_id")
def _(t):
    return geo.polygon_area(geo.plane_areas(_flat_rings(t), ["feature_id", "ring_id"]))


@query("e11_point_at", ARC + """, rr as (select part_id, seq, cum_m / length_m as r, length_m, lon, lat, elev from arc join vertices using (part_id, seq)),
 sg as (select *, lead(r) over w as r1, lead(lon) over w as lon1, lead(lat) over w as lat1 from rr window w as (partition by part_id order by seq)),
 qq as (select l_orderkey, l_linenumber, l_partkey, l_suppkey as part_id, least(greatest(l_discount * 12e0 - 0.1e0, 0e0), 1e0) as q from lineitem)
 select l_orderkey, l_linenumber, l_partkey, part_id, round(lon + (lon1 - lon) * (q - r) / (r1 - r), 6) as lon, round(lat + (lat1 - lat) * (q - r) / (r1 - r), 6) as lat
 from qq join sg using (part_id) where r1 > r and ((q >= r and q < r1) or (q >= 1 and r1 >= 1))""")
def _(t):
    q = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey as part_id", "l_discount * 12e0 - 0.1e0 as ratio")
    p = geo.point_at(q, t.vertices)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "part_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
