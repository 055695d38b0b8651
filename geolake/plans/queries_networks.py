"""Queries over networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, fleet, graph
from ..session import cut
from .queries_fleet import LEGS
from .queries_functions import hav_sql
from .registry import query

NODE = "cast(round_even({lon} / 1e-4, 0) as bigint) * 4294967296 + cast(round_even({lat} / 1e-4, 0) as bigint)"
ENDS = f"""en as (select part_id, 0 as port, {NODE.format(lon='arg_min(lon, seq)', lat='arg_min(lat, seq)')} as node, arg_min(lon, seq) as lon, arg_min(lat, seq) as lat from vertices group by part_id
 union all select part_id, 1, {NODE.format(lon='arg_max(lon, seq)', lat='arg_max(lat, seq)')}, arg_max(lon, seq), arg_max(lat, seq) from vertices group by part_id),
 dg as (select node, count(*) as degree from en group by node)"""
COMP = """cr as (select node, node as lab from (select a as node from eg union select b from eg) n union select e.b, cr.lab from cr join (select a, b from eg union all select b, a from eg) e on e.a = cr.node),
 cp as (select node, min(lab) as component from cr group by node)"""


@query("g1_endpoint_nodes", f"with {ENDS} select part_id, port, node, degree from en join dg using (node)")
def _(t):
    return graph.endpoint_nodes(t.vertices).select("part_id", "port", "node", "degree")


@query("g3_components", f"with {ENDS}, eg as (select a.node as a, b.node as b from en a join en b on a.part_id = b.part_id and a.port = 0 and b.port = 1), {COMP} select node, component from cp")
def _(t):
    e = graph.endpoint_nodes(t.vertices)
    ab = e.groupBy("part_id").agg(F.min_by("node", "port").alias("src"), F.max_by("node", "port").alias("dst"))
    return graph.components(ab)


# parts linked through nodes with exactly two ends of different parts, walked from each chain's lowest part
STITCH = f"""{ENDS}, lk as (select a.part_id as a, a.port as pa, b.part_id as b, b.port as pb from en a join en b using (node) join dg using (node) where degree = 2 and a.part_id <> b.part_id),
 eg as (select a, b from lk), {COMP}, pc as (select part_id, coalesce(component, part_id) as chain_id from (select distinct part_id from en) q left join cp on node = part_id),
 up as (select chain_id, chain_id as part_id, 0 as rel, false as flipped from pc where part_id = chain_id union all select u.chain_id, l.b, u.rel + 1, l.pb = 1 from up u join lk l on l.a = u.part_id and l.pa = (case when flipped then 0 else 1 end) where l.b <> u.chain_id and rel < 1000),
 dn as (select chain_id, chain_id as part_id, 0 as rel, false as flipped from pc where part_id = chain_id union all select d.chain_id, l.b, d.rel - 1, l.pb = 0 from dn d join lk l on l.a = d.part_id and l.pa = (case when flipped then 1 else 0 end) where l.b <> d.chain_id and rel > -1000),
 al as (select * from up union select * from dn), rk as (select chain_id, part_id, rel - min(rel) over (partition by chain_id) as pos, flipped from al)"""


@query("g2_stitch_order", f"with {STITCH} select chain_id, part_id, pos, flipped from rk")
def _(t):
    return graph.stitch_order(t.vertices)[0].select("chain_id", "part_id", F.col("pos").cast("int").alias("pos"), "flipped")


@query(
    "g2_stitch",
    f"""with {STITCH}, vv as (select chain_id, pos, case when flipped then 19 - v.seq else v.seq end as l, lon, lat from rk join vertices v using (part_id)),
     k as (select * from vv where pos = 0 or l > 0) select chain_id, row_number() over (partition by chain_id order by pos, l) - 1 as seq, lon, lat from k""",
)
def _(t):
    return graph.stitch(t.vertices).select("chain_id", "seq", "lon", "lat")


CHAINV = f"""vv as (select chain_id, pos, case when flipped then 19 - v.seq else v.seq end as l, lon, lat from rk join vertices v using (part_id)),
 cv as (select chain_id, row_number() over (partition by chain_id order by pos, l) - 1 as seq, lon, lat from (select * from vv where pos = 0 or l > 0) q),
 ce as (select chain_id, w as which, case when w = 0 then arg_min(lon, seq) else arg_max(lon, seq) end as lon, case when w = 0 then arg_min(lat, seq) else arg_max(lat, seq) end as lat from cv cross join range(2) z(w) group by chain_id, w),
 cd as (select chain_id, which, lon, lat, node, degree from (select *, {NODE.format(lon='lon', lat='lat')} as node from ce) q join dg using (node)),
 nr as (select c.chain_id, c.which, r.chain_id as near_chain, r.seq as near_seq, {hav_sql('c.lon', 'c.lat', 'r.lon', 'r.lat')} as d from cd c join cv r on r.chain_id <> c.chain_id
   and abs(trunc(r.lon / 0.03e0) - trunc(c.lon / 0.03e0)) <= 1 and abs(trunc(r.lat / 0.03e0) - trunc(c.lat / 0.03e0)) <= 1 where c.degree = 1 and {hav_sql('c.lon', 'c.lat', 'r.lon', 'r.lat')} < 2900
   qualify row_number() over (partition by c.chain_id, c.which order by {hav_sql('c.lon', 'c.lat', 'r.lon', 'r.lat')}, r.chain_id, r.seq) = 1)"""


@query("g4_snap_dangling", f"with {STITCH}, {CHAINV} select cd.chain_id, cast(cd.which as integer) as which, degree, coalesce(near_chain, -1) as near_chain, coalesce(round(d, 3), -1e0) as dist_m from cd left join nr using (chain_id, which)")
def _(t):
    e, _, _ = graph.snap_dangling(t.vertices, tol_m=2900.0, cell=0.03)
    return e.select("chain_id", "which", "degree", F.coalesce("near_chain", F.lit(-1)).alias("near_chain"), F.coalesce(F.round("dist_m", 3), F.lit(-1.0)).alias("dist_m"))


@query(
    "g4_systems",
    f"""with {STITCH.replace('eg as', 'eg as materialized')}, {CHAINV}, ew as (select a.node as a, b.node as b from cd a join cd b on a.chain_id = b.chain_id and a.which = 0 and b.which = 1
      union all select c.node, s.node from nr join cd c using (chain_id, which) join cd s on s.chain_id = near_chain and s.which = 0),
     c2 as (select node, node as lab from cd union select e.b, c2.lab from c2 join (select a, b from ew union all select b, a from ew) e on e.a = c2.node), c3 as (select node, min(lab) as component from c2 group by node)
     select chain_id, component from cd join c3 using (node) where which = 0""",
)
def _(t):
    return graph.snap_dangling(t.vertices, tol_m=2900.0, cell=0.03)[1]


@query(
    "g4_report",
    f"with {STITCH}, {CHAINV} select count(*) filter (where degree = 1) as checked, (select count(*) from nr) as snapped from cd",
)
def _(t):
    return graph.snap_dangling(t.vertices, tol_m=2900.0, cell=0.03)[2]


FAIL = f"{LEGS}, fp as (select least(f, t2) as a, greatest(f, t2) as b, count(*) as n from rl where part_id < 0 group by 1, 2)"
BRIDGE = f"""{FAIL}, tip as (select part_id, station as bridge, case when ratio > 0.5e0 then 'end' else 'start' end as side from track_stations where ratio < 0.05e0 or ratio > 0.95e0),
 ha as (select a, b, bridge, min((tip.part_id, side)) as pa from fp join track_stations s on s.station = a join tip using (part_id) group by all),
 hb as (select a, b, bridge, min((tip.part_id, side)) as pb from fp join track_stations s on s.station = b join tip using (part_id) group by all),
 br as (select a, b, arg_min((pa, pb), bridge) as m, min(bridge) as bridge from ha join hb using (a, b, bridge) group by a, b),
 bb as (select a, b, bridge, m[1][1] as part_a, m[1][2] as side_a, m[2][1] as part_b, m[2][2] as side_b from br),
 ed as (select least(part_a, part_b) as p, greatest(part_a, part_b) as q, a, b, bridge, case when part_a > part_b then side_b else side_a end as side_p, case when part_a > part_b then side_a else side_b end as side_q from bb),
 pl as (select * from ed qualify row_number() over (partition by p, q order by a, b) = 1)"""


def _pairs(t):
    legs = fleet.resolve_legs(t.stops, t.track_stations).withColumn("matched", F.col("part_id") >= 0)
    return cut(aggs.failing_pairs(legs))  # used for both ends, and for what is left


@query("j22_find_bridges", f"with {BRIDGE} select a, b, bridge, part_a, side_a, part_b, side_b from bb")
def _(t):
    return graph.find_bridges(t.track_stations, _pairs(t))


@query("g5_merge_plan", f"with {BRIDGE} select p, q, bridge, side_p, side_q from pl")
def _(t):
    return graph.merge_plan(t.track_stations, _pairs(t))[0]


@query("g5_unresolved", f"with {BRIDGE} select a, b, n from fp where (a, b) not in (select (a, b) from bb)")
def _(t):
    return graph.merge_plan(t.track_stations, _pairs(t))[1]


@query(
    "g6_simple_paths",
    f"""with {BRIDGE}, hf as (select p as part_id from pl union all select q from pl), d as (select part_id, count(*) as deg from hf group by part_id)
     select part_id, case when deg >= 3 then deg else 1 end as copies from d""",
)
def _(t):
    # every merged part appears once, branch parts once per link
    p = graph.simple_paths(graph.merge_plan(t.track_stations, _pairs(t))[0])
    return p.groupBy("part_id").agg(F.count("*").alias("copies"))
