"""Whole chains from raw sources to stored layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as G
from ..operators import aggs, attrs, fleet, geometry, graph, joins, sampling, spatial, windows
from ..operators.ordered import row_number
from ..session import cut, scratch_path
from ..sources import readers, sinks
from .queries_fleet import ALL_TRIPS, LEGS, REPORT, _dropped
from .queries_functions import hav_sql
from .queries_lines import TOLS, clean_sql, dp_sql
from .queries_networks import BRIDGE, CHAINV, STITCH, _pairs
from .queries_rasters import nearest_sql
from .queries_sources import _collections, _features
from .queries_spatial import LOCATE, STN, _votes_sql
from .registry import query

# ------------------------------------------------------------------ trails of days
DAY_KEY = "strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d')"
BUDGET = 6600  # bytes of a stored day
TRAILS = f"""with {clean_sql('haversine')}, kp as (select * from f where kept and entity_id in (select entity_id from f where kept group by entity_id having count(*) >= 2)),
 tr as (select *, {DAY_KEY} as date_key, row_number() over (partition by entity_id, {DAY_KEY} order by t, ping_id) as seq from kp),
 {dp_sql('tr', ['date_key', 'entity_id'], '0.01e0')},
 z as (select date_key, imp, t, length(cast(round(lat, 6) as varchar) || ',' || cast(round(lon, 6) as varchar) || ',' || cast(t as varchar)) + 3 as b from dk join tr using (date_key, entity_id, seq)),
 p as (select date_key, k, cast(sum(b) as bigint) as bytes, count(*) as points, cast(sum(t) as bigint) as sum_t from z join (values (0, 0.01e0), (1, 0.02e0), (2, 0.04e0), (3, 0.08e0)) q(k, tol) on imp > tol group by date_key, k),
 best as (select * from p qualify row_number() over (partition by date_key order by case when bytes <= {BUDGET} then k else 100 - k end) = 1)"""


def _raw_trails(t):
    """The feed as it arrives: pieces of up to 64 consecutive positions as text."""
    spot = F.struct("ping_id", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("t").cast("string")).alias("s"))
    pieces = t.pings.groupBy("entity_id", F.floor(F.col("ping_id") / 64).alias("piece")).agg(F.sort_array(F.collect_list(spot)).alias("_p"))
    return pieces.select("entity_id", "piece", F.array_join("_p.s", ";").alias("trail"))


@query("bake_day_trails", f"{TRAILS} select date_key, k, bytes, points, sum_t, case when date_key <= '2024-01-10' then 1 else 2 end as pass_no from best")
def _(t):
    """Trail texts to positions, anomalies dropped, every day simplified to its budget,
    days stored once: a second bake of all days leaves those of the first alone."""
    rows = readers.explode_trail(_raw_trails(t), "trail")
    pings = rows.select("entity_id", (F.col("piece") * 64 + F.col("seq")).alias("ping_id"), "t", "lon", "lat")
    clean = cut(windows.drop_speed_anomalies(pings).withColumn("date_key", G.date_key("t")))
    kept, report = geometry.simplify_to_budget(row_number(clean, ["entity_id", "date_key"], ["t", "ping_id"], "seq"), BUDGET, "date_key", "entity_id", TOLS)
    kept = cut(kept.select("entity_id", "seq", "t", "lon", "lat", "date_key"))
    path = scratch_path(t.spark, "trails")
    sinks.bake_days(kept.where("date_key <= '2024-01-10'").withColumn("pass_no", F.lit(1)), "date_key", path)
    sinks.bake_days(kept.withColumn("pass_no", F.lit(2)), "date_key", path)
    back = t.spark.read.schema("entity_id long, seq long, t long, lon double, lat double, pass_no int, date_key string").parquet(path)
    stored = back.groupBy("date_key").agg(F.count("*").alias("points"), F.sum("t").alias("sum_t"), F.max("pass_no").alias("pass_no"))
    return stored.join(report.select("date_key", "k", "bytes"), "date_key").select("date_key", "k", "bytes", "points", "sum_t", "pass_no")


# ---------------------------------------------------------------------- timetable
SURVEYS = """prim as (select 'S' || cast(part_id * 20 + seq as varchar(20)) as station, lon + 2e-3 as lon, lat + 1e-3 as lat from vertices where elev >= 30e0),
 secd as (select 'S' || cast(part_id * 20 + seq as varchar(20)) as station, lon - 1e-3 as lon, lat - 2e-3 as lat from vertices where elev >= 10e0),
 st as (select station, lon, lat from prim union all select station, lon, lat from secd where station not in (select station from prim))"""
NETWORK = LOCATE.replace(STN, SURVEYS, 1) + ", " + LEGS.replace("track_stations", "lo")


def _network(t):
    """Stations of two surveys, placed on the parts they lie near."""
    station = F.expr("'S' || cast(part_id * 20 + seq as string)").alias("station")
    first = t.vertices.where("elev >= 30").select(station, (F.col("lon") + 2e-3).alias("lon"), (F.col("lat") + 1e-3).alias("lat"))
    second = t.vertices.where("elev >= 10").select(station, (F.col("lon") - 1e-3).alias("lon"), (F.col("lat") - 2e-3).alias("lat"))
    return spatial.build_tracks(cut(joins.gap_fill(first, second, "station")), t.vertices)


@query("bake_timetable_legs", f"{NETWORK} select trip_id, seq, part_id, round(rf, 4) as ratio_from, round(rt, 4) as ratio_to from rl")
def _(t):
    """Every leg of the timetable on the network built from the surveys."""
    legs = fleet.resolve_legs(t.stops, _network(t))
    return legs.select("trip_id", "seq", "part_id", F.round("ratio_from", 4).alias("ratio_from"), F.round("ratio_to", 4).alias("ratio_to"))


@query("bake_timetable_report", f"{NETWORK}, mt as (select trip_id, part_id >= 0 as ok from rl), {ALL_TRIPS} select {REPORT}, {_dropped('lo')} from al")
def _(t):
    tracks = _network(t)
    legs = fleet.resolve_legs(t.stops, tracks).withColumn("matched", F.col("part_id") >= 0)
    return aggs.coverage(legs, t.trips, t.stops, tracks)


# ------------------------------------------------------------------- merged lines
@query(
    "g6_path_vertices",
    f"""with {BRIDGE}, hf as (select p as part_id from pl union all select q from pl), d as (select part_id, case when count(*) >= 3 then count(*) else 1 end as copies from hf group by part_id)
     select part_id, copies, (select count(*) from vertices v where v.part_id = d.part_id) as points, 0 as lost, true as in_order from d where part_id in (select part_id from vertices)""",
)
def _(t):
    """Vertices of the merged lines: no part loses a point on any line it is on, none is
    added, and every part is passed from one end to the other, forward or backward."""
    paths = cut(graph.simple_paths(graph.merge_plan(t.track_stations, _pairs(t))[0]))
    own = t.vertices.select("part_id", "lon", "lat", F.col("seq").alias("_v"))
    run = graph.path_vertices(paths, t.vertices)
    want = paths.select("path_id", "part_id").join(own, "part_id")
    have = run.select("path_id", "lon", "lat").distinct().withColumn("_have", F.lit(True))
    lost = want.join(have, ["path_id", "lon", "lat"], "left").groupBy("path_id", "part_id").agg(F.count("*").alias("points"), F.count_if(F.col("_have").isNull()).alias("lost"))
    # places of a part's vertices on the line against their places on the part: a constant sum or difference
    at = run.join(own, ["part_id", "lon", "lat"], "left")
    same = lambda c: F.min(c) == F.max(c)
    turned = at.groupBy("path_id", "part_id").agg((F.count_if(F.col("_v").isNull()) == 0).alias("_own"), (same(F.col("seq") - F.col("_v")) | same(F.col("seq") + F.col("_v"))).alias("_run"))
    each = lost.join(turned, ["path_id", "part_id"]).groupBy("part_id")
    return each.agg(F.count("*").alias("copies"), F.max("points").alias("points"), F.sum("lost").cast("int").alias("lost"), F.every(F.col("_own") & F.col("_run")).alias("in_order"))


# ------------------------------------------------------------------------- rivers
VOTES = _votes_sql().replace("from vertices where seq % 3 = 0 or seq = 19", "from cvp qualify seq % 3 = 0 or seq = max(seq) over (partition by part_id)")
# chains, the systems they join, their names by vote, and what is kept of them
RIVERS = f"""with {STITCH.replace('eg as', 'eg as materialized')}, {CHAINV},
 ew as (select a.node as a, b.node as b from cd a join cd b on a.chain_id = b.chain_id and a.which = 0 and b.which = 1
   union all select c.node, s.node from nr join cd c using (chain_id, which) join cd s on s.chain_id = near_chain and s.which = 0),
 y2 as (select node, node as lab from cd union select e.b, y2.lab from y2 join (select a, b from ew union all select b, a from ew) e on e.a = y2.node),
 y3 as (select node, min(lab) as component from y2 group by node), ys as (select chain_id, component from cd join y3 using (node) where which = 0),
 cvp as materialized (select chain_id as part_id, seq, lon, lat from cv),
 yl as (select part_id as chain_id, sum({hav_sql('lon0', 'lat0', 'lon', 'lat')}) as m from (select part_id, lag(lon) over w as lon0, lag(lat) over w as lat0, lon, lat from cvp window w as (partition by part_id order by seq)) q where lon0 is not null group by part_id),
 yt as (select component, sum(m) as total from ys join yl using (chain_id) group by component),
 yv as materialized ({VOTES}),
 yk as (select chain_id as part_id, component, name, kind from ys join yt using (component) join yv on yv.part_id = chain_id where total >= 12e3 or kind <> 6),
 kv as (select part_id, seq, lon, lat from cvp where part_id in (select part_id from yk)),
 {dp_sql('kv', ['part_id'], '2e-4::double')}, kd as (select part_id, seq, lon, lat from dk join kv using (part_id, seq)), {nearest_sql('kd', 'part_id, seq')}"""


def _part_features(t):
    spots = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"]))
    return _features(t.vertices.groupBy("part_id").agg(spots.alias("_g")), F.col("_g"), "LineString", [F.col("part_id").alias("part")])


@query("bake_rivers", f"{RIVERS} select part_id as chain_id, component, name, kind, seq, elev, level from sampled join yk using (part_id)")
def _(t):
    """Line features from collections to a stored layer: parts are stitched, loose ends
    snapped into systems, chains named by the zones their vertices lie in, long systems
    and named chains kept, simplified and given heights."""
    raw = readers.read_geojson(t.spark, _collections(t, _part_features(t), "rivers"), "LineString", ["part"])
    parts = cut(raw.select(F.col("part").cast("long").alias("part_id"), F.col("seq").cast("long").alias("seq"), "lon", "lat"))
    chains = cut(graph.stitch(parts).select(F.col("chain_id").alias("part_id"), "seq", "lon", "lat"))
    systems = graph.snap_dangling(parts, tol_m=2900.0, cell=0.03)[1]
    totals = aggs.component_totals(windows.line_length(chains).join(systems.withColumnRenamed("chain_id", "part_id"), "part_id"), "component", "length_m")
    samples = windows.sample_vertices(chains, 3, 40).select((F.col("part_id") * 1000 + F.col("seq")).alias("sample_id"), "part_id", "lon", "lat")
    zones = t.zones.where("kind not in (1, 2)")
    named = spatial.tag_by_vote(samples, zones.select("zone_id", "seq", "lon", "lat"), zones.select("zone_id", "kind", "name").distinct(), "part_id", 0.00025, 0.05, 0.1)
    every = systems.withColumnRenamed("chain_id", "part_id").join(totals, "component").join(named.select("part_id", "name", "kind"), "part_id")
    kept = cut(attrs.keep_rule(every, "total >= 12e3", "kind <> 6").select("part_id", "component", "name", "kind"))
    slim = geometry.simplify(chains.join(kept.select("part_id"), "part_id"), 2e-4)
    layer = sampling.sample_nearest(slim, t.dem, (5, 4)).join(kept, "part_id")
    path = scratch_path(t.spark, "rivers")
    sinks.write_layer(layer, path, {"vertices": F.count("*"), "chains": F.count_distinct("part_id")})
    return sinks.read_layer(t.spark, path)[0].select(F.col("part_id").alias("chain_id"), "component", "name", "kind", "seq", "elev", "level")
