"""Queries over spatial joins, selections and tiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import functions as G
from ..operators import raster, spatial, tiling, windows
from .queries_functions import ANCHOR, TILE, TM2, hav_sql
from .queries_lines import ARC
from .registry import query

EDGES = "zed as (select zone_id, lon as xi, lat as yi, lead(lon) over w as xj, lead(lat) over w as yj from zones window w as (partition by zone_id order by seq))"
INSIDE = "(yi > p.lat) <> (yj > p.lat) and p.lon < (xj - xi) * (p.lat - yi) / (yj - yi) + xi"
SEG_D = "sqrt(pow(p.lon - (xi + tt * (xj - xi)), 2) + pow(p.lat - (yi + tt * (yj - yi)), 2))"
SEG_T = "case when pow(xj-xi,2)+pow(yj-yi,2) = 0 then 0e0 else least(greatest(((p.lon-xi)*(xj-xi)+(p.lat-yi)*(yj-yi)) / ((xj-xi)*(xj-xi)+(yj-yi)*(yj-yi)), 0e0), 1e0) end"


@query("j4_points_in_polygons", f"with {EDGES} select feature_id, zone_id from points p join zed on yj is not null and {INSIDE} group by feature_id, zone_id having count(*) % 2 = 1")
def _(t):
    return spatial.points_in_polygons(t.points, t.zones, "feature_id", "zone_id", 0.25)


@query(
    "j4_points_in_rings",
    f"""with e as (select feature_id as ring, ring_id, lon as xi, lat as yi, lead(lon) over w as xj, lead(lat) over w as yj from rings window w as (partition by feature_id, ring_id order by seq))
     select p.feature_id, ring, ring_id from points p join e on yj is not null and {INSIDE} group by all having count(*) % 2 = 1""",
)
def _(t):
    r = t.rings.withColumnRenamed("feature_id", "ring")
    return spatial.points_in_polygons(t.points, r, "feature_id", ["ring", "ring_id"], 0.05)


VERTS = "sm as (select part_id * 1000 + seq as sample_id, part_id, lon, lat from vertices where seq % 3 = 0 or seq = 19)"


def _votes_sql():
    def near(src, tol, as_):
        return f"""{as_}_n as (select distinct sample_id, part_id, zone_id from (
           select p.sample_id, p.part_id, zone_id from {src} p join zsel on yj is not null and {INSIDE} group by all having count(*) % 2 = 1
           union all select p.sample_id, p.part_id, zone_id from {src} p join zsel on yj is not null cross join lateral (select {SEG_T} as tt) q where {SEG_D} <= {tol})),
         {as_} as (select part_id, kind, name, count(*) as votes from {as_}_n join att using (zone_id) group by part_id, kind, name qualify row_number() over (partition by part_id order by count(*) desc, kind, name) = 1)"""

    return f"""with {EDGES}, {VERTS}, att as (select distinct zone_id, kind, name from zones where kind not in (1, 2)),
     zsel as (select * from zed where zone_id in (select zone_id from att)), {near('sm', '0.00025e0', 'v1')},
     orph as (select * from sm where part_id not in (select part_id from v1)), {near('orph', '0.05e0', 'v2')},
     u as (select *, 1 as pass_no from v1 union all select *, 2 from v2)
     select part_id, name, coalesce(kind, 6) as kind, coalesce(votes, 0) as votes, cast(coalesce(pass_no, 0) as integer) as pass_no from (select distinct part_id from sm) left join u using (part_id)"""


@query("j5_tag_by_vote", _votes_sql())
def _(t):
    s = windows.sample_vertices(t.vertices, 3, 40).select((F.col("part_id") * 1000 + F.col("seq")).alias("sample_id"), "part_id", "lon", "lat")
    z = t.zones.where("kind not in (1, 2)")
    attrs = z.select("zone_id", "kind", "name").distinct()
    v = spatial.tag_by_vote(s, z.select("zone_id", "seq", "lon", "lat"), attrs, "part_id", 0.00025, 0.05, 0.1)
    return v.select("part_id", "name", "kind", "votes", "pass_no")


@query(
    "j6_nearest_within",
    f"""with ends as (select part_id, seq, lon, lat from vertices qualify seq = 0 or seq = max(seq) over (partition by part_id)),
     d as (select l.part_id, l.seq, r.part_id as near_chain, r.seq as near_seq, {hav_sql('l.lon', 'l.lat', 'r.lon', 'r.lat')} as d
       from ends l join vertices r on r.part_id <> l.part_id and abs(cast(trunc(r.lon / 0.003e0) as bigint) - cast(trunc(l.lon / 0.003e0) as bigint)) <= 1 and abs(cast(trunc(r.lat / 0.003e0) as bigint) - cast(trunc(l.lat / 0.003e0) as bigint)) <= 1)
     select part_id * 1000000 + seq as end_id, near_chain, near_seq, round(d, 3) as dist_m from d where d < 200 qualify row_number() over (partition by part_id, seq order by d, near_chain, near_seq) = 1""",
)
def _(t):
    v = t.vertices.withColumn("chain", F.col("part_id"))
    last = v.groupBy("part_id").agg(F.max("seq").alias("_last"))
    left = v.join(last, "part_id").where("seq = 0 or seq = _last").withColumn("end_id", F.expr("part_id * 1000000 + seq")).drop("_last")
    n = spatial.nearest_within(left, v, 200.0, cell=0.003)
    return n.select("end_id", "near_chain", "near_seq", F.round("dist_m", 3).alias("dist_m"))


STN = "st as (select feature_id as station, lon, lat from sites union all select part_id * 100 + seq + 1000000 as station, lon + 2e-3 as lon, lat + 1e-3 as lat from vertices)"
# projected metres of the stations, then of the vertices (names suffixed)
_TM_STATIONS = TM2[5:].format(id="station", src="st")
for _name in ("k", "c", "p", "q", "tm"):
    _TM_STATIONS = re.sub(rf"\b{_name} as \(", f"{_name}2 as (", _TM_STATIONS)
    _TM_STATIONS = re.sub(rf"from {_name}\)", f"from {_name}2)", _TM_STATIONS)
_TM_STATIONS = _TM_STATIONS.replace("c.* from st cross join c)", "c2.* from st cross join c2)")
LOCATE = (
    ARC.replace("with k as", f"with {STN}, k as", 1).replace(" st as (select *, coalesce", " stp as (select *, coalesce").replace("from st) st)", "from stp) s0)")
    + ", " + _TM_STATIONS
    + """, ln as (select part_id, seq, x, y, cum_m, length_m from arc join tm using (part_id, seq)),
 sg as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(cum_m) over w as c1 from ln window w as (partition by part_id order by seq)),
 dd as (select station, part_id, seq, length_m, cum_m + tt * (c1 - cum_m) as arc, sqrt(pow(s.x - (g.x + tt * (g.x1 - g.x)), 2) + pow(s.y - (g.y + tt * (g.y1 - g.y)), 2)) as d
   from tm2 s join sg g on g.x1 is not null cross join lateral (select case when pow(g.x1-g.x,2)+pow(g.y1-g.y,2) = 0 then 0e0 else least(greatest(((s.x-g.x)*(g.x1-g.x)+(s.y-g.y)*(g.y1-g.y)) / (pow(g.x1-g.x,2)+pow(g.y1-g.y,2)), 0e0), 1e0) end as tt) q),
 lo as (select station, part_id, d as dist_m, arc / length_m as ratio, length_m from dd where d < 800 qualify row_number() over (partition by station, part_id order by d, seq) = 1)"""
)


@query("j7_locate_on_lines", LOCATE + " select station, part_id, round(dist_m, 3) as dist_m, round(ratio, 6) as ratio from lo")
def _(t):
    l = spatial.locate_on_lines(_stations(t), t.vertices, 800.0)
    return l.select("station", "part_id", F.round("dist_m", 3).alias("dist_m"), F.round("ratio", 6).alias("ratio"))


@query("j8_build_tracks", LOCATE + " select part_id, station, round(ratio, 4) as ratio, round(dist_m, 1) as dist_m, round(length_m, 1) as length_m from lo")
def _(t):
    return spatial.build_tracks(_stations(t), t.vertices)


def _stations(t):
    side = t.vertices.selectExpr("part_id * 100 + seq + 1000000 as station", "lon + 2e-3 as lon", "lat + 1e-3 as lat")
    return t.sites.selectExpr("feature_id as station", "lon", "lat").union(side)


@query(
    "j20_gather_near",
    """with d as (select s.feature_id as center_id, p.feature_id as point_id, pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2) as d2 from sites s join points p on abs(p.lon - s.lon) <= 0.3e0 and abs(p.lat - s.lat) <= 0.3e0)
     select center_id, point_id, cast(row_number() over (partition by center_id order by d2, point_id) as integer) as rank from d where d2 <= 0.3e0 * 0.3e0
     qualify row_number() over (partition by center_id order by d2, point_id) <= 12""",
)
def _(t):
    c = t.sites.selectExpr("feature_id as center_id", "lon as x", "lat as y")
    p = t.points.selectExpr("feature_id as point_id", "lon as x", "lat as y")
    return spatial.gather_near(c, p, 0.3, 12).select("center_id", "point_id", "rank")


@query(
    "j23_pick",
    f"""with seg as (select part_id, lon as xi, lat as yi, lead(lon) over w as xj, lead(lat) over w as yj from vertices window w as (partition by part_id order by seq)),
     c as (select p.feature_id as query_id, 'sites' as layer, 1 as priority, s.feature_id, sqrt(pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2)) as d from points p join sites s on abs(p.lon - s.lon) <= 0.05e0 and abs(p.lat - s.lat) <= 0.05e0
       union all select p.feature_id, 'lines', 2, part_id, {SEG_D} from points p join seg on xj is not null cross join lateral (select {SEG_T} as tt) q)
     select query_id, layer, feature_id, round(d, 6) as dist from c where d <= 0.05e0 qualify row_number() over (partition by query_id order by priority desc, d, feature_id) = 1""",
)
def _(t):
    pts = t.sites.selectExpr("'sites' as layer", "1 as priority", "feature_id", "lon as x", "lat as y")
    segs = windows.to_segments(t.vertices).selectExpr("'lines' as layer", "2 as priority", "part_id as feature_id", "lon0 as x0", "lat0 as y0", "lon1 as x1", "lat1 as y1")
    q = t.points.selectExpr("feature_id as query_id", "lon as x", "lat as y")
    return spatial.pick(pts, segs, q, 0.05).select("query_id", "layer", "feature_id", F.round("dist", 6).alias("dist"))


@query("j24_assign_tiles", f"select feature_id, {TILE.format(n='2048e0')} from points")
def _(t):
    return spatial.assign_tiles(t.points, 11).select("feature_id", "tx", "ty")


SEG_TILES = """ext as (select part_id, seq, lon as lon0, lat as lat0, lead(lon) over w as lon1, lead(lat) over w as lat1, name, system from vertices window w as (partition by part_id order by seq)),
 bx as (select *, cast(floor((least(lon0, lon1) + 180e0) / 360e0 * {n}) as bigint) as ax, cast(floor((greatest(lon0, lon1) + 180e0) / 360e0 * {n}) as bigint) as bx,
   cast(floor((1e0 - ln(tan(radians(greatest(lat0, lat1))) + 1e0 / cos(radians(greatest(lat0, lat1)))) / pi()) / 2e0 * {n}) as bigint) as ay,
   cast(floor((1e0 - ln(tan(radians(least(lat0, lat1))) + 1e0 / cos(radians(least(lat0, lat1)))) / pi()) / 2e0 * {n}) as bigint) as byy from ext where lon1 is not null),
 ux as (select *, unnest(range(ax, bx + 1)) as tx from bx), tl as (select *, unnest(range(ay, byy + 1)) as ty from ux)"""


@query("j24_assign_segment_tiles", f"with {SEG_TILES.format(n='65536e0')} select part_id, seq, tx, ty from tl")
def _(t):
    return spatial.assign_tiles(windows.to_segments(t.vertices), 16, "segment").select("part_id", "seq", "tx", "ty")


@query(
    "j24_assign_polygon_tiles",
    """with b as (select feature_id, cast(floor((min(lon) + 180e0) / 360e0 * 4096e0) as bigint) as ax, cast(floor((max(lon) + 180e0) / 360e0 * 4096e0) as bigint) as bx,
      cast(floor((1e0 - ln(tan(radians(max(lat))) + 1e0 / cos(radians(max(lat)))) / pi()) / 2e0 * 4096e0) as bigint) as ay,
      cast(floor((1e0 - ln(tan(radians(min(lat))) + 1e0 / cos(radians(min(lat)))) / pi()) / 2e0 * 4096e0) as bigint) as byy from rings where ring_id = 0 group by feature_id),
      x as (select *, unnest(range(ax, bx + 1)) as tx from b) select feature_id, tx, unnest(range(ay, byy + 1)) as ty from x""",
)
def _(t):
    b = t.rings.where("ring_id = 0").groupBy("feature_id").agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat")
    )
    return spatial.assign_tiles(b, 12, "box").select("feature_id", "tx", "ty")


@query("u5_tile_neighbourhood", f"""with t as (select distinct {TILE.format(n='4096e0')} from points), o as (select * from range(-1, 2) a(i) cross join range(-1, 2) b(j)) select distinct tx + i as tx, ty + j as ty from t cross join o""")
def _(t):
    return spatial.tile_neighbourhood(t.points, 12)


# one running list of picks per group, in descending height
PEAKS = """cn as (select feature_id as center_id, lon as cx, lat as cy from sites),
 pk as (select center_id, feature_id as point_id, lon as x, lat as y, val as elev, row_number() over (partition by center_id order by val desc, feature_id) as rn
   from cn join points on pow(lon - cx, 2) + pow(lat - cy, 2) <= 0.5e0 * 0.5e0 where val >= 1e3),
 f as (select center_id, rn, point_id, elev, true as ok, [{'x': x, 'y': y}] as got from pk where rn = 1
  union all select p.center_id, p.rn, p.point_id, p.elev, len(list_filter(f.got, lambda g: pow(g.x - p.x, 2) + pow(g.y - p.y, 2) < 0.2e0 * 0.2e0)) = 0,
   case when len(list_filter(f.got, lambda g: pow(g.x - p.x, 2) + pow(g.y - p.y, 2) < 0.2e0 * 0.2e0)) = 0 then list_append(f.got, {'x': p.x, 'y': p.y}) else f.got end
  from f join pk p on p.center_id = f.center_id and p.rn = f.rn + 1)"""


@query("t2_select_peaks", f"with {PEAKS} select center_id, point_id, elev from f where ok qualify row_number() over (partition by center_id order by elev desc, point_id) <= 5")
def _(t):
    c = t.sites.selectExpr("feature_id as center_id", "lon as x", "lat as y")
    p = t.points.selectExpr("feature_id as point_id", "lon as x", "lat as y", "val as elev")
    return spatial.select_peaks(p, c, 0.5, 0.2, 5, 1000.0).select("center_id", "point_id", F.col("score").alias("elev"))


@query(
    "t4_local_extrema",
    """with b as (select c.gx, c.gy, c.v, bool_and(c.v > n.v) as hi, bool_and(c.v < n.v) as lo from cells c join cells n on n.gx between c.gx - 1 and c.gx + 1 and n.gy between c.gy - 1 and c.gy + 1 and (n.gx <> c.gx or n.gy <> c.gy) group by all),
     pk as (select gy // 64 as band, gx, gy, v, row_number() over (partition by gy // 64 order by v desc, gy * 1000 + gx) as rn from b where hi),
     f as (select band, rn, gx, gy, v, true as ok, [{'x': gx, 'y': gy}] as got from pk where rn = 1
      union all select p.band, p.rn, p.gx, p.gy, p.v, len(list_filter(f.got, lambda g: pow(g.x - p.gx, 2) + pow(g.y - p.gy, 2) < 36)) = 0,
       case when len(list_filter(f.got, lambda g: pow(g.x - p.gx, 2) + pow(g.y - p.gy, 2) < 36)) = 0 then list_append(f.got, {'x': p.gx, 'y': p.gy}) else f.got end
      from f join pk p on p.band = f.band and p.rn = f.rn + 1)
     select * from (select band, gx, gy, v, 'PEAK' as kind from f where ok qualify row_number() over (partition by band order by v desc, gy * 1000 + gx) <= 4)
     union all select * from (select gy // 64 as band, gx, gy, v, 'BASIN' from b where lo qualify row_number() over (partition by gy // 64 order by v, gy, gx) = 1)""",
)
def _(t):
    hi = raster.local_extrema(t.cells).select(
        F.floor(F.col("gy") / 64).alias("band"), (F.col("gy") * 1000 + F.col("gx")).alias("id"), F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), "v"
    )
    peaks = spatial.spread_pick(hi, "band", "id", F.col("v"), 6.0, 4).select(
        "band", F.col("x").cast("long").alias("gx"), F.col("y").cast("long").alias("gy"), F.col("score").alias("v"), F.lit("PEAK").alias("kind")
    )
    lo = raster.local_extrema(t.cells, -1).groupBy(F.floor(F.col("gy") / 64).alias("band")).agg(F.min_by(F.struct("gx", "gy", "v"), F.struct("v", "gy", "gx")).alias("b"))
    return peaks.unionByName(lo.select("band", "b.*", F.lit("BASIN").alias("kind")))


Z11 = G.projection(23.7, 121.0, 11)
Z10 = G.projection(23.7, 121.0, 10)


def _world(proj):
    n = 2**proj.zoom
    return f"((lon + 180e0) / 360e0 * {n * 256}e0 - {proj.ox!r}) * {proj.units_per_pixel!r} as x, ((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * {n * 256}e0 - {proj.oy!r}) * {proj.units_per_pixel!r} as z"


def _cover_sql(proj, r, as_):
    import math

    reach = math.ceil(r / proj.tile_size) + 1
    u = f"{proj.units_per_pixel!r}"
    return f"""{as_}_t as (select center_id, x, z, cast(floor(({proj.ox!r} + x / {u}) / 256) as bigint) + i as tx, cast(floor(({proj.oy!r} + z / {u}) / 256) as bigint) + j as ty
      from ce cross join range({-reach}, {reach + 1}) a(i) cross join range({-reach}, {reach + 1}) b(j)),
     {as_} as (select *, pow(((tx + 0.5e0) * 256e0 - {proj.ox!r}) * {u} - x, 2) + pow(((ty + 0.5e0) * 256e0 - {proj.oy!r}) * {u} - z, 2) as d2 from {as_}_t)"""


R = 60.0


def _centers(t, proj):
    x, z = G.lonlat_to_world("lon", "lat", proj)
    return t.sites.select(F.col("feature_id").alias("center_id"), x.alias("x"), z.alias("z"))


@query("l1_disk_cover", f"with ce as (select feature_id as center_id, {_world(Z11)} from sites), {_cover_sql(Z11, R, 'co')} select center_id, tx, ty, round(d2, 4) as d2 from co where d2 <= {R * R}e0")
def _(t):
    return tiling.disk_cover(_centers(t, Z11), R, Z11).select("center_id", "tx", "ty", F.round("d2", 4).alias("d2"))


@query(
    "t3_cap_nearest",
    f"""with ce as (select feature_id as center_id, {_world(Z11)} from sites), {_cover_sql(Z11, R, 'co')}
     select center_id, tx, ty, cast(row_number() over (partition by center_id order by round(d2, 6), tx, ty) as integer) as rank from co where d2 <= {R * R}e0
     qualify row_number() over (partition by center_id order by round(d2, 6), tx, ty) <= 4""",
)
def _(t):
    tiles = tiling.disk_cover(_centers(t, Z11), R, Z11).withColumn("d2", F.round("d2", 6))
    return spatial.cap_nearest(tiles, 4, "center_id", ["d2", "tx", "ty"]).select("center_id", "tx", "ty", "rank")


U11 = f"{Z11.units_per_pixel!r}"
KID = f"pow(((tx * 2 + {{i}} + 0.5e0) * 256e0 - {Z11.ox!r}) * {U11} - x, 2) + pow(((ty * 2 + {{j}} + 0.5e0) * 256e0 - {Z11.oy!r}) * {U11} - z, 2)"
LOD = f"""ce as (select feature_id as center_id, {_world(Z11)} from sites), {_cover_sql(Z10, R, 'co')},
 al as (select *, {' and '.join(f'({KID.format(i=i, j=j)}) <= {(R * 0.55) ** 2!r}' for i in (0, 1) for j in (0, 1))} as inn from co where d2 <= {R * R}e0),
 lod as (select center_id, 10 as zoom, tx, ty from al where not inn union all select center_id, 11, tx * 2 + i, ty * 2 + j from al cross join range(2) a(i) cross join range(2) b(j) where inn)"""


@query("l2_lod_partition", f"with {LOD} select center_id, zoom, tx, ty from lod")
def _(t):
    return tiling.lod_partition(_centers(t, Z11), R, Z11).select("center_id", "zoom", "tx", "ty")


@query(
    "l3_covered",
    f"""with {LOD}, want as (select distinct zoom, tx, ty from lod), seen as (select 10 as zoom, {TILE.format(n='1024e0')} from points union all select 11, {TILE.format(n='2048e0')} from points),
     live as (select * from want where (zoom, tx, ty) in (select (zoom, tx, ty) from seen)),
     st as (select distinct 9 as zoom, tx // 2 as tx, ty // 2 as ty from co where d2 <= {R * R}e0 union select distinct 12, tx * 4, ty * 4 from co where d2 <= {R * R}e0),
     ft as (select zoom, tx, ty, unnest(case when zoom = 9 then [tx * 2, tx * 2 + 1] else [tx // 4] end) as fx, case when zoom = 9 then [ty * 2, ty * 2 + 1] else [ty // 4] end as ys from st),
     fo as (select zoom, tx, ty, fx, unnest(ys) as fy from ft), mi as (select * from want except select * from live),
     bad as (select tx as fx, ty as fy from mi where zoom = 10 union select tx // 2, ty // 2 from mi where zoom = 11 and (tx // 2, ty // 2) not in (select (tx, ty) from want where zoom = 10))
     select zoom, tx, ty, (zoom, tx, ty) not in (select (zoom, tx, ty) from fo join bad using (fx, fy)) as covered from st""",
)
def _(t):
    c = _centers(t, Z11)
    want = tiling.lod_partition(c, R, Z11).select("zoom", "tx", "ty").distinct()
    # tiles holding a point are live
    seen = [spatial.assign_tiles(t.points, z).select(F.lit(z).alias("zoom"), "tx", "ty") for z in (10, 11)]
    live = want.join(seen[0].union(seen[1]), ["zoom", "tx", "ty"], "left_semi")
    outer = tiling.disk_cover(c, R, Z10).select("tx", "ty")
    stale = outer.selectExpr("9 as zoom", "cast(floor(tx / 2) as bigint) as tx", "cast(floor(ty / 2) as bigint) as ty").union(outer.selectExpr("12 as zoom", "tx * 4 as tx", "ty * 4 as ty")).distinct()
    return tiling.covered(stale, want, live, 11, 10)


SYS_CLASS = {i: "major" for i in range(5)} | {i: "mid" for i in range(5, 12)}


@query("l4_tile_features", f"""with {SEG_TILES.format(n='8192e0')}, fi as (select tx, ty, part_id, row_number() over (partition by tx, ty order by part_id) - 1 as feature_index from (select distinct tx, ty, part_id from tl))
 select tx, ty, part_id, seq, case when system < 5 then 'major' when system < 12 then 'mid' else 'minor' end as bucket, feature_index from tl join fi using (tx, ty, part_id)""")
def _(t):
    f = tiling.tile_features(t.vertices, 13, "system", SYS_CLASS, "minor")
    return f.select("tx", "ty", "part_id", "seq", "bucket", "feature_index")


@query("l4_signed_ids", f"""with hv as (select * exclude (part_id), part_id * 184467440737 - 9223372036854 as part_id from vertices), {SEG_TILES.format(n='8192e0').replace('vertices', 'hv')}, fi as (select tx, ty, part_id, row_number() over (partition by tx, ty order by part_id) - 1 as feature_index from (select distinct tx, ty, part_id from tl))
 select tx, ty, part_id, seq, feature_index from tl join fi using (tx, ty, part_id)""")
def _(t):
    """Sparse ids on both sides of zero, as a reader's hashes are."""
    v = t.vertices.withColumn("part_id", F.expr("part_id * 184467440737 - 9223372036854"))
    return tiling.tile_features(v, 13, "system", SYS_CLASS, "minor").select("tx", "ty", "part_id", "seq", "feature_index")


@query("l5_tile_to_world", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(((1700 + l_suppkey + 0.5e0) * 256e0 - {Z11.ox!r}) * {U11} + (l_partkey % 4096 - 2048e0) * {Z11.tile_size / 4096!r}, 5) as wx,
 round(((880 + l_linenumber + 0.5e0) * 256e0 - {Z11.oy!r}) * {U11} + (l_orderkey % 4096 - 2048e0) * {Z11.tile_size / 4096!r}, 5) as wz from lineitem""")
def _(t):
    d = t.lineitem.selectExpr("*", "1700 + l_suppkey as tx", "880 + l_linenumber as ty", "l_partkey % 4096 as x", "l_orderkey % 4096 as y")
    w = tiling.tile_to_world(d, Z11)
    return w.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("wx", 5).alias("wx"), F.round("wz", 5).alias("wz"))
