"""Queries over rasters and raster sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import raster, sampling
from .queries_functions import GX, GY
from .registry import query

G5 = f"{GX.format(s=32 * 256)} as x5, {GY.format(s=32 * 256)} as y5, {GX.format(s=16 * 256)} as x4, {GY.format(s=16 * 256)} as y4"


def nearest_sql(src, keys, as_="sampled"):
    return f"""{as_}_k as (select {keys}, {G5} from {src}),
 {as_} as (select {keys}, cast(round_even(case when v < -100e0 then 0e0 else v end, 0) as bigint) as elev, level from (
   select {keys}, coalesce(a.v, b.v, 0e0) as v, case when a.v is not null then 'z5' when b.v is not null then 'z4' else 'sea' end as level
   from {as_}_k left join dem a on a.z = 5 and a.gx = cast(floor(x5) as bigint) and a.gy = cast(floor(y5) as bigint)
   left join dem b on b.z = 4 and b.gx = cast(floor(x4) as bigint) and b.gy = cast(floor(y4) as bigint)) q)"""


@query("j1_sample_nearest", f"with {nearest_sql('points', 'feature_id')} select feature_id, elev, level from sampled")
def _(t):
    return sampling.sample_nearest(t.points, t.dem, (5, 4)).select("feature_id", "elev", "level")


@query("j1_hit_levels", f"with {nearest_sql('points', 'feature_id')} select level, count(*) as n from sampled group by level")
def _(t):
    return sampling.hit_levels(sampling.sample_nearest(t.points, t.dem, (5, 4)))


def bilinear_sql(src, keys, x, y, cells, as_="bl", v="v"):
    return f"""{as_}_p as (select {keys}, {x} - 0.5e0 as sx, {y} - 0.5e0 as sy from {src}),
 {as_}_q as (select *, cast(floor(sx) as bigint) as x0, cast(floor(sy) as bigint) as y0 from {as_}_p),
 {as_}_t as (select *, x0 + i as tx, y0 + j as ty, (case when i = 1 then sx - x0 else 1e0 - (sx - x0) end) * (case when j = 1 then sy - y0 else 1e0 - (sy - y0) end) as w
   from {as_}_q cross join (values (0, 0), (1, 0), (0, 1), (1, 1)) k(i, j)),
 {as_} as (select {keys}, sum(w * coalesce({v}, 0e0)) as v from {as_}_t left join {cells} c on c.gx = tx and c.gy = ty group by {keys})"""


D4 = "(select * from dem where z = 4)"


@query("j2_sample_bilinear", f"with {bilinear_sql('points', 'feature_id', GX.format(s=4096), GY.format(s=4096), D4)} select feature_id, round(v, 5) as elev from bl")
def _(t):
    s = sampling.sample_bilinear(t.points, t.dem, 4, "feature_id")
    return s.select("feature_id", F.round("v", 5).alias("elev"))


def parent_sql(align):
    # tiles of 8 x 8 cells
    if align == "corner":
        ax = "(tx % 2) * 4 + ix / 2e0"
        ay = "(ty % 2) * 4 + iy / 2e0"
        cx = "px * 8 + least(cast(floor(ax) as bigint) + i, 7)"
        cy = "py * 8 + least(cast(floor(ay) as bigint) + j, 7)"
    else:
        ax, ay = "(ix + 0.5e0) / 2e0 - 0.5e0", "(iy + 0.5e0) / 2e0 - 0.5e0"
        cx = "px * 8 + (tx % 2) * 4 + greatest(0, least(cast(floor(ax) as bigint) + i, 3))"
        cy = "py * 8 + (ty % 2) * 4 + greatest(0, least(cast(floor(ay) as bigint) + j, 3))"
    return f"""with have as (select distinct gx // 8 as tx, gy // 8 as ty from dem where z = 5),
     par as (select distinct gx // 8 as px, gy // 8 as py from dem where z = 4),
     want as (select px * 2 + a.a as tx, py * 2 + b.b as ty, px, py from par cross join range(2) a(a) cross join range(2) b(b)),
     mis as (select w.* from want w left join have h using (tx, ty) where h.tx is null),
     pix as (select *, {ax} as ax, {ay} as ay from mis cross join range(8) x(ix) cross join range(8) y(iy)),
     tap as (select *, {cx} as cx, {cy} as cy, (case when i = 1 then ax - floor(ax) else 1e0 - (ax - floor(ax)) end) * (case when j = 1 then ay - floor(ay) else 1e0 - (ay - floor(ay)) end) as w
       from pix cross join (values (0, 0), (1, 0), (0, 1), (1, 1)) k(i, j))
     select tx * 8 + ix as gx, ty * 8 + iy as gy, round(sum(w * v), 5) as v from tap join (select gx as cx, gy as cy, v from dem where z = 4) d using (cx, cy) group by 1, 2"""


def _parent(t, align):
    fine, coarse = t.dem.where("z = 5"), t.dem.where("z = 4")
    kids = F.explode(F.array(F.lit(0), F.lit(1)))
    par = coarse.select(F.floor(F.col("gx") / 8).alias("px"), F.floor(F.col("gy") / 8).alias("py")).distinct()
    want = par.select("*", kids.alias("a")).select("*", kids.alias("b")).select((F.col("px") * 2 + F.col("a")).alias("tx"), (F.col("py") * 2 + F.col("b")).alias("ty"))
    return sampling.fill_from_parent(want, fine, coarse, 8, align).select("gx", "gy", F.round("v", 5).alias("v"))


@query("j3_fill_from_parent_corner", parent_sql("corner"))
def _(t):
    return _parent(t, "corner")


@query("j3_fill_from_parent_center", parent_sql("center"))
def _(t):
    return _parent(t, "center")


@query(
    "s5_scan_tiles",
    """with g as (select x.gx, y.gy from range(6800, 6848) x(gx) cross join range(3488, 3536) y(gy))
     select gx, gy, coalesce(v, 0e0) as v from g left join (select * from dem where z = 5) d using (gx, gy)""",
)
def _(t):
    # tiles of 16 pixels: re-keyed cells of one zoom
    d = t.dem.where("z = 5").selectExpr(
        "10 as z", "cast(floor(gx / 16e0) as bigint) as tx", "cast(floor(gy / 16e0) as bigint) as ty", "gx % 16 as px", "gy % 16 as py", "v"
    )
    from ..sources.readers import scan_tile_range

    return scan_tile_range(d, 10, (425, 427, 218, 220), 16).selectExpr("tx * 16 + px as gx", "ty * 16 + py as gy", "v")


D8_SQL = """d8n as (select c.gx, c.gy, c.v, n.gx as nx, n.gy as ny, (c.v - n.v) / (case when c.gx <> n.gx and c.gy <> n.gy then {m} * sqrt(2e0) else {m} end) as sl,
   (n.gy - c.gy + 1) * 3 + (n.gx - c.gx + 1) as dir
   from {cells} c join {cells} n on n.gx between c.gx - 1 and c.gx + 1 and n.gy between c.gy - 1 and c.gy + 1 and (n.gx <> c.gx or n.gy <> c.gy)),
 d8b as (select gx, gy, arg_max({{'x': nx, 'y': ny}}, (sl, -dir)) as r, max(sl) as sl from d8n group by gx, gy),
 d8 as (select gx, gy, case when sl > 0 then r.x else gx end as rx, case when sl > 0 then r.y else gy end as ry, greatest(sl, 0e0) as slope from d8b)"""


@query("r2_d8", f"with {D8_SQL.format(m='1e0', cells='cells')} select gx, gy, rx, ry, round(slope, 6) as slope from d8")
def _(t):
    return raster.d8(t.cells).select("gx", "gy", "rx", "ry", F.round("slope", 6).alias("slope"))


@query("r5_catchment_area", f"select max(v) * {raster.cell_metres(13, 23.6) ** 2 / 1e6!r} as max_km2, count(*) * {raster.cell_metres(13, 23.6) ** 2 / 1e6!r} as total_km2 from cells")
def _(t):
    c = raster.catchment_km2(t.cells, raster.cell_metres(13, 23.6), "v")
    return c.agg(F.max("area_km2").alias("max_km2"), (F.count("*") * F.lit(raster.cell_metres(13, 23.6) ** 2 / 1e6)).alias("total_km2"))


def blur_sql(src, sigma, out, v="v"):
    w = raster.gaussian_weights(sigma)
    r = len(w) // 2
    vals = ", ".join(f"({k}, {x!r})" for k, x in zip(range(-r, r + 1), w))
    refl = lambda g, n: f"case when (({g}) % (2*{n}) + 2*{n}) % (2*{n}) < {n} then (({g}) % (2*{n}) + 2*{n}) % (2*{n}) else 2*{n} - 1 - (({g}) % (2*{n}) + 2*{n}) % (2*{n}) end"
    return f"""{out}_d as (select max(gx) + 1 as wd, max(gy) + 1 as ht from {src}), {out}_w as (select * from (values {vals}) k(o, wt)),
 {out}_1 as (select c.gx, c.gy, sum(k.wt * n.{v}) as v1 from {src} c cross join {out}_d d cross join {out}_w k join {src} n on n.gx = c.gx and n.gy = {refl('c.gy + k.o', 'd.ht')} group by c.gx, c.gy),
 {out} as (select c.gx, c.gy, sum(k.wt * n.v1) as b from {out}_1 c cross join {out}_d d cross join {out}_w k join {out}_1 n on n.gy = c.gy and n.gx = {refl('c.gx + k.o', 'd.wd')} group by c.gx, c.gy)"""


@query("r9_blur", f"with {blur_sql('cells', 1.5, 'bl')} select gx, gy, round(b, 6) as v from bl")
def _(t):
    return raster.blur(t.cells, 1.5).select("gx", "gy", F.round("v", 6).alias("v"))


SLOPE_SQL = """sl as (select c.gx, c.gy, c.v,
  coalesce((e.v - w.v) / 2e0, e.v - c.v, c.v - w.v, 0e0) / {m} as dx, coalesce((s.v - n.v) / 2e0, s.v - c.v, c.v - n.v, 0e0) / {m} as dy
  from cells c left join cells e on e.gx = c.gx + 1 and e.gy = c.gy left join cells w on w.gx = c.gx - 1 and w.gy = c.gy
  left join cells s on s.gy = c.gy + 1 and s.gx = c.gx left join cells n on n.gy = c.gy - 1 and n.gx = c.gx)"""


@query(
    "r10_adaptive_blur",
    f"""with cv as (select gx, gy, v, (gx * 31 + gy * 17) % 100 / 1e2 as i from cells), {blur_sql('cv', 0.6, 'b1', 'i')}, {blur_sql('cv', 1.8, 'b2', 'i')}, {SLOPE_SQL.format(m='17.5e0')},
     f as (select gx, gy, v, least(greatest((3.5e0 - sqrt(dx*dx+dy*dy)) / 3e0, 0e0), 1e0) as f from sl)
     select gx, gy, case when v <= 0 then 0e0 else round(b1.b * (1e0 - f) + b2.b * f, 6) end as intensity from f join b1 using (gx, gy) join b2 using (gx, gy)""",
)
def _(t):
    c = t.cells.withColumn("intensity", F.expr("(gx * 31 + gy * 17) % 100 / 1e2"))
    return raster.adaptive_blur(c, 17.5, 0.6, 1.8, 0.5, 3.5).select("gx", "gy", F.round("intensity", 6).alias("intensity"))


ERODE_SQL = """er as (select c.gx, c.gy, bool_and(n.valid) as valid from field c join field n on n.gx between c.gx - 1 and c.gx + 1 and n.gy between c.gy - 1 and c.gy + 1 group by c.gx, c.gy)"""


@query("r11_erode", f"with {ERODE_SQL} select gx, gy, valid from er")
def _(t):
    return raster.erode(t.field.select("gx", "gy", "valid"))


@query(
    "r12_sample_uv",
    f"""with {ERODE_SQL}, p as (select feature_id, (lon - 119.1937e0) / (122.1071e0 - 119.1937e0) * 99e0 as px, (25.4083e0 - lat) / (25.4083e0 - 21.7919e0) * 19e0 as py from points),
     ok as (select p.* from p join er on er.gx = cast(floor(px + 0.5e0) as bigint) and er.gy = cast(floor(py + 0.5e0) as bigint) where valid),
     tp as (select feature_id, least(cast(floor(px) as bigint) + i, 99) as tx, least(cast(floor(py) as bigint) + j, 19) as ty,
       (case when i = 1 then px - floor(px) else 1e0 - (px - floor(px)) end) * (case when j = 1 then py - floor(py) else 1e0 - (py - floor(py)) end) as w from ok cross join (values (0,0),(1,0),(0,1),(1,1)) k(i, j)),
     uv as (select feature_id, sum(w * u) as u, sum(w * v) as v from tp join field f on f.gx = tx and f.gy = ty group by feature_id)
     select feature_id, round(u, 9) as u, round(v, 9) as v, round(sqrt(u*u + v*v), 9) as speed from points left join uv using (feature_id)""",
)
def _(t):
    s = sampling.sample_uv(t.points, t.field, (119.1937, 21.7919, 122.1071, 25.4083), 100, 20, "feature_id")
    return s.select("feature_id", *[F.round(c, 9).alias(c) for c in ("u", "v", "speed")])


@query("r12_decode_field", "select p_partkey, round(-2e0 + (p_partkey % 256) / 255e0 * 4e0, 6) as u, round(-1e0 + ((p_partkey * 7) % 256) / 255e0 * 2e0, 6) as v, (p_partkey * 3) % 256 >= 128 as valid from part")
def _(t):
    px = t.part.selectExpr("p_partkey as gx", "0 as gy", "p_partkey % 256 as r", "(p_partkey * 7) % 256 as g", "(p_partkey * 3) % 256 as a")
    d = sampling.decode_field(px, (-2.0, 2.0), (-1.0, 1.0))
    return d.select(F.col("gx").alias("p_partkey"), F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), "valid")


@query(
    "r13_slope",
    f"""with {SLOPE_SQL.format(m='17.5e0')} select gx, gy, round(sqrt(dx*dx+dy*dy), 6) as slope, round(-dx / sqrt(dx*dx+dy*dy+1), 6) as nx, round(1 / sqrt(dx*dx+dy*dy+1), 6) as nz from sl""",
)
def _(t):
    s = raster.slope(t.cells, 17.5)
    return s.select("gx", "gy", *[F.round(c, 6).alias(c) for c in ("slope", "nx", "nz")])


@query("p10_suitable", f"with {SLOPE_SQL.format(m='400e0')} select gx, gy from sl where v > 0.5e0 and v <= 240 and sqrt(dx*dx+dy*dy) <= {math.tan(math.radians(35)) / 3!r}")
def _(t):
    return raster.suitable(t.cells, 0.5, 240.0, math.tan(math.radians(35)) / 3, 400.0).select("gx", "gy")


@query("r14_threshold", "select gx, gy, v > 100 and v <> 150 as m from cells")
def _(t):
    return raster.threshold(t.cells, 100.0, 150.0)


@query("r17_regrid_nearest", "select t.gx, t.gy, coalesce(s.v, 0e0) as v from (select * from dem where z = 5) t left join (select * from dem where z = 4) s on s.gx = cast(floor((t.gx + 0.5e0) * 0.5e0) as bigint) and s.gy = cast(floor((t.gy + 0.5e0) * 0.5e0) as bigint)")
def _(t):
    return sampling.regrid(t.dem.where("z = 5"), t.dem.where("z = 4"), 5, 4)


@query("r17_regrid_bilinear", f"with tg as (select gx as kx, gy as ky from dem where z = 5), {bilinear_sql('tg', 'kx, ky', '(kx + 0.5e0) * 0.5e0', '(ky + 0.5e0) * 0.5e0', D4)} select kx as gx, ky as gy, round(v, 6) as v from bl")
def _(t):
    r = sampling.regrid(t.dem.where("z = 5"), t.dem.where("z = 4"), 5, 4, "bilinear")
    return r.select("gx", "gy", F.round("v", 6).alias("v"))


@query(
    "r18_mosaic",
    """with a as (select gx, gy, v from cells where gx < 70 and v <> 121), b as (select gx, gy, v + 1 as v from cells where gx >= 40 and v > 100 and v + 1 <> 121)
     select gx, gy, coalesce(b.v, a.v) as v from a full join b using (gx, gy)""",
)
def _(t):
    a = t.cells.where("gx < 70")
    b = t.cells.where("gx >= 40 and v > 100").withColumn("v", F.col("v") + 1)
    return raster.mosaic([a, b], nodata=121.0)


@query("r19_edge_fade", """with d as (select max(gx) as mx, max(gy) as my from cells), f as (select gx, gy, v, least(greatest(least(gx, mx - gx, gy, my - gy) / 8e0, 0e0), 1e0) as fade from cells cross join d)
 select gx, gy, fade, v * fade as faded from f""")
def _(t):
    return raster.edge_fade(t.cells, 8).select("gx", "gy", "fade", "faded")


@query("r20_drop_buffer_ring", "with m as (select max(gx) // 5 as tx, max(gy) // 5 as ty from cells) select gx, gy, v from cells cross join m where gx // 5 between 1 and tx - 1 and gy // 5 between 1 and ty - 1")
def _(t):
    return raster.drop_buffer_ring(t.cells, 1, 5)


@query("r20_crop", "select gx, gy, v from cells where gx between 10 and 80 and gy between 2 and 1000000000")
def _(t):
    return raster.crop(t.cells, 10, 2, 80, 1_000_000_000)


def pool_sql(fn):
    return f"""with d as (select max(gx) + 1 as wd, max(gy) + 1 as ht from cells) select gx // 3 as gx, gy // 3 as gy, round({fn}(v), 6) as v from cells cross join d
     where gx // 3 < wd // 3 and gy // 3 < ht // 3 group by 1, 2"""


@query("a8_block_pool_max", pool_sql("max"))
def _(t):
    return raster.block_pool(t.cells, 3).withColumn("v", F.round("v", 6))


@query("a8_block_pool_mean", pool_sql("avg"))
def _(t):
    return raster.block_pool(t.cells, 3, "mean").withColumn("v", F.round("v", 6))


@query(
    "a9_crop_bounds",
    """with b as (select min(gx) as c0, max(gx) as c1, min(gy) as r0, max(gy) as r1 from cells where v > 250)
     select c0, c1, r0, r1, c1 - c0 + 1 as w, r1 - r0 + 1 as h, round((6808 + c0) / 8192e0 * 360e0 - 180e0, 6) as min_lon, round((6809 + c1) / 8192e0 * 360e0 - 180e0, 6) as max_lon,
      round(degrees(atan(sinh(pi() * (1e0 - 2e0 * (3499e0 + r1) / 8192e0)))), 6) as min_lat, round(degrees(atan(sinh(pi() * (1e0 - 2e0 * (3498e0 + r0) / 8192e0)))), 6) as max_lat from b""",
)
def _(t):
    b = raster.crop_bounds(raster.threshold(t.cells, 250.0), 5, ox=6808, oy=3498)
    return b.withColumns({c: F.round(c, 6) for c in ("min_lon", "max_lon", "min_lat", "max_lat")})


@query(
    "a21_base_elev",
    f"""with {bilinear_sql('rings', 'feature_id, ring_id, seq', GX.format(s=4096), GY.format(s=4096), D4)}
     select feature_id, round(min(bl.v), 5) as base_elev, any_value(case when s_acctbal > 0 then s_acctbal else 3e0 end) as height from bl join supplier on feature_id = s_suppkey group by feature_id""",
)
def _(t):
    b = sampling.base_elev(t.rings, t.dem, 4, "feature_id", ["feature_id", "ring_id", "seq"])
    h = t.supplier.select(F.col("s_suppkey").alias("feature_id"), sampling.building_height("s_acctbal", 3.0).alias("height"))
    return b.join(h, "feature_id").withColumn("base_elev", F.round("base_elev", 5))


INSET = """o as (select feature_id, ring_id, seq, lon, lat, avg(lon) over w as cx, avg(lat) over w as cy from rings where seq < 16 window w as (partition by feature_id, ring_id)),
 d as (select *, sqrt(pow(cx - lon, 2) + pow(cy - lat, 2)) as d from o),
 ins as (select feature_id, ring_id, seq, lon + (cx - lon) * f as lon, lat + (cy - lat) * f as lat from (select *, case when d > 0 then (case when ring_id = 1 then -1e0 else 1e0 end) * least(0.01e0, 0.35e0 * d) / d else 0e0 end as f from d) q)"""


@query(
    "e6_surface_elev",
    f"""with {INSET}, {nearest_sql('ins', 'feature_id, ring_id, seq')}
     select a.feature_id, a.ring_id, a.seq, greatest(min(b.elev), -3e0) as water_elev from sampled a join sampled b on a.feature_id = b.feature_id and a.ring_id = b.ring_id
       and ((b.seq - a.seq + 16) % 16 <= 2 or (a.seq - b.seq + 16) % 16 <= 2) group by all""",
)
def _(t):
    o = geo.open_rings(t.rings, ["feature_id", "ring_id"])
    s = sampling.surface_elev(o, t.dem, ["feature_id", "ring_id"], (5, 4), 0.01, outward=F.col("ring_id") == 1)
    return s.select("feature_id", "ring_id", "seq", "water_elev")


@query(
    "e7_basin_levels",
    f"""with rr as (select feature_id, seq, lon, lat from rings where ring_id = 0), {nearest_sql('rr', 'feature_id, seq', 'shore')},
     bx as (select feature_id, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from rr group by feature_id),
     gr as (select feature_id, i, j, x0 + (x1 - x0) * (i + 0.5e0) / 12 as lon, y0 + (y1 - y0) * (j + 0.5e0) / 12 as lat from bx cross join range(12) a(i) cross join range(12) b(j)),
     ed as (select feature_id, lon as xi, lat as yi, lead(lon) over w as xj, lead(lat) over w as yj from rr window w as (partition by feature_id order by seq)),
     ins as (select g.feature_id, g.i, g.j, g.lon, g.lat from gr g join ed e on e.feature_id = g.feature_id and (yi > g.lat) <> (yj > g.lat) and g.lon < (xj - xi) * (g.lat - yi) / (yj - yi) + xi
       group by all having count(*) % 2 = 1),
     {nearest_sql('ins', 'feature_id, i, j', 'inner_s')},
     rk as (select feature_id, elev, row_number() over (partition by feature_id order by elev) - 1 as k, count(*) over (partition by feature_id) as n from inner_s),
     p as (select feature_id, n, elev from rk where k = least(n - 1, cast(floor(n * 0.1e0) as bigint))),
     f as (select feature_id, median(elev) as full_el, min(elev) as lo from shore group by feature_id),
     q as (select f.feature_id, full_el, coalesce(n, 0) as samples, least(case when coalesce(n, 0) >= 5 then p.elev else lo end, full_el) as fl from f left join p using (feature_id))
     select feature_id, cast(round_even(full_el, 0) as bigint) as full_el, cast(round_even(case when full_el - fl < 3 then full_el - 3 else fl end, 0) as bigint) as floor_el, cast(samples as bigint) as samples from q""",
)
def _(t):
    return sampling.basin_levels(t.rings.where("ring_id = 0"), t.dem, "feature_id", (5, 4), n=12)


ROUTES = """rt as (select p_partkey as route_id, (p_partkey * 13) % 100 * 1e0 as ax, (p_partkey * 7) % 20 * 1e0 as ay, (p_partkey * 29 + 31) % 100 * 1e0 as bx, (p_partkey * 11 + 5) % 20 * 1e0 as byy from part),
 rd as (select *, sqrt(pow(bx-ax,2)+pow(byy-ay,2)) as d from rt), ru as (select *, (bx-ax)/d as ux, (byy-ay)/d as uy, least(7e0, d*0.4e0) as bk from rd where d > 0),
 re as (select *, bx - ux*bk as ex, byy - uy*bk as ey from ru), rm as (select *, (ax+ex)/2e0 - uy*d*0.22e0 as mx, (ay+ey)/2e0 + ux*d*0.22e0 as my from re),
 rs as (select route_id, i as seq, (1e0-i/23e0)*(1e0-i/23e0)*ax + 2e0*(1e0-i/23e0)*(i/23e0)*mx + (i/23e0)*(i/23e0)*ex as x, (1e0-i/23e0)*(1e0-i/23e0)*ay + 2e0*(1e0-i/23e0)*(i/23e0)*my + (i/23e0)*(i/23e0)*ey as y from rm cross join range(24) s(i))"""


@query(
    "e12_route_profile",
    f"""with {ROUTES}, {bilinear_sql('rs', 'route_id, seq', 'x', 'y', 'cells')},
     e as (select *, max(v) over w as e0 from bl window w as (partition by route_id order by seq rows between 2 preceding and 2 following)),
     a as (select *, avg(e0) over w as a1 from e window w as (partition by route_id order by seq rows between 2 preceding and 2 following)),
     b as (select *, avg(a1) over w as a2 from a window w as (partition by route_id order by seq rows between 2 preceding and 2 following)),
     c as (select *, avg(a2) over w as a3 from b window w as (partition by route_id order by seq rows between 2 preceding and 2 following))
     select route_id, round(min(a3 + 20e0 - v), 8) as min_clearance, count(*) filter (where a3 + 20e0 - v < 9.7531e0) as violations from c group by route_id""",
)
def _(t):
    r = t.part.selectExpr("p_partkey as route_id", "(p_partkey * 13) % 100 * 1e0 as ax", "(p_partkey * 7) % 20 * 1e0 as ay", "(p_partkey * 29 + 31) % 100 * 1e0 as bx", "(p_partkey * 11 + 5) % 20 * 1e0 as by")
    p = sampling.route_profile(r, t.cells, 24, 20.0, 2)
    return sampling.clearance(p, 9.7531).withColumn("min_clearance", F.round("min_clearance", 8))


@query(
    "e13_contours",
    """with q as (select c.gx, c.gy, c.v as a, e.v as b, se.v as c, s.v as d from cells c join cells e on e.gx = c.gx + 1 and e.gy = c.gy join cells s on s.gx = c.gx and s.gy = c.gy + 1 join cells se on se.gx = c.gx + 1 and se.gy = c.gy + 1),
     l as (select *, unnest(range(cast(floor(least(a,b,c,d) / 50e0) as bigint) + 1, cast(floor(greatest(a,b,c,d) / 50e0) as bigint) + 1)) * 50e0 as lv from q),
     s as (select *, a >= lv as ka, b >= lv as kb, c >= lv as kc, d >= lv as kd, {'x': gx + (lv-a)/(b-a), 'y': gy * 1e0} as t, {'x': gx + 1e0, 'y': gy + (lv-b)/(c-b)} as r,
       {'x': gx + (lv-d)/(c-d), 'y': gy + 1e0} as bo, {'x': gx * 1e0, 'y': gy + (lv-a)/(d-a)} as le from l),
     g as (select gx, gy, lv, 0 as part, case when ka = kc and kb = kd then t when ka <> kb then t when kb <> kc then r else bo end as p,
        case when ka = kc and kb = kd then (case when ka then le else r end) when ka <> kb and kb <> kc then r when ka <> kb and kc <> kd then bo when ka <> kb then le when kb <> kc and kc <> kd then bo else le end as q from s
       union all select gx, gy, lv, 1, case when ka then r else bo end, case when ka then bo else le end from s where ka = kc and kb = kd)
     select gx, gy, lv as level, cast(part as integer) as part, round(p.x, 5) as x0, round(p.y, 5) as y0, round(q.x, 5) as x1, round(q.y, 5) as y1 from g""",
)
def _(t):
    c = raster.contours(t.cells, 50.0)
    return c.select("gx", "gy", "level", "part", *[F.round(x, 5).alias(x) for x in ("x0", "y0", "x1", "y1")])
