"""Queries over whole-raster solves."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..operators import hydrology, raster
from .queries_functions import GX, GY
from .queries_rasters import D8_SQL
from .registry import REGISTRY, query

# relax from the border inwards until a whole round changes nothing
FILL = """rk as (select max(gx) as mx, max(gy) as my from cells),
 fl as (select 0 as it, gx, gy, v, case when gx = 0 or gy = 0 or gx = mx or gy = my then v else 1e9::double end as f, true as more from cells cross join rk
  union all
  select it + 1, gx, gy, v, nf as f, bool_or(nf <> f) over () as more from (
   select it, gx, gy, v, f, more, least(f, greatest(v, least(
     min(f) over (partition by gx order by gy rows between 1 preceding and 1 following),
     min(h3) over (partition by gx order by gy rows between 1 preceding and 1 following)) + 1e-4)) as nf
   from (select *, min(f) over (partition by gy order by gx rows between 1 preceding and 1 following) as h3 from fl where more) a) b),
 filled as (select gx, gy, v, f as filled from fl where it = (select max(it) from fl))"""


@query("r1_fill_depressions", f"with {FILL} select gx, gy, round(filled, 6) as filled from filled")
def _(t):
    return hydrology.fill_depressions(t.cells).select("gx", "gy", F.round("filled", 6).alias("filled"))


FC = "fc as materialized (select gx, gy, filled as v from filled)"
# every cell walks down to its outlet
ACC = "wk as (select gx as ox, gy as oy, gx, gy from d8 union all select w.ox, w.oy, d.rx, d.ry from wk w join d8 d on d.gx = w.gx and d.gy = w.gy where d.rx <> d.gx or d.ry <> d.gy)"


def _filled(t):
    return hydrology.fill_depressions(t.cells)


def _d8(t):
    return raster.d8(_filled(t).select("gx", "gy", F.col("filled").alias("v")), 17.5)


@query("r3_accumulate", f"with {FILL}, {FC}, {D8_SQL.format(m='17.5e0', cells='fc').replace('d8 as (', 'd8 as materialized (')}, {ACC} select gx, gy, count(*) as acc from wk group by gx, gy")
def _(t):
    return hydrology.accumulate(_d8(t)).select("gx", "gy", "acc")


@query("r3_max_catchment", f"with {FILL}, {FC}, {D8_SQL.format(m='17.5e0', cells='fc').replace('d8 as (', 'd8 as materialized (')}, {ACC} select max(n) * {17.5 ** 2 / 1e6!r} as max_km2 from (select gx, gy, count(*) as n from wk group by gx, gy) q")
def _(t):
    return raster.catchment_km2(hydrology.accumulate(_d8(t)), 17.5).agg(F.max("area_km2").alias("max_km2"))


@query(
    "r4_accumulate_mfd",
    f"""with {FILL}, {FC}, ed as (select c.gx, c.gy, n.gx as nx, n.gy as ny, pow((c.v - n.v) / (case when c.gx <> n.gx and c.gy <> n.gy then 17.5e0 * sqrt(2e0) else 17.5e0 end), 4) as wt
       from fc c join fc n on n.gx between c.gx - 1 and c.gx + 1 and n.gy between c.gy - 1 and c.gy + 1 and c.v > n.v),
     we as materialized (select gx, gy, nx, ny, wt / sum(wt) over (partition by gx, gy) as w from ed),
     fw as (select 0 as it, gx, gy, 1e0 as load from fc union all select it + 1, nx, ny, sum(load * w) from fw join we using (gx, gy) group by it, nx, ny)
     select gx, gy, round(sum(load), 6) as acc from fw group by gx, gy""",
)
def _(t):
    return hydrology.accumulate_mfd(_filled(t).select("gx", "gy", "filled"), 4.0, 17.5).select("gx", "gy", F.round("acc", 6).alias("acc"))


REG = """lo as (select gx, gy from cells where v <= {lim}), rg as (select gx, gy, gx as sx, gy as sy from lo union select n.gx, n.gy, r.sx, r.sy from rg r join lo n on abs(n.gx - r.gx) + abs(n.gy - r.gy) = 1),
 cp as (select gx, gy, min(sy * 4294967296 + sx) as region from rg group by gx, gy), rk as (select max(gx) as mx, max(gy) as my from cells),
 vd as (select gx, gy, region from cp where region not in (select region from cp cross join rk where gx in (0, mx) or gy in (0, my)))"""


@query("r6_interior_voids", f"with {REG.format(lim='90')} select gx, gy, region from vd")
def _(t):
    return hydrology.interior_voids(t.cells, 90.0)


@query("r7_fill_holes", f"with {REG.format(lim='90')} select gx, gy, v > 90 or (gx, gy) in (select (gx, gy) from vd) as m from cells")
def _(t):
    return hydrology.fill_holes(t.cells.selectExpr("gx", "gy", "v > 90 as m"))


def _relax_sql(n):
    steps = ["w0 as (select gx, gy, a as v, true as free from vd join st using (region) union all select gx, gy, v, false from rim)"]
    for i in range(n):
        steps.append(
            f"w{i + 1} as (select c.gx, c.gy, case when c.free then avg(n.v) else any_value(c.v) end as v, c.free from w{i} c left join w{i} n on abs(n.gx - c.gx) + abs(n.gy - c.gy) = 1 group by c.gx, c.gy, c.free)"
        )
    return ", ".join(steps)


@query(
    "r8_fill_voids",
    f"""with {REG.format(lim='90')}, rn as (select distinct region, c.gx, c.gy, c.v from vd join cells c on abs(c.gx - vd.gx) + abs(c.gy - vd.gy) = 1 where (c.gx, c.gy) not in (select (gx, gy) from vd)),
     st as (select region, avg(v) as a from rn group by region), rim as (select distinct gx, gy, v from rn), {_relax_sql(5)}
     select c.gx, c.gy, round(coalesce(w.v, c.v), 6) as v from cells c left join (select * from w5 where free) w using (gx, gy)""",
)
def _(t):
    v = hydrology.interior_voids(t.cells, 90.0)
    return hydrology.fill_voids(t.cells.select("gx", "gy", "v"), v, iters=5, per_round=2).select("gx", "gy", F.round("v", 6).alias("v"))


@query(
    "r8_fill_voids_settled",
    f"""with {REG.format(lim='90')}, rn as (select distinct region, c.gx, c.gy, c.v from vd join cells c on abs(c.gx - vd.gx) + abs(c.gy - vd.gy) = 1 where (c.gx, c.gy) not in (select (gx, gy) from vd)),
     st as (select region, avg(v) as a from rn group by region), rim as (select distinct gx, gy, v from rn),
     w0 as (select gx, gy, a as v, true as free from vd join st using (region) union all select gx, gy, v, false from rim),
     nb as (select a.gx, a.gy, b.gx as nx, b.gy as ny from vd a join w0 b on abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
     w as (select 0 as it, gx, gy, v, free, true as more from w0
      union all
      select it + 1, gx, gy, nv, free, max(abs(nv - v)) over () > 1e-11 as more from (
       select c.it, c.gx, c.gy, c.v, c.free, case when c.free then avg(n.v) else any_value(c.v) end as nv
       from w c left join nb on nb.gx = c.gx and nb.gy = c.gy left join w n on n.gx = nb.nx and n.gy = nb.ny where c.more group by c.it, c.gx, c.gy, c.v, c.free) q)
     select c.gx, c.gy, round(coalesce(w.v, c.v), 6) as v from cells c left join (select * from w where free and it = (select max(it) from w)) w using (gx, gy)""",
)
def _(t):
    v = hydrology.interior_voids(t.cells, 90.0)
    return hydrology.fill_voids(t.cells.select("gx", "gy", "v"), v, tol=1e-9).select("gx", "gy", F.round("v", 6).alias("v"))


@query("r15_polygonize", """with m as (select gx, gy from cells where v > 250),
 rg as (select gx, gy, gx as sx, gy as sy from m union select n.gx, n.gy, r.sx, r.sy from rg r join m n on abs(n.gx - r.gx) <= 1 and abs(n.gy - r.gy) <= 1),
 cp as (select gx, gy, min(sy * 4294967296 + sx) as region from rg group by gx, gy)
 select region, cast(count(*) as double) as area from cp group by region""")
def _(t):
    # the signed area of a region's rings is its number of cells
    r = hydrology.polygonize(t.cells.where("v > 250"))
    from ..operators.geometry import plane_areas

    a = plane_areas(r.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), ["region", "ring_id"])
    return a.groupBy("region").agg(F.sum("signed").alias("area"))


@query("r15_ring_corners", """with m as (select gx, gy from cells where v > 250),
 c as (select gx + i as x, gy + j as y, count(*) as n, min(i + 2 * j) as lo, max(i + 2 * j) as hi from m cross join range(2) a(i) cross join range(2) b(j) group by 1, 2)
 select x, y, cast(case when n in (1, 3) then 1 else 2 end as bigint) as turns from c where n in (1, 3) or (n = 2 and lo + hi = 3)""")
def _(t):
    """Where the outlines turn: once at a corner with one or three cells, twice where two
    cells touch by it only; nowhere else."""
    r = hydrology.polygonize(t.cells.where("v > 250"))
    return r.groupBy("x", "y").agg(F.count("*").alias("turns"))


PX = f"px as (select feature_id, ring_id, seq, {GX.format(s=512 * 256)} as x, {GY.format(s=512 * 256)} as y from rings)"


@query(
    "r16_rasterize",
    f"""with {PX}, ed as (select feature_id, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from px window w as (partition by feature_id, ring_id order by seq)),
     e as (select * from ed where x1 is not null),
     rw as (select *, unnest(range(cast(floor(least(y0, y1)) as bigint), cast(floor(greatest(y0, y1)) as bigint) + 1)) as gy from e),
     cl as (select feature_id, gy, case when y0 = y1 then x0 else x0 + (x1 - x0) * (greatest(least(y0, y1), gy) - y0) / (y1 - y0) end as xa, case when y0 = y1 then x1 else x0 + (x1 - x0) * (least(greatest(y0, y1), gy + 1e0) - y0) / (y1 - y0) end as xb from rw),
     ec as (select feature_id, unnest(range(cast(floor(least(xa, xb)) as bigint), cast(floor(greatest(xa, xb)) as bigint) + 1)) as gx, gy from cl),
     bx as (select feature_id, cast(floor(min(x)) as bigint) as ax, cast(floor(max(x)) as bigint) as bx, cast(floor(min(y)) as bigint) as ay, cast(floor(max(y)) as bigint) as byy from px group by feature_id),
     gc as (select feature_id, gx, unnest(range(ay, byy + 1)) as gy from (select *, unnest(range(ax, bx + 1)) as gx from bx) q),
     ic as (select c.feature_id, gx, gy from gc c join e on e.feature_id = c.feature_id and (y0 > gy + 0.5e0) <> (y1 > gy + 0.5e0) and gx + 0.5e0 < x0 + (x1 - x0) * (gy + 0.5e0 - y0) / (y1 - y0) group by all having count(*) % 2 = 1)
     select feature_id, gx, gy from ec union select feature_id, gx, gy from ic""",
)
def _(t):
    return hydrology.rasterize(t.rings, 9, "feature_id")


def _in_blocks(name: str, of: str, fn) -> None:
    """Register ``fn`` with the SQL of query ``of``: the same answer from blocks of 16
    cells, so that borders between many blocks are exchanged."""
    query(name)(fn)
    REGISTRY[name] = dataclasses.replace(REGISTRY[name], sql=REGISTRY[of].sql)


_in_blocks("r1_blocks", "r1_fill_depressions", lambda t: hydrology.fill_depressions(t.cells, block=16).select("gx", "gy", F.round("filled", 6).alias("filled")))
_in_blocks("r4_blocks", "r4_accumulate_mfd", lambda t: hydrology.accumulate_mfd(_filled(t).select("gx", "gy", "filled"), 4.0, 17.5, block=16).select("gx", "gy", F.round("acc", 6).alias("acc")))
_in_blocks("r6_blocks", "r6_interior_voids", lambda t: hydrology.interior_voids(t.cells, 90.0, block=16))
_in_blocks("r7_blocks", "r7_fill_holes", lambda t: hydrology.fill_holes(t.cells.selectExpr("gx", "gy", "v > 90 as m"), block=16))
_in_blocks("r3_blocks", "r3_accumulate", lambda t: hydrology.accumulate(_d8(t), block=8).select("gx", "gy", "acc"))
