"""Rasters as cell tables (gx, gy, v): stencils, masks, pooling, regridding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import pixel_to_lonlat
from ..functions.shape import clamp

BLOCK = 256
# neighbour order: row above west to east, same row, row below
STEPS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
NAMES = ["nw", "n", "ne", "w", "e", "sw", "s", "se"]


def halo_blocks(cells: DataFrame, size: int = BLOCK, halo: int = 1) -> DataFrame:
    """Cells keyed by square blocks (bx, by). Cells within ``halo`` of a block
    border also go to the neighbour (``core`` false there), about
    4*halo/size of the rows. One shuffle puts each block into one task."""

    def blocks(g: str) -> Column:
        b = F.floor(F.col(g) / size).cast("long")
        r = F.col(g) - b * size
        # a halo wider than a block reaches further blocks
        reach = math.ceil(halo / size)
        near = [
            F.when(r + k * size < halo, b - k - 1) for k in range(reach)
        ] + [b] + [F.when(r - k * size >= size - halo, b + k + 1) for k in range(reach)]
        return F.explode(F.filter(F.array(*near), lambda x: x.isNotNull()))

    out = cells.select("*", blocks("gx").alias("bx")).select("*", blocks("gy").alias("by"))
    own = (F.col("bx") == F.floor(F.col("gx") / size)) & (F.col("by") == F.floor(F.col("gy") / size))
    return out.withColumn("core", own).repartition("bx", "by")


def neighbours(cells: DataFrame, value: str | Column = "v", block: int = BLOCK, gaps: bool = False) -> DataFrame:
    """Each cell with its eight neighbours' values (null where there is no cell),
    from one block shuffle and windows inside the blocks.

    A diagonal is found by way of either cell it shares with the middle, which
    covers full rectangles, ragged borders and single holes. For scattered cells
    pass ``gaps``: empty cells are then laid around every cell first."""
    cols = cells.columns
    val = F.col(value) if isinstance(value, str) else value
    c = cells.withColumns({"_v": val, "_real": F.lit(True)})
    if gaps:
        around = F.explode(F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in STEPS]))
        ghosts = cells.select(around.alias("a")).select("a.*").distinct().join(cells.select("gx", "gy"), ["gx", "gy"], "left_anti")
        c = c.unionByName(ghosts.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    h = halo_blocks(c, block)
    row = Window.partitionBy("bx", "by", "gy").orderBy("gx")
    col = Window.partitionBy("bx", "by", "gx").orderBy("gy")

    def step(w, axis: str, offset: int, what: Column) -> Column:
        fn = F.lag if offset < 0 else F.lead
        return F.when(fn(axis).over(w) == F.col(axis) + offset, fn(what).over(w))

    h = h.withColumns({"_w": step(row, "gx", -1, F.col("_v")), "_e": step(row, "gx", 1, F.col("_v"))})
    trio = F.struct("_w", F.col("_v").alias("_c"), "_e")
    h = h.withColumns({"_up": step(col, "gy", -1, trio), "_dn": step(col, "gy", 1, trio)})
    pair = F.struct(F.col("_up._c").alias("_n"), F.col("_dn._c").alias("_s"))
    h = h.withColumns({"_lf": step(row, "gx", -1, pair), "_rt": step(row, "gx", 1, pair)})
    return h.where("core and _real").select(
        *cols,
        F.coalesce("_up._w", "_lf._n").alias("nw"),
        F.col("_up._c").alias("n"),
        F.coalesce("_up._e", "_rt._n").alias("ne"),
        F.col("_w").alias("w"),
        F.col("_e").alias("e"),
        F.coalesce("_dn._w", "_lf._s").alias("sw"),
        F.col("_dn._c").alias("s"),
        F.coalesce("_dn._e", "_rt._s").alias("se"),
    )


def d8(cells: DataFrame, cell_m: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Receiver (rx, ry) of every cell: steepest strictly positive descent, the
    first direction on ties, itself without one."""
    n = neighbours(cells, "v", block)
    diag = cell_m * math.sqrt(2.0)
    slopes = {nm: (F.col("v") - F.col(nm)) / F.lit(diag if dx and dy else cell_m) for nm, (dx, dy) in zip(NAMES, STEPS)}
    n = n.withColumns({f"_s_{k}": s for k, s in slopes.items()}).withColumn("slope", F.greatest(*[F.col(f"_s_{k}") for k in NAMES]))
    rx, ry = F.col("gx"), F.col("gy")
    for nm, (dx, dy) in reversed(list(zip(NAMES, STEPS))):
        hit = (F.col("slope") > 0) & (F.col(f"_s_{nm}") == F.col("slope"))
        rx = F.when(hit, F.col("gx") + dx).otherwise(rx)
        ry = F.when(hit, F.col("gy") + dy).otherwise(ry)
    slope = F.when(F.col("slope") > 0, F.col("slope")).otherwise(F.lit(0.0))
    return n.select(*cells.columns, rx.alias("rx"), ry.alias("ry"), slope.alias("slope"))


def catchment_km2(acc: DataFrame, cell_m: float, col: str = "acc") -> DataFrame:
    return acc.withColumn("area_km2", F.col(col) * (cell_m * cell_m / 1e6))


def cell_metres(z: int, lat: float) -> float:
    """Ground size of a pixel at a zoom and latitude."""
    return 156543.03392 / 2**z * math.cos(math.radians(lat))


# ------------------------------------------------------------------- stencils
def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    s = sum(w)
    return [x / s for x in w]


def _mirror(df: DataFrame, g: str, lo: int, hi: int, r: int) -> DataFrame:
    """Repeat border cells mirrored around the edges, ``r`` cells deep."""
    period = 2 * (hi - lo + 1)
    turns = math.ceil(r / period)
    shifts = [k * period for k in range(-turns, turns + 1)]
    spots = F.array(*[F.col(g) + s for s in shifts], *[F.lit(2 * lo - 1 + s) - F.col(g) for s in shifts])
    keep = F.filter(spots, lambda p: (p >= lo - r) & (p <= hi + r))
    return df.withColumn("_at", F.explode(keep)).drop(g).withColumnRenamed("_at", g)


def full_bounds(cells: DataFrame) -> tuple[int, int, int, int]:
    """:func:`bounds` of a full rectangle, by one pass; an error if cells are missing or
    stand twice: what a neighbour is then depends on the gaps."""
    r = cells.agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.count("*").alias("n")).first()
    if r["n"] and r["n"] != (r["x1"] - r["x0"] + 1) * (r["y1"] - r["y0"] + 1):
        raise ValueError(f"{r['n']} cells do not fill x {r['x0']}..{r['x1']}, y {r['y0']}..{r['y1']} once each: lay the missing ones first")
    return r["x0"], r["x1"], r["y0"], r["y1"]


def blur(cells: DataFrame, sigma: float, col: str = "v", out: str | None = None, block: int = BLOCK, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Separable Gaussian cut at four sigma with mirrored edges, for a full
    rectangle (``box``, if its bounds are known). Both passes run inside blocks with a
    halo as wide as the kernel. Gaps are an error; an empty grid stays empty."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    if r == 0:
        return cells.withColumn(out or col, F.col(col))
    x0, x1, y0, y1 = box or full_bounds(cells)
    if x0 is None:
        return cells.withColumn(out or col, F.col(col))
    c = cells.select("gx", "gy", F.col(col).alias("_v"))
    c = _mirror(_mirror(c, "gx", x0, x1, r), "gy", y0, y1, r)
    h = halo_blocks(c, max(block, 2 * r), r)
    real = F.col("gx").between(x0, x1) & F.col("gy").between(y0, y1)

    def pass_(df, along, across, src, dst):
        win = Window.partitionBy("bx", "by", across).orderBy(along)
        parts = [
            (F.lag(src, -k).over(win) if k < 0 else F.lead(src, k).over(win)) * wk for k, wk in zip(range(-r, r + 1), w)
        ]
        return df.withColumn(dst, reduce(lambda a, b: a + b, parts))

    h = pass_(h, "gy", "gx", "_v", "_b1")
    h = pass_(h, "gx", "gy", "_b1", "_b2")
    done = h.where(F.col("core") & real).select("gx", "gy", F.col("_b2").alias(out or col))
    rest = [x for x in cells.columns if x not in ("gx", "gy", out or col)]
    return done if not rest else cells.select("gx", "gy", *rest).join(done, ["gx", "gy"])


def slope(cells: DataFrame, cell_m: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Gradient (dx, dy), slope and unit normal; one-sided at the borders."""
    n = neighbours(cells, "v", block)

    def diff(a: str, b: str) -> Column:
        both = (F.col(b) - F.col(a)) / 2.0
        return F.coalesce(both, F.col(b) - F.col("v"), F.col("v") - F.col(a), F.lit(0.0)) / cell_m

    n = n.select(*cells.columns, diff("w", "e").alias("dx"), diff("n", "s").alias("dy"))
    n = n.withColumn("slope", F.hypot("dx", "dy"))
    ln = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1.0)
    return n.withColumns({"nx": -F.col("dx") / ln, "ny": -F.col("dy") / ln, "nz": 1.0 / ln})


def suitable(cells: DataFrame, lo: float, hi: float, max_slope: float, cell_m: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Cells in the elevation band (lo, hi] that are not too steep."""
    s = slope(cells, cell_m, block)
    return s.where((F.col("v") > lo) & (F.col("v") <= hi) & (F.col("slope") <= max_slope))


def adaptive_blur(cells: DataFrame, cell_m: float, sigma_steep: float, sigma_flat: float, slope_lo: float, slope_hi: float, sea: float = 0.0) -> DataFrame:
    """``intensity`` blurred narrowly on slopes and widely on flats, zero at or
    below sea level. ``cells`` holds v (height) and intensity."""
    s = slope(cells.select("gx", "gy", "v"), cell_m).select("gx", "gy", "v", "slope")
    src = cells.select("gx", "gy", "intensity")
    box = full_bounds(src)
    crisp, wide = blur(src, sigma_steep, "intensity", "_crisp", box=box), blur(src, sigma_flat, "intensity", "_wide", box=box)
    j = s.join(crisp.select("gx", "gy", "_crisp"), ["gx", "gy"]).join(wide.select("gx", "gy", "_wide"), ["gx", "gy"])
    flat = clamp((slope_hi - F.col("slope")) / (slope_hi - slope_lo), 0.0, 1.0)
    mix = F.col("_crisp") * (1.0 - flat) + F.col("_wide") * flat
    return j.select("gx", "gy", F.when(F.col("v") <= sea, F.lit(0.0)).otherwise(mix).alias("intensity"))


def erode(mask: DataFrame, col: str = "valid", block: int = BLOCK) -> DataFrame:
    """True where the whole 3x3 neighbourhood is true; borders repeat outward."""
    n = neighbours(mask, col, block)
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(k), F.lit(True)) for k in NAMES], F.col(col))
    return n.select(*[c for c in mask.columns if c != col], ok.alias(col))


def threshold(cells: DataFrame, t: float, nodata: float | None = None) -> DataFrame:
    v = F.col("v")
    ok = v > t if nodata is None else (v > t) & (v != nodata)
    return cells.select("gx", "gy", ok.alias("m"))


# -------------------------------------------------------------- size and shape
def bounds(cells: DataFrame) -> tuple[int, int, int, int]:
    """(x0, x1, y0, y1) of the raster as four plain numbers."""
    r = extent(cells).first()
    return r["x0"], r["x1"], r["y0"], r["y1"]


def extent(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1")
    )


def block_pool(cells: DataFrame, k: int, how: str = "max", col: str = "v") -> DataFrame:
    """k x k pooling from the grid origin; incomplete border blocks are cut off."""
    x0, x1, y0, y1 = bounds(cells)
    bx, by = F.floor((F.col("gx") - x0) / k), F.floor((F.col("gy") - y0) / k)
    whole = (F.col("gx") < x0 + (x1 - x0 + 1) // k * k) & (F.col("gy") < y0 + (y1 - y0 + 1) // k * k)
    agg = F.max(col) if how == "max" else F.avg(col)
    return cells.where(whole).groupBy(bx.alias("gx"), by.alias("gy")).agg(agg.alias(col))


def crop_bounds(mask: DataFrame, z: int, col: str = "m", ox: int = 0, oy: int = 0) -> DataFrame:
    """Tight pixel bounds of a mask and their geographic edges."""
    b = mask.where(F.col(col)).agg(F.min("gx").alias("c0"), F.max("gx").alias("c1"), F.min("gy").alias("r0"), F.max("gy").alias("r1"))
    lon0, lat1 = pixel_to_lonlat(F.col("c0") + ox, F.col("r0") + oy, z)
    lon1, lat0 = pixel_to_lonlat(F.col("c1") + 1 + ox, F.col("r1") + 1 + oy, z)
    return b.withColumns(
        {"min_lon": lon0, "max_lon": lon1, "min_lat": lat0, "max_lat": lat1, "w": F.col("c1") - F.col("c0") + 1, "h": F.col("r1") - F.col("r0") + 1}
    )


def crop(cells: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return cells.where(F.col("gx").between(x0, x1) & F.col("gy").between(y0, y1))


def drop_buffer_ring(cells: DataFrame, tiles: int = 1, tile: int = 256) -> DataFrame:
    """Remove the outer ring of buffer tiles of a rectangular tile block."""
    x0, x1, y0, y1 = (b // tile for b in bounds(cells))
    return crop(cells, (x0 + tiles) * tile, (y0 + tiles) * tile, (x1 - tiles + 1) * tile - 1, (y1 - tiles + 1) * tile - 1)


def edge_fade(cells: DataFrame, n: int, col: str = "v") -> DataFrame:
    """Values faded linearly to zero over ``n`` cells from the grid border."""
    x0, x1, y0, y1 = bounds(cells)
    d = F.least(F.col("gx") - x0, F.lit(x1) - F.col("gx"), F.col("gy") - y0, F.lit(y1) - F.col("gy"))
    return cells.withColumn("fade", clamp(d / float(n), 0.0, 1.0)).withColumn("faded", F.col(col) * F.col("fade"))


def mosaic(rasters: list[DataFrame], nodata: float | None = None) -> DataFrame:
    """Cell-wise union; the last raster with a valid value wins."""
    tagged = [r.select("gx", "gy", "v", F.lit(i).alias("_p")) for i, r in enumerate(rasters)]
    u = reduce(DataFrame.unionByName, tagged).where(F.col("v").isNotNull())
    if nodata is not None:
        u = u.where(F.col("v") != nodata)
    return u.groupBy("gx", "gy").agg(F.max_by("v", "_p").alias("v"))


def local_extrema(cells: DataFrame, sign: int = 1, block: int = BLOCK) -> DataFrame:
    """Cells strictly above (sign 1) or below (-1) all their neighbours."""
    n = neighbours(cells, "v", block)
    beats = [F.coalesce((F.col("v") - F.col(k)) * sign > 0, F.lit(True)) for k in NAMES]
    return n.where(reduce(lambda a, b: a & b, beats)).select(*cells.columns)


def contours(cells: DataFrame, interval: float, block: int = BLOCK) -> DataFrame:
    """Marching squares: one row per segment (level, x0, y0, x1, y1), numbered
    ``part`` within its square. Saddles separate the two high corners."""
    q = neighbours(cells, "v", block).where(F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("se").isNotNull())
    a, b, c, d = F.col("v"), F.col("e"), F.col("se"), F.col("s")
    lo, hi = F.floor(F.least(a, b, c, d) / interval), F.floor(F.greatest(a, b, c, d) / interval)
    q = q.where(hi > lo).withColumn("_k", F.explode(F.sequence(lo + 1, hi))).withColumn("level", F.col("_k") * interval)
    lv = F.col("level")
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")

    def at(p, r):
        return (lv - p) / (r - p)

    def pt(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    one = F.lit(1.0)
    t, r, bo, le = pt(x + at(a, b), y), pt(x + one, y + at(b, c)), pt(x + at(d, c), y + one), pt(x, y + at(a, d))
    ka, kb, kc, kd = a >= lv, b >= lv, c >= lv, d >= lv
    crossings = F.filter(
        F.array(F.when(ka != kb, t), F.when(kb != kc, r), F.when(kc != kd, bo), F.when(kd != ka, le)), lambda p: p.isNotNull()
    )
    saddle = (ka == kc) & (kb == kd) & (ka != kb)
    pair = lambda p, s: F.struct(p.alias("p"), s.alias("q"))
    segs = (
        F.when(saddle & ka, F.array(pair(t, le), pair(r, bo)))
        .when(saddle, F.array(pair(t, r), pair(bo, le)))
        .otherwise(F.array(pair(crossings[0], crossings[1])))
    )
    out = q.select("gx", "gy", "level", F.posexplode(segs).alias("part", "g"))
    return out.select(
        "gx", "gy", "level", "part", F.col("g.p.x").alias("x0"), F.col("g.p.y").alias("y0"), F.col("g.q.x").alias("x1"), F.col("g.q.y").alias("y1")
    )
