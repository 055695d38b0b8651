"""Reading rasters at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lonlat_to_pixel
from ..functions.shape import clamp
from .aggs import exact_median, percentile_rank
from .geometry import open_rings, ring_edges
from .ordered import SLICE, _cols, group_stats
from .raster import erode
from .windows import by_seq, profile_envelope, ring_roll_min

NODATA_BELOW = -100.0


def sample_nearest(points: DataFrame, cells: DataFrame, zooms=(13, 12), out: str = "elev") -> DataFrame:
    """Height of the pixel under each point, from the finest zoom that has it;
    0 without any. Values under -100 m count as sea. Adds ``out`` (rounded half
    to even) and ``level`` ('z13', ..., 'sea'). ``cells`` holds z, gx, gy, v."""
    cols = points.columns
    got = points
    for z in zooms:
        gx, gy = lonlat_to_pixel("lon", "lat", z)
        layer = cells.where(F.col("z") == z).select(F.col("gx").alias("_gx"), F.col("gy").alias("_gy"), F.col("v").alias(f"_v{z}"))
        got = got.withColumns({"_gx": F.floor(gx).cast("long"), "_gy": F.floor(gy).cast("long")}).join(layer, ["_gx", "_gy"], "left").drop("_gx", "_gy")
    v = F.coalesce(*[F.col(f"_v{z}") for z in zooms], F.lit(0.0))
    level = F.coalesce(*[F.when(F.col(f"_v{z}").isNotNull(), F.lit(f"z{z}")) for z in zooms], F.lit("sea"))
    v = F.when(v < NODATA_BELOW, F.lit(0.0)).otherwise(v)
    return got.select(*cols, F.rint(v).cast("long").alias(out), level.alias("level"))


def hit_levels(sampled: DataFrame) -> DataFrame:
    """How many points were answered by each level."""
    return sampled.groupBy("level").agg(F.count("*").alias("n"))


POINTS_HELD = 200_000  # points whose taps one task adds up


def _taps(x: Column, y: Column) -> Column:
    """Four (gx, gy, weight) around pixel-centre coordinates; centres sit at +0.5."""
    sx, sy = x - 0.5, y - 0.5
    x0, y0 = F.floor(sx).cast("long"), F.floor(sy).cast("long")
    fx, fy = sx - x0, sy - y0
    one = F.lit(1.0)

    def tap(i, j):
        w = (fx if i else one - fx) * (fy if j else one - fy)
        return F.struct((x0 + i).alias("gx"), (y0 + j).alias("gy"), w.alias("w"))

    return F.array(tap(0, 0), tap(1, 0), tap(0, 1), tap(1, 1))


def bilinear_at(points: DataFrame, cells: DataFrame, key, x: Column, y: Column, values=("v",)) -> DataFrame:
    """Bilinear value at pixel coordinates, one row per ``key``; missing cells
    read as 0. Four taps per point meet the cells in one equi-join."""
    key = _cols(key)
    # points may come from a small file: tasks by their number, or one would add up all
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count() // POINTS_HELD + 1)
    taps = points.repartition(tasks, *key).select(*key, F.explode(_taps(x, y)).alias("_t")).select(*key, "_t.*")
    j = taps.join(cells.select("gx", "gy", *values), ["gx", "gy"], "left")
    return j.groupBy(*key).agg(*[F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in values])


def sample_bilinear(points: DataFrame, cells: DataFrame, z: int, key) -> DataFrame:
    """Bilinear height at lon/lat, across tile borders."""
    gx, gy = lonlat_to_pixel("lon", "lat", z)
    return bilinear_at(points, cells.where(F.col("z") == z), key, gx, gy)


def fill_from_parent(wanted: DataFrame, fine: DataFrame, coarse: DataFrame, tile: int = 256, align: str = "corner") -> DataFrame:
    """Cells of the wanted tiles (tx, ty) that ``fine`` lacks, from the matching
    quadrant of the parent tile enlarged twice; tiles whose parent is missing
    give no rows. ``corner`` puts source samples on pixel corners and may read
    past the quadrant, ``center`` resizes the quadrant on its own."""
    half = tile // 2
    # the optimizer does not see that the taps are tile * tile * 4 times the tiles: it would broadcast them
    tile_of = lambda df: df.select(F.floor(F.col("gx") / tile).cast("long").alias("tx"), F.floor(F.col("gy") / tile).cast("long").alias("ty")).distinct()
    missing = wanted.select("tx", "ty").distinct().join(tile_of(fine), ["tx", "ty"], "left_anti")
    parents = tile_of(coarse).select(F.col("tx").alias("px"), F.col("ty").alias("py"))
    missing = missing.withColumns({"px": F.floor(F.col("tx") / 2).cast("long"), "py": F.floor(F.col("ty") / 2).cast("long")})
    missing = missing.join(parents, ["px", "py"], "left_semi")
    span = F.sequence(F.lit(0), F.lit(tile - 1))
    m = missing.select("*", F.explode(span).alias("ix")).select("*", F.explode(span).alias("iy"))

    def axis(t: str, i: str) -> tuple[Column, Column, Column]:
        q = F.pmod(F.col(t), F.lit(2)) * half
        if align == "corner":
            s = q + F.col(i) / 2.0
            a = F.floor(s)
            return a, F.least(a + 1, F.lit(tile - 1)), s - a
        s = (F.col(i) + 0.5) / 2.0 - 0.5
        a = F.floor(s)
        lo = lambda k: clamp(k, F.lit(0), F.lit(half - 1)) + q
        return lo(a), lo(a + 1), s - a

    (x0, x1, fx), (y0, y1, fy) = axis("tx", "ix"), axis("ty", "iy")

    def tap(x, y, w):
        return F.struct(
            (F.col("px") * tile + x).cast("long").alias("cx"), (F.col("py") * tile + y).cast("long").alias("cy"), w.alias("w")
        )

    taps = F.array(
        tap(x0, y0, (1 - fx) * (1 - fy)), tap(x1, y0, fx * (1 - fy)), tap(x0, y1, (1 - fx) * fy), tap(x1, y1, fx * fy)
    )
    gx, gy = F.col("tx") * tile + F.col("ix"), F.col("ty") * tile + F.col("iy")
    t = m.select(gx.alias("gx"), gy.alias("gy"), F.explode(taps).alias("t")).select("gx", "gy", "t.*")
    src = coarse.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), "v")
    return t.join(src.hint("merge"), ["cx", "cy"]).groupBy("gx", "gy").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def decode_field(pixels: DataFrame, u_range, v_range) -> DataFrame:
    """Colour channels to a vector field: red is u, green is v, alpha >= 128 is valid."""
    scale = lambda c, r: r[0] + F.col(c) / 255.0 * (r[1] - r[0])
    return pixels.select(
        "gx", "gy", scale("r", u_range).alias("u"), scale("g", v_range).alias("v"), (F.col("a") >= 128).alias("valid")
    )


def sample_uv(points: DataFrame, field: DataFrame, bbox, width: int, height: int, key) -> DataFrame:
    """Bilinear (u, v) and speed at points; null where the nearest pixel of the
    eroded validity mask is not set or the point is off the grid."""
    x0, y0, x1, y1 = bbox
    px = (F.col("lon") - x0) / (x1 - x0) * (width - 1)
    py = (y1 - F.col("lat")) / (y1 - y0) * (height - 1)
    p = points.withColumns({"_px": px, "_py": py})
    nx, ny = F.floor(F.col("_px") + 0.5).cast("long"), F.floor(F.col("_py") + 0.5).cast("long")
    p = p.withColumns({"gx": nx, "gy": ny})
    solid = erode(field.select("gx", "gy", "valid")).where("valid").select("gx", "gy")
    ok = p.join(solid, ["gx", "gy"], "left_semi")
    a, b = F.floor(F.col("_px")), F.floor(F.col("_py"))
    fx, fy = F.col("_px") - a, F.col("_py") - b
    cx = lambda k: F.least(a + k, F.lit(width - 1)).cast("long")
    cy = lambda k: F.least(b + k, F.lit(height - 1)).cast("long")
    taps = F.array(
        *[
            F.struct(cx(i).alias("gx"), cy(j).alias("gy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    t = ok.select(*_cols(key), F.explode(taps).alias("_t")).select(*_cols(key), "_t.*")
    uv = t.join(field.select("gx", "gy", "u", "v"), ["gx", "gy"]).groupBy(*_cols(key)).agg(
        F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v")
    )
    return points.select(*_cols(key)).join(uv, _cols(key), "left").withColumn("speed", F.hypot("u", "v"))


def regrid(target: DataFrame, source: DataFrame, z_target: int, z_source: int, how: str = "nearest") -> DataFrame:
    """Source values at the pixel centres of a target grid of another zoom."""
    k = 2.0 ** (z_source - z_target)
    x, y = (F.col("gx") + 0.5) * k, (F.col("gy") + 0.5) * k
    if how == "bilinear":
        return _bilinear_keyed(target, source, x, y)
    t = target.select("gx", "gy", F.floor(x).cast("long").alias("_x"), F.floor(y).cast("long").alias("_y"))
    s = source.select(F.col("gx").alias("_x"), F.col("gy").alias("_y"), "v")
    return t.join(s, ["_x", "_y"], "left").select("gx", "gy", F.coalesce("v", F.lit(0.0)).alias("v"))


def _bilinear_keyed(target, source, x, y):
    t = target.select(F.col("gx").alias("tgx"), F.col("gy").alias("tgy"), x.alias("_x"), y.alias("_y"))
    got = bilinear_at(t, source, ["tgx", "tgy"], F.col("_x"), F.col("_y"))
    return got.withColumnsRenamed({"tgx": "gx", "tgy": "gy"})


def base_elev(ring_vertices: DataFrame, cells: DataFrame, z: int, feature: str, vertex_key) -> DataFrame:
    """Lowest ground height under the vertices of each footprint."""
    s = sample_bilinear(ring_vertices, cells, z, vertex_key)
    return s.groupBy(feature).agg(F.min("v").alias("base_elev"))


def building_height(height, default: float) -> Column:
    """Positive finite height or the default."""
    h = F.col(height) if isinstance(height, str) else height
    return F.when(h.isNotNull() & ~F.isnan(h) & (h > 0), h).otherwise(F.lit(default))


def surface_elev(rings: DataFrame, cells: DataFrame, key, zooms, inset_cap: float, roll: int = 2, floor: float = -3.0, outward: Column | None = None) -> DataFrame:
    """Water height per vertex of open rings: sampled a little inside the ring
    (away from the centre where ``outward``), then a circular rolling minimum."""
    key = _cols(key)
    v = group_stats(by_seq(rings, key), key, {"_cx": F.avg("lon"), "_cy": F.avg("lat")}).drop(SLICE)
    dx, dy = F.col("_cx") - F.col("lon"), F.col("_cy") - F.col("lat")
    d = F.hypot(dx, dy)
    sign = F.lit(1.0) if outward is None else F.when(outward, F.lit(-1.0)).otherwise(F.lit(1.0))
    off = F.when(d > 0, sign * F.least(F.lit(inset_cap), 0.35 * d) / F.nullif(d, F.lit(0.0))).otherwise(F.lit(0.0))
    v = v.withColumns({"_lon": F.col("lon") + dx * off, "_lat": F.col("lat") + dy * off})
    inset = v.select(*key, "seq", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    return ring_roll_min(sample_nearest(inset, cells, zooms), key, "elev", roll, floor, "water_elev")


def scanline_spans(edges: DataFrame, key, row: str, row_y: Column) -> DataFrame:
    """Interior spans [x_in, x_out) per ring and row: sorted crossings of the row
    line, taken in pairs. ``edges`` are already matched to the rows they meet."""
    from pyspark.sql.window import Window

    key = _cols(key)
    y0, y1 = F.col("lat0"), F.col("lat1")
    e = edges.withColumn("_y", row_y).where((y0 > F.col("_y")) != (y1 > F.col("_y")))
    x = F.col("lon0") + (F.col("lon1") - F.col("lon0")) * (F.col("_y") - y0) / (y1 - y0)
    e = e.withColumn("_x", x)
    w = Window.partitionBy(*key, row).orderBy("_x")
    e = e.withColumns({"_i": F.row_number().over(w), "x_out": F.lead("_x").over(w)})
    return e.where((F.col("_i") % 2 == 1) & F.col("x_out").isNotNull()).select(*key, row, F.col("_x").alias("x_in"), "x_out")


def basin_levels(rings: DataFrame, cells: DataFrame, key, zooms, n: int = 32, p: float = 0.10, min_samples: int = 5, min_drop: float = 3.0) -> DataFrame:
    """Full level (median shore height) and floor level (a low percentile of the
    interior on an n x n lattice) of closed basin rings. Too few interior
    samples use the lowest shore height; the floor stays ``min_drop`` below full."""
    key = _cols(key)
    shore = sample_nearest(rings.select(*key, "seq", "lon", "lat"), cells, zooms)
    full = exact_median(shore, key, "elev", "full_el")
    low_shore = shore.groupBy(*key).agg(F.min("elev").alias("shore_min"))

    box = {"_x0": F.min("lon"), "_x1": F.max("lon"), "_y0": F.min("lat"), "_y1": F.max("lat")}
    e = ring_edges(rings, key, ("lon", "lat"), box)
    h, wd = F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0")
    row_of = lambda c: F.floor((F.col(c) - F.col("_y0")) / h * n - 0.5)
    lo = clamp(F.least(row_of("lat0"), row_of("lat1")), F.lit(0), F.lit(n - 1))
    hi = clamp(F.greatest(row_of("lat0"), row_of("lat1")) + 1, F.lit(0), F.lit(n - 1))
    e = e.where(h > 0).withColumn("j", F.explode(F.sequence(lo, hi)))
    row_y = F.col("_y0") + h * (F.col("j") + 0.5) / n
    spans = scanline_spans(e, [*key, "_x0", "_x1", "_y0", "_y1"], "j", row_y)
    col_of = lambda c: F.ceil((F.col(c) - F.col("_x0")) / wd * n - 0.5)
    a, b = F.greatest(col_of("x_in") - 1, F.lit(0)), F.least(col_of("x_out"), F.lit(n - 1))
    cells_in = spans.where(b >= a).withColumn("i", F.explode(F.sequence(a, b)))
    lon, lat = F.col("_x0") + wd * (F.col("i") + 0.5) / n, F.col("_y0") + h * (F.col("j") + 0.5) / n
    inside = cells_in.withColumns({"lon": lon, "lat": lat}).where((F.col("lon") >= F.col("x_in")) & (F.col("lon") < F.col("x_out")))
    interior = sample_nearest(inside.select(*key, "i", "j", "lon", "lat"), cells, zooms)
    count = interior.groupBy(*key).agg(F.count("*").alias("samples"))
    floor = percentile_rank(interior, key, "elev", p, "floor_el")
    out = full.join(low_shore, key).join(count, key, "left").join(floor, key, "left")
    fl = F.when(F.coalesce("samples", F.lit(0)) >= min_samples, F.col("floor_el")).otherwise(F.col("shore_min"))
    fl = F.least(fl.cast("double"), F.col("full_el"))
    fl = F.when(F.col("full_el") - fl < min_drop, F.col("full_el") - min_drop).otherwise(fl)
    return out.select(*key, F.rint("full_el").cast("long").alias("full_el"), F.rint(fl).cast("long").alias("floor_el"), F.coalesce("samples", F.lit(0)).alias("samples"))


def route_points(routes: DataFrame, n: int, standoff: float = 7.0, bow: float = 0.22) -> DataFrame:
    """``n`` samples of a quadratic arc from (ax, ay) to a point short of (bx, by)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    r = routes.withColumn("_d", F.hypot(dx, dy)).where(F.col("_d") > 0)
    r = r.withColumns({"_ux": dx / F.col("_d"), "_uy": dy / F.col("_d")})
    back = F.least(F.lit(standoff), F.col("_d") * 0.4)
    r = r.withColumns({"_ex": F.col("bx") - F.col("_ux") * back, "_ey": F.col("by") - F.col("_uy") * back})
    r = r.withColumns(
        {
            "_mx": (F.col("ax") + F.col("_ex")) / 2 - F.col("_uy") * F.col("_d") * bow,
            "_my": (F.col("ay") + F.col("_ey")) / 2 + F.col("_ux") * F.col("_d") * bow,
        }
    )
    r = r.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_t", F.col("seq") / float(n - 1))
    t, u = F.col("_t"), 1.0 - F.col("_t")
    arc = lambda a, m, b: u * u * F.col(a) + 2.0 * u * t * F.col(m) + t * t * F.col(b)
    return r.select("route_id", F.col("seq").cast("long").alias("seq"), arc("ax", "_mx", "_ex").alias("x"), arc("ay", "_my", "_ey").alias("y"))


def route_profile(routes: DataFrame, cells: DataFrame, n: int = 240, altitude: float = 0.0, radius: int = 10) -> DataFrame:
    """Ground, smoothed clearance envelope and flight height along each route."""
    pts = route_points(routes, n)
    g = bilinear_at(pts, cells, ["route_id", "seq"], F.col("x"), F.col("y")).withColumnRenamed("v", "ground")
    p = profile_envelope(g, "route_id", radius)
    return p.withColumn("flight", F.col("smooth") + altitude).withColumn("clearance", F.col("flight") - F.col("ground"))


def clearance(profile: DataFrame, minimum: float) -> DataFrame:
    return profile.groupBy("route_id").agg(
        F.min("clearance").alias("min_clearance"), F.count_if(F.col("clearance") < minimum).alias("violations")
    )
