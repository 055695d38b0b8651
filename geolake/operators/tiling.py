"""Tile covers and level-of-detail selection."""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import projection, tile_center_world, world_to_pixel
from .attrs import classify
from .ordered import SLICE, range_slices, row_number
from .spatial import assign_tiles
from .windows import to_segments


def _tiles_around(centers: DataFrame, r: float, proj: SimpleNamespace) -> DataFrame:
    """Tiles whose centre is within ``r`` world units; d2 is the squared distance."""
    px, py = world_to_pixel("x", "z", proj)
    reach = math.ceil(r / proj.tile_size) + 1
    span = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    t = centers.withColumns({"_tx": F.floor(px / 256).cast("long"), "_ty": F.floor(py / 256).cast("long")})
    t = t.select("*", F.explode(span).alias("_i")).select("*", F.explode(span).alias("_j"))
    t = t.withColumns({"tx": F.col("_tx") + F.col("_i"), "ty": F.col("_ty") + F.col("_j")})
    n = 2**proj.zoom
    t = t.where((F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") < n) & (F.col("ty") < n))
    cx, cz = tile_center_world("tx", "ty", proj)
    d2 = (cx - F.col("x")) * (cx - F.col("x")) + (cz - F.col("z")) * (cz - F.col("z"))
    return t.withColumn("d2", d2).where(F.col("d2") <= r * r).select(*centers.columns, "tx", "ty", "d2")


def disk_cover(centers: DataFrame, r: float, proj: SimpleNamespace) -> DataFrame:
    """Tiles of the projection's zoom around each centre (center_id, x, z)."""
    return _tiles_around(centers, r, proj).withColumn("zoom", F.lit(proj.zoom))


def lod_partition(centers: DataFrame, r: float, proj: SimpleNamespace, inner: float = 0.55, min_zoom: int = 10, coverage: tuple | None = None) -> DataFrame:
    """Two rings of tiles: an outer tile gives way to its four children exactly
    when all four lie within ``inner * r``. ``coverage`` is an outer-tile range
    (tx0, tx1, ty0, ty1)."""
    oz = max(min_zoom, proj.zoom - 1)
    outer = projection(proj.lat0, proj.lon0, oz)
    t = _tiles_around(centers, r, outer)
    if coverage is not None:
        t = t.where(F.col("tx").between(*coverage[:2]) & F.col("ty").between(*coverage[2:]))
    if oz == proj.zoom:
        return t.withColumn("zoom", F.lit(oz))
    r1 = r * inner

    def child(i, j):
        tx, ty = F.col("tx") * 2 + i, F.col("ty") * 2 + j
        cx, cz = tile_center_world(tx, ty, proj)
        d2 = (cx - F.col("x")) * (cx - F.col("x")) + (cz - F.col("z")) * (cz - F.col("z"))
        return F.struct(F.lit(proj.zoom).alias("zoom"), tx.alias("tx"), ty.alias("ty"), d2.alias("d2"))

    kids = F.array(*[child(i, j) for j in (0, 1) for i in (0, 1)])
    own = F.array(F.struct(F.lit(oz).alias("zoom"), "tx", "ty", "d2"))
    all_in = F.forall(kids, lambda k: k["d2"] <= r1 * r1)
    t = t.withColumn("_t", F.explode(F.when(all_in, kids).otherwise(own)))
    return t.select(*centers.columns, "_t.*")


def covered(stale: DataFrame, desired: DataFrame, live: DataFrame, tz: int, oz: int) -> DataFrame:
    """For stale tiles (zoom, tx, ty): is every wanted tile over its footprint
    live? A footprint is walked in outer tiles; an outer tile that is not wanted
    itself stands for its wanted children."""
    span = lambda t: F.when(
        F.col("zoom") >= oz, F.array(F.floor(F.col(t) / F.pow(F.lit(2.0), F.col("zoom") - oz)).cast("long"))
    ).otherwise(
        F.sequence(
            (F.col(t) * F.pow(F.lit(2.0), oz - F.col("zoom"))).cast("long"),
            ((F.col(t) + 1) * F.pow(F.lit(2.0), oz - F.col("zoom")) - 1).cast("long"),
        )
    )
    key = ["zoom", "tx", "ty"]
    foot = stale.select(*key).distinct().select(*key, F.explode(span("tx")).alias("fx"), span("ty").alias("_ys")).select(*key, "fx", F.explode("_ys").alias("fy"))
    want = desired.select(*key).distinct()
    missing = want.join(live.select(*key).distinct(), key, "left_anti")
    as_outer = lambda df: df.where(F.col("zoom") == oz).select(F.col("tx").alias("fx"), F.col("ty").alias("fy"))
    bad = as_outer(missing)
    if tz != oz:
        kids = missing.where(F.col("zoom") == tz).select(F.floor(F.col("tx") / 2).alias("fx"), F.floor(F.col("ty") / 2).alias("fy"))
        bad = bad.unionByName(kids.join(as_outer(want), ["fx", "fy"], "left_anti"))
    open_ = foot.join(bad.distinct(), ["fx", "fy"], "left_semi").select(*key).distinct()
    return stale.join(open_.withColumn("_open", F.lit(True)), key, "left").withColumn("covered", F.col("_open").isNull()).drop("_open")


def tile_features(vertices: DataFrame, z: int, cls: str, mapping: dict, default: str, key: str = "part_id") -> DataFrame:
    """Segments per tile with their style bucket and the feature's 0-based index
    inside the tile."""
    s = to_segments(vertices, key)
    t = assign_tiles(s, z, "segment").withColumn("bucket", classify(cls, mapping, default))
    feats = t.select("tx", "ty", key).distinct()
    # numbered in ranges of the feature key, so a crowded tile is never one task
    feats = row_number(range_slices(feats, ["tx", "ty"], key), ["tx", "ty"], key, "_rn").drop(SLICE)
    return t.join(feats, ["tx", "ty", key]).withColumn("feature_index", F.col("_rn") - 1).drop("_rn")


def tile_to_world(df: DataFrame, proj: SimpleNamespace, extent: int = 4096) -> DataFrame:
    """World position of tile-local coordinates (x, y) of tile (tx, ty)."""
    cx, cz = tile_center_world("tx", "ty", proj)
    s = proj.tile_size / extent
    return df.withColumns({"wx": cx + (F.col("x") - extent / 2) * s, "wz": cz + (F.col("y") - extent / 2) * s})
