"""Attribute and table joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_m, in_bbox
from ..functions.shape import clamp
from .ordered import _cols


def gap_fill(primary: DataFrame, secondary: DataFrame, key) -> DataFrame:
    """All primary rows plus the secondary rows whose key is absent. The first
    secondary row per key (lowest ``feature_id``) is taken."""
    key = _cols(key)
    extra = secondary.join(primary.select(*key).distinct(), key, "left_anti")
    cols = [c for c in extra.columns if c not in key]
    rank = F.struct("feature_id") if "feature_id" in cols else F.struct(*cols)
    one = extra.groupBy(*key).agg(F.min_by(F.struct(*cols), rank).alias("_r")).select(*key, "_r.*")
    return primary.unionByName(one, allowMissingColumns=True)


def supplement(first: DataFrame, second: DataFrame, group) -> DataFrame:
    """Second-source rows only for groups the first source lacks."""
    group = _cols(group)
    return first.unionByName(second.join(first.select(*group).distinct(), group, "left_anti"), allowMissingColumns=True)


def resolve_names(df: DataFrame, dim: DataFrame, on: str, name: str, drop_unmatched: bool = False) -> DataFrame:
    """Name of an id; unmatched ids stand for themselves or are dropped."""
    if drop_unmatched:
        return df.join(dim.select(on, name), on)
    got = df.join(dim.select(on, F.col(name).alias("_name")), on, "left")
    return got.withColumn(name, F.coalesce("_name", F.col(on).cast("string"))).drop("_name")


def unmatched_count(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    return df.join(dim.select(on), on, "left_anti").agg(F.count("*").alias("dropped"))


def first_attr(dim: DataFrame, key: str, val: str, order: str, out: str) -> DataFrame:
    """First value per key that is neither null nor zero."""
    return dim.where(F.col(val).isNotNull() & (F.col(val) != 0)).groupBy(key).agg(F.min_by(val, order).alias(out))


def with_status(df: DataFrame, status: DataFrame, key: str, pct: str, default: float = 1.0, out: str = "ratio") -> DataFrame:
    """Latest status percentage as a 0..1 ratio, or the default."""
    s = status.select(key, clamp(F.col(pct) / 100.0, 0.0, 1.0).alias("_r"))
    return df.join(s, key, "left").withColumn(out, F.coalesce("_r", F.lit(default))).drop("_r")


def coord_conflicts(a: DataFrame, b: DataFrame, key: str, limit_m: float) -> DataFrame:
    """Keys whose two positions differ by more than ``limit_m`` metres. Exact
    copies within a source are folded first."""
    left = a.groupBy(key, "lon", "lat").agg(F.count("*").alias("n_a"))
    right = b.groupBy(key, F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")).agg(F.count("*").alias("n_b"))
    d = haversine_m("lon", "lat", "lon_b", "lat_b")
    return left.join(right, key).withColumn("dist_m", d).where(F.col("dist_m") > limit_m)


def grid_or(a: DataFrame, b: DataFrame, keys=("gx", "gy"), col: str = "m") -> DataFrame:
    """Cell-wise OR of two masks; a missing cell counts as false."""
    keys = _cols(keys)
    bs = b.select(*keys, F.col(col).alias("_b"))
    no = F.lit(False)
    both = a.select(*keys, F.col(col).alias("_a")).join(bs, keys, "full")
    return both.select(*keys, (F.coalesce("_a", no) | F.coalesce("_b", no)).alias(col))


def dedupe_sources(fine: DataFrame, coarse: DataFrame, include, windows: Mapping[str, tuple], main: tuple, main_min: float, min_area: float):
    """(kept union with ``source``, coarse rows with the reason they were
    dropped). Rows carry lon, lat (centre) and area. Rules in order: too small,
    outside ``include``, covered by a fine ``window``, a big body inside ``main``."""
    inside_window = F.lit(False)
    for box in windows.values():
        inside_window = inside_window | in_bbox("lon", "lat", box)
    reason = (
        F.when(F.col("area") < min_area, "small")
        .when(~in_bbox("lon", "lat", include), "outside")
        .when(inside_window, "duplicate")
        .when(in_bbox("lon", "lat", main) & (F.col("area") > main_min), "main")
        .otherwise("kept")
    )
    tagged = coarse.withColumn("reason", reason)
    good = fine.where(F.col("area") >= min_area).withColumn("source", F.lit("fine"))
    kept = good.unionByName(tagged.where("reason = 'kept'").drop("reason").withColumn("source", F.lit("coarse")))
    return kept, tagged


def union_sources(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """All sources by column name, each row tagged with its source."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def recent_past_days(df: DataFrame, day: str, n: int, today) -> DataFrame:
    """The last ``n`` distinct days before ``today``, earliest first, with ``rank``
    (1 for the earliest). At most ``n`` rows meet in the window."""
    past = df.where(F.col(day) < F.lit(today)).select(day).distinct().orderBy(F.desc(day)).limit(n)
    return past.withColumn("rank", F.row_number().over(Window.orderBy(day))).orderBy(day)


def read_day(snapshot: DataFrame, raw: DataFrame, day: str, clean) -> DataFrame:
    """Snapshot rows where a day has them; the cleaned raw feed elsewhere."""
    have = snapshot.select(day).distinct()
    return snapshot.unionByName(clean(raw.join(have, day, "left_anti")), allowMissingColumns=True)


def tile_footprint(df: DataFrame, pad: int = 1) -> DataFrame:
    """All tiles between (tx0, ty0) and (tx1, ty1), padded."""
    xs = F.explode(F.sequence(F.col("tx0") - pad, F.col("tx1") + pad)).alias("tx")
    ys = F.explode(F.sequence(F.col("ty0") - pad, F.col("ty1") + pad)).alias("ty")
    return df.select("*", xs).select("*", ys)


def dirty_tiles(tiles: DataFrame, changed: DataFrame | None, pad: int = 1) -> DataFrame:
    """Tiles whose padded height footprint meets a changed tile. ``None`` means
    "unknown" and selects every tile."""
    if changed is None:
        return tiles
    keys = tiles.columns
    return tile_footprint(tiles, pad).join(changed.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi").select(*keys).distinct()
