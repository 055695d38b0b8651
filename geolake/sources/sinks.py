"""Sinks: layers with totals, stable writes, immutable days, grids, point sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _try_read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException:
        return None


def content_mark(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of all columns."""
    cols = sorted(df.columns)
    return df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")
    )


def write_layer(df: DataFrame, path: str, totals: dict[str, Column], partition_by: list[str] | None = None) -> None:
    """Records under ``path/data`` and a one-row table of totals under
    ``path/meta``, stamped with the time of writing."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    meta = written.agg(*[c.alias(n) for n, c in totals.items()]).withColumn("generated", F.current_timestamp())
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_layer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/meta")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a new version only when the content differs from the current one.
    Each version adds a numbered row to the list of versions after its data is
    complete, and nothing is ever replaced: a lost job leaves the old version in place."""
    spark = df.sparkSession
    mark = content_mark(df).first()
    now = _try_read(spark, f"{path}/versions")
    row = now.orderBy(F.desc("number")).first() if now is not None else None
    if row is not None and (row["rows"], row["hash"]) == (mark["rows"], mark["hash"]):
        return False
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    number = row["number"] + 1 if row is not None else 1
    head = spark.createDataFrame([(number, version, mark["rows"], mark["hash"])], "number long, version string, rows long, hash string")
    head.withColumn("generated", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return True


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/versions").orderBy(F.desc("number")).first()["version"]
    return spark.read.parquet(f"{path}/version={version}")


def bake_days(df: DataFrame, day: str, path: str, force: bool = False) -> DataFrame:
    """Write the days that are not stored yet (all of them with ``force``) and
    return the list of days written. Stored days are never touched otherwise."""
    spark = df.sparkSession
    todo = df
    have = None if force else _try_read(spark, path)
    if have is not None:
        todo = df.join(have.select(F.col(day).cast(df.schema[day].dataType)).distinct(), day, "left_anti")
    days = todo.select(day).distinct()
    found = [r[0] for r in days.collect()]  # one value per day
    if found:
        # pieces follow the size of a day: small days one file, large ones several
        todo.hint("rebalance", day).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(day).parquet(path)
    return spark.createDataFrame([(d,) for d in found], f"{day} {df.schema[day].dataType.simpleString()}")


def write_grid(cells: DataFrame, path: str, grid_id: str, z: int, params: dict[str, str], tile: int = 256) -> None:
    """Cells in folders per tile column, with a one-row sidecar of extent,
    geographic bounds, parameters and statistics."""
    from ..functions.geo import pixel_to_lonlat

    out = cells.withColumn("tx", F.floor(F.col("gx") / tile).cast("long"))
    out.repartition("tx", F.floor(F.col("gy") / tile)).write.mode("overwrite").partitionBy("tx").parquet(f"{path}/cells")
    g = cells.agg(
        F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"),
        F.count("*").alias("n"), F.max("v").alias("max_v"), (F.count_if(F.col("v") != 0) / F.count("*") * 100).alias("nonzero_pct"),
    )
    lon0, lat1 = pixel_to_lonlat("x0", "y0", z)
    lon1, lat0 = pixel_to_lonlat(F.col("x1") + 1, F.col("y1") + 1, z)
    meta = g.select(
        F.lit(grid_id).alias("grid_id"), F.lit(z).alias("zoom"),
        (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"),
        lon0.alias("min_lon"), lon1.alias("max_lon"), lat0.alias("min_lat"), lat1.alias("max_lat"),
        "n", "max_v", "nonzero_pct", F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).alias("params"),
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/grid_meta")


# -------------------------------------------------------------------- point sets
def upsert_set(points: DataFrame, set_id: str, df: DataFrame | None = None, color: str | None = None, visible: bool | None = None) -> DataFrame:
    """Replace a set's points, or with ``df`` None only patch colour and
    visibility of the stored ones."""
    mine = F.col("set_id") == set_id
    if df is None:
        out = points
        if color is not None:
            out = out.withColumn("color", F.when(mine, F.lit(color)).otherwise(F.col("color")))
        if visible is not None:
            out = out.withColumn("visible", F.when(mine, F.lit(visible)).otherwise(F.col("visible")))
        return out
    new = df.withColumns(
        {"set_id": F.lit(set_id), "color": F.lit(color if color is not None else "#1c1c1c"), "visible": F.lit(True if visible is None else visible)}
    )
    return points.where(~mine).unionByName(new.select(*points.columns))


def remove_set(points: DataFrame, set_id: str) -> DataFrame:
    return points.where(F.col("set_id") != set_id)


def list_sets(points: DataFrame) -> DataFrame:
    return points.groupBy("set_id").agg(F.count("*").alias("n"), F.min("color").alias("color"), F.bool_and("visible").alias("visible"))


def store_set(df: DataFrame, path: str) -> None:
    """Write set partitions in place; sets not in ``df`` stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(path)
