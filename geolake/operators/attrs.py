"""Attribute cleaning: projection, mapping, filters, encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c
from .ordered import _cols

# A lookup above this many entries belongs in a table, not in a literal.
MAX_LITERAL = 1000


def _blank(c) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def first_filled(*cols, default=None) -> Column:
    """First non-blank of the columns, else the default."""
    parts = [_blank(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def _literal_map(mapping: Mapping) -> Column:
    if len(mapping) > MAX_LITERAL:
        raise ValueError("a mapping of this size is a table: use classify_by")
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def classify(col, mapping: Mapping, default=None) -> Column:
    """Mapped value with a default."""
    got = F.try_element_at(_literal_map(mapping), _c(col))
    return got if default is None else F.coalesce(got, F.lit(default))


def classify_by(df: DataFrame, col: str, mapping: DataFrame, out: str, default=None) -> DataFrame:
    """:func:`classify` by a table of any size: its first column is the source value, its
    second the class. Of several classes for one value the smallest counts; null values
    get the default. Whether the table is broadcast is the optimizer's choice by its size."""
    source, target = mapping.columns[:2]
    one = mapping.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("_from")).agg(F.min(target).alias("_to"))
    got = F.col("_to") if default is None else F.coalesce("_to", F.lit(default))
    return df.join(one, df[col] == F.col("_from"), "left").withColumn(out, got).drop("_from", "_to")


def project_attrs(df: DataFrame, spec: Mapping[str, tuple[Sequence[str], object]]) -> DataFrame:
    """``spec`` maps an output column to (source columns in order, default)."""
    return df.withColumns({out: first_filled(*src, default=dflt) for out, (src, dflt) in spec.items()})


def map_enum(df: DataFrame, col: str, mapping: Mapping, out: str = "cls") -> tuple[DataFrame, DataFrame]:
    """(kept rows with ``out``, counts of the source values that mapped to nothing).
    The mapping is a joined table of any size."""
    keys = df.sparkSession.createDataFrame(list(mapping.items()) or [(None, None)], f"_from {df.schema[col].dataType.simpleString()}, {out} " + ("string" if any(isinstance(v, str) for v in mapping.values()) else "int"))
    tagged = df.join(keys, F.col(col) == F.col("_from"), "left").drop("_from")
    kept = tagged.where(F.col(out).isNotNull())
    audit = tagged.where(F.col(out).isNull()).groupBy(col).agg(F.count("*").alias("dropped"))
    return kept, audit


def allow(df: DataFrame, col: str, values: Sequence | None = None, exclude: Sequence | None = None, numeric: bool = False):
    """Keep listed values, drop excluded ones, optionally require an integer."""
    out = df
    if values is not None:
        out = out.where(F.col(col).isin(list(values)))
    if exclude is not None:
        out = out.where(~F.col(col).isin(list(exclude)))
    if numeric:
        out = out.where(F.trim(F.col(col)).try_cast("int").isNotNull())
    return out


def keep_rule(df: DataFrame, *rules: Column | str) -> DataFrame:
    """Rows for which any rule is true."""
    any_of = F.lit(False)
    for r in rules:
        any_of = any_of | F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(False))
    return df.where(any_of)


def keep_union(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count per rule plus the total). A row counts for the
    first rule it meets."""
    first = F.coalesce(*[F.when(F.coalesce(F.expr(e), F.lit(False)), F.lit(n)) for n, e in rules.items()])
    tagged = df.withColumn("kept_by", first)
    kept = tagged.where(F.col("kept_by").isNotNull())
    counts = tagged.agg(
        *[F.count_if(F.col("kept_by") == n).alias(f"kept_{n}") for n in rules],
        F.count("kept_by").alias("kept_total"),
        F.count("*").alias("total"),
    )
    return kept, counts


def dict_encode(df: DataFrame, col: str, order: str, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """Number the distinct values of ``col`` by first appearance in ``order``.

    The dictionary is built from one pre-aggregated row per value. Codes come
    from a two-level count (per order range, then inside the range), so a very
    large dictionary is never numbered in one task.
    """
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_first"))
    words = number_rows(firsts, "_first", code).select(col, code)
    return df.join(words, col, "left"), words


def number_rows(df: DataFrame, order: str, out: str, width: int = 65536) -> DataFrame:
    """0-based global position by a unique numeric ``order`` column."""
    from pyspark.sql.window import Window

    b = df.withColumn("_blk", F.floor(F.col(order) / width).cast("long"))
    w = Window.partitionBy("_blk").orderBy(order)
    sizes = b.groupBy("_blk").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_blk",
        (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
    )
    return (
        b.withColumn("_rn", F.row_number().over(w))
        .join(before, "_blk")
        .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("long"))
        .drop("_blk", "_rn", "_base")
    )


def drop_malformed(df: DataFrame, cols) -> DataFrame:
    """Rows whose text columns all read as numbers, with the numbers in place."""
    out = df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in _cols(cols)})
    return out.dropna(subset=_cols(cols))
