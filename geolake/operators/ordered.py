"""Ordered per-key work that survives hot keys.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task. When
a key holds a large share of all rows that task becomes the job. Here a key over
``limit`` rows is cut into consecutive slices of its order (a caller-given
expression that never decreases along the order); each slice is a partition of
its own, and one summary row per slice carries values across slice borders.
Keys under the limit have no slice (null) and pay nothing extra; a slice may have
any number, negative ones and 0 included. The list of hot keys
only decides the layout, never the result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

ROW_LIMIT = 1_000_000
MAX_INLINE_HOT = 2_000
SLICE = "_slice"

ROWS_HELD = 500_000  # rows a task puts in order

# a key at the limit is expected this often in the layout probe
PROBE_HITS = 100

_hot_memo: dict[tuple, list] = {}


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks in number to the rows, so that none holds more of them on larger tables."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_HELD + 1)


def note_tasks(df: DataFrame, col: str, tasks: int) -> DataFrame:
    """Note on ``col`` in how many tasks these rows are dealt, for the steps after."""
    return df.withMetadata(col, {**df.schema[col].metadata, "tasks": tasks})


def deal(df: DataFrame, like: DataFrame, col: str, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` in the number of tasks noted on ``col`` of ``like``; left to
    the optimizer without a note."""
    tasks = like.schema[col].metadata.get("tasks")
    return df if tasks is None else df.repartition(tasks, *by)


def _find_hot(df: DataFrame, keys: list[str], limit: int) -> list[list]:
    """Keys with about ``limit`` rows or more: at most 2 * rows / limit of them.

    Above a limit of 100 rows the key column is probed by a fixed-seed sample in
    which such a key still shows about 100 times, so the probe shuffles one row
    in limit/100. The list only picks the layout: a key it misses is ordered in
    one partition, and no row is ever left out of a result."""
    token = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if token not in _hot_memo:
        part = min(1.0, PROBE_HITS / limit)
        probe = df.select(*keys) if part == 1.0 else df.select(*keys).sample(part, seed=7)
        bar = limit if part == 1.0 else PROBE_HITS / 2
        counted = probe.groupBy(*keys).count().where(F.col("count") > bar).select(*keys)
        _hot_memo[token] = [list(r) for r in counted.limit(MAX_INLINE_HOT + 1).collect()]
    return _hot_memo[token]


def _known(df: DataFrame, keys: list[str]) -> list | None:
    """Layout knowledge carried by the key columns' metadata. It survives
    selects, joins, windows and renames; a key that is small alone is small in
    every finer grouping too."""
    meta = {k: df.schema[k].metadata for k in keys}
    if len(keys) == 1:
        got = meta[keys[0]].get("hot_keys")
    elif any(m.get("hot_keys") == "[]" for m in meta.values()):
        return []
    else:
        got = meta[keys[0]].get("hot_" + "|".join(keys))
    return None if got is None else json.loads(got)


def know_layout(df: DataFrame, keys, limit: int | None = None) -> DataFrame:
    """Look for hot keys once and note the answer on the key column, for every
    ordered step on this frame and on frames derived from it."""
    keys = _cols(keys)
    if _known(df, keys) is not None:
        return df
    hot = _find_hot(df, keys, limit or ROW_LIMIT)
    name = "hot_keys" if len(keys) == 1 else "hot_" + "|".join(keys)
    return df.withMetadata(keys[0], {**df.schema[keys[0]].metadata, name: json.dumps(hot, default=str)})


def hot_slices(df: DataFrame, keys, slice_expr: Column, limit: int | None = None) -> DataFrame:
    """Add ``_slice``: null for ordinary keys, ``slice_expr`` for hot ones.
    Without any hot key no column is added: the ordered operators then use one
    plain window."""
    keys = _cols(keys)
    limit = limit or ROW_LIMIT
    df = know_layout(df, keys, limit)
    hot = _known(df, keys)
    if not hot:
        return df
    if len(hot) <= MAX_INLINE_HOT:
        if len(keys) == 1:
            is_hot = F.col(keys[0]).isin([r[0] for r in hot])
        else:
            is_hot = reduce(
                lambda a, b: a | b,
                [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(x)) for k, x in zip(keys, r)]) for r in hot],
            )
        return df.withColumn(SLICE, F.when(is_hot, slice_expr.cast("long")))
    counted = df.groupBy(*keys).count().where(F.col("count") > limit)
    marked = counted.select(*keys, F.lit(True).alias("_hot"))
    return (
        df.join(marked, keys, "left")
        .withColumn(SLICE, F.when(F.col("_hot"), slice_expr.cast("long")))
        .drop("_hot")
    )


def range_slices(df: DataFrame, keys, order: str, parts: int = 64) -> DataFrame:
    """Add ``_slice`` to every row: ranges of ``order`` with about as many rows each,
    cut at its quantiles over all rows. Signed, sparse or hashed numbers are cut as
    evenly as consecutive ones, and a crowded key is met in up to ``parts`` pieces."""
    marks = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(m) for m in sorted(set(marks))]), lambda m: m <= F.col(order))) if marks else F.lit(0)
    return df.withColumn(SLICE, at.cast("long"))


def group_stats(df: DataFrame, keys, aggs: dict[str, Column], sliced: bool | None = None) -> DataFrame:
    """Every row with aggregates of its whole key. Ordinary keys share the
    shuffle of the ordered windows around this step; with hot keys the aggregate
    is computed apart (pre-aggregated before its shuffle) and joined."""
    keys = _cols(keys)
    if SLICE not in df.columns and not sliced:
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def shift(df: DataFrame, keys, order, exprs: dict[str, tuple[str | Column, int]]) -> DataFrame:
    """``exprs`` maps an output name to (expression, offset); offset -1 is the
    row before, +1 the row after. Needs the ``_slice`` column of
    :func:`hot_slices`; without it every key is taken to be small."""
    keys, order = _cols(keys), _cols(order)
    if SLICE not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select(
            "*", *[(F.lag if o < 0 else F.lead)(e, abs(o)).over(w).alias(n) for n, (e, o) in exprs.items()]
        )
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    sides = sorted({o for _, o in exprs.values()})
    packed = df
    for o in sides:
        fields = [F.expr(e).alias(n) if isinstance(e, str) else e.alias(n) for n, (e, oo) in exprs.items() if oo == o]
        packed = packed.withColumn(f"_p{o + 1}", F.struct(*fields))
    inner = packed.select(
        "*", *[(F.lag if o < 0 else F.lead)(f"_p{o + 1}").over(w).alias(f"_n{o + 1}") for o in sides]
    )
    # one row per slice of a hot key: what its neighbours need to see
    pos = F.struct(*order) if len(order) > 1 else F.col(order[0])
    hot = packed.where(F.col(SLICE).isNotNull())
    edge = hot.groupBy(*keys, SLICE).agg(
        *[(F.max_by if o < 0 else F.min_by)(f"_p{o + 1}", pos).alias(f"_e{o + 1}") for o in sides]
    )
    ws = Window.partitionBy(*keys).orderBy(SLICE)
    edge = edge.select(
        *keys,
        SLICE,
        *[(F.lag if o < 0 else F.lead)(f"_e{o + 1}").over(ws).alias(f"_c{o + 1}") for o in sides],
    )
    out = inner.join(edge, [*keys, SLICE], "left")
    for o in sides:
        got = F.coalesce(F.col(f"_n{o + 1}"), F.col(f"_c{o + 1}"))
        for n, (_, oo) in exprs.items():
            if oo == o:
                out = out.withColumn(n, got[n])
    return out.drop(*[f"_{a}{o + 1}" for a in "pnc" for o in sides])


def running_sum(df: DataFrame, keys, order, exprs: dict[str, str | Column]) -> DataFrame:
    """Inclusive running totals per key in order."""
    keys, order = _cols(keys), _cols(order)
    frame = (Window.unboundedPreceding, 0)
    col = {n: (F.expr(e) if isinstance(e, str) else e) for n, e in exprs.items()}
    if SLICE not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in col.items()])
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(*frame)
    inner = df.select("*", *[F.sum(e).over(w).alias(n) for n, e in col.items()])
    ws = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(*[F.sum(e).alias(f"_t_{n}") for n, e in col.items()])
        .select(*keys, SLICE, *[F.sum(f"_t_{n}").over(ws).alias(f"_b_{n}") for n in col])
    )
    out = inner.join(totals, [*keys, SLICE], "left")
    for n in col:
        out = out.withColumn(n, F.when(F.col(f"_b_{n}").isNotNull(), F.col(n) + F.col(f"_b_{n}")).otherwise(F.col(n)))
    return out.drop(*[f"_b_{n}" for n in col])


def row_number(df: DataFrame, keys, order, name: str = "rn") -> DataFrame:
    """1-based position per key."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("long")})


CUTS = 200


def nth_values(df: DataFrame, keys, value: str, ranks: DataFrame, limit: int | None = None) -> DataFrame:
    """Values at given 0-based ranks of each key's sorted values, exactly.

    ``ranks`` holds ``keys`` and ``rank``. While a key has more than ``limit`` rows around
    a rank, its quantiles are sketched (with a guaranteed error) and the rank is looked
    for between the two that enclose it, about a fiftieth of the rows a level, whatever
    the scale of the values; the rows below are counted exactly. What is left is counted
    by value. Equal values are one row from the start, so they never crowd a window.
    """
    keys = _cols(keys)
    limit = limit or ROW_LIMIT
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    want = ranks.select(*keys, F.col("rank").cast("long").alias("rank")).distinct()
    want = want.withColumns({"_left": F.col("rank"), "_a": F.lit(None).cast(df.schema[value].dataType), "_b": F.lit(None).cast(df.schema[value].dataType)})
    around = (F.col("_a").isNull() | (F.col(value) >= F.col("_a"))) & (F.col("_b").isNull() | (F.col(value) <= F.col("_b")))
    largest, total = (x or 0 for x in rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first())
    tasks, whole = tasks_for(df, total), largest <= limit
    while largest > limit:
        near = rows.join(want, keys).where(around)
        marks = near.groupBy(*keys, "rank").agg(
            F.first("_left").alias("_left"), F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.count("*").alias("_n"),
            F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 10_000).alias("_q"),
        )
        at = F.floor(F.col("_left") / F.col("_n") * CUTS).cast("int")
        # one quantile of room on either side is far more than the sketch can be off
        new = {"_c": F.coalesce(F.get("_q", at - 2), "_a"), "_d": F.coalesce(F.get("_q", at + 1), "_b")}
        marks = cut(marks.withColumns(new).select(*keys, "rank", "_left", "_a", "_b", "_c", "_d"))
        near = rows.join(marks, keys).where(around)
        inside = (F.col("_c").isNull() | (F.col(value) >= F.col("_c"))) & (F.col("_d").isNull() | (F.col(value) <= F.col("_d")))
        below = F.count_if(F.col("_c").isNotNull() & (F.col(value) < F.col("_c")))
        got = near.groupBy(*keys, "rank").agg(below.alias("_under"), F.count_if(inside).alias("_n"), *[F.first(c).alias(c) for c in ("_left", "_c", "_d")])
        got = cut(got.withColumn("_left", F.col("_left") - F.col("_under")))
        want = got.select(*keys, "rank", "_left", F.col("_c").alias("_a"), F.col("_d").alias("_b"))
        # only different values crowd a window
        before, largest = largest, got.where(F.col("_c").isNull() | F.col("_d").isNull() | (F.col("_c") < F.col("_d"))).agg(F.max("_n")).first()[0] or 0
        if largest > before / 2:
            break  # a few values stand very often
    # small bytes unpack to much memory in order, so tasks follow the rows
    # and the ranks are the small side, whatever the files' sizes make of it
    near = rows.repartition(tasks, *keys).join(want.repartition(tasks, *keys).hint("shuffle_hash"), keys) if whole else rows.join(want, keys)
    fine = near.where(around).groupBy(*keys, "rank", "_left", value).agg(F.count("*").alias("_n"))
    fine = fine if whole else fine.repartition(tasks, *keys, "rank")
    upto = Window.partitionBy(*keys, "rank").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("_hi", F.sum("_n").over(upto))
    return fine.where((F.col("_left") < F.col("_hi")) & (F.col("_left") >= F.col("_hi") - F.col("_n"))).select(*keys, "rank", value)
