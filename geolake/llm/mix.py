"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Each document has a 48-bit hash of its id. Token sums by source and leading hash
bits show in which bucket a source's budget ends; only that bucket is looked at
again with the next bits, until one hash value is left. The documents below the
threshold are taken: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import boxed, unboxed

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 4


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash48(doc_id: str = "doc_id") -> Column:
    """The first 48 bits of the id's MD5; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """_src, source_size, target of each source: the total shared by weight, no
    target above ``cap`` times its source, the excess shared among the others.

    Sorted by the factor at which a source reaches its cap, the capped sources come
    first; each row asks what factor is left for the rows after it. One row a source
    meets in these windows.
    """
    s = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    ranked = Window.orderBy(F.col("_src").isNull(), "_src")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", w).withColumn("_cap", cap * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").isNull(), "_src")
    upto, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(upto), F.lit(0))
    s = s.withColumn("_share", left / F.sum("_w").over(rest))
    # the first source that does not reach its cap fixes the factor of all after it
    free = F.when(F.col("_share") * F.col("_w") <= F.col("_cap"), F.col("_share"))
    s = s.withColumn("_factor", F.first(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_factor").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_factor") * F.col("_w"))
    return s.select("_src", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with _base (copies of every document) and _lim (documents whose hash
    is below it come once more)."""
    n = F.col("source_size")
    g = goal.withColumn("_base", F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0).cast("long"))
    g = g.withColumn("_left", F.col("target") - F.col("_base") * n).withColumn("_at", F.lit(0).cast("long")).withColumn("_done", F.col("_left") <= 0)
    for level in range(1, LEVELS + 1):
        g = cut(g)  # a few rows; each level reads them twice
        shift = BITS * (LEVELS - level)
        head = F.shiftright("_hash", shift)
        inside = sizes.join(g.where("not _done").select(F.col("_src").alias("_s"), "_at"), F.col("_src").eqNullSafe(F.col("_s")))
        inside = inside.where(F.shiftright("_hash", shift + BITS) == F.col("_at"))
        hist = inside.groupBy("_s", head.alias("_b")).agg(F.sum("_size").alias("_t"))
        run = hist.withColumn("_sum", F.sum("_t").over(Window.partitionBy("_s").orderBy("_b")))
        edge = run.join(g.select(F.col("_src").alias("_s2"), "_left"), F.col("_s").eqNullSafe(F.col("_s2"))).where(F.col("_sum") > F.col("_left"))
        edge = edge.groupBy("_s").agg(F.min(F.struct("_b", "_t", "_sum")).alias("_e"))
        g = g.join(edge, F.col("_src").eqNullSafe(F.col("_s")), "left")
        # without an edge every document of the bucket fits: the threshold lies behind it
        fits = ~F.col("_done") & F.col("_e").isNull()
        left = F.when(F.col("_e").isNull(), F.col("_left")).otherwise(F.col("_left") - (F.col("_e._sum") - F.col("_e._t")))
        at = F.when(F.col("_done"), F.col("_at") * (1 << BITS)).when(fits, (F.col("_at") + 1) * (1 << BITS)).otherwise(F.col("_e._b"))
        g = g.select("_src", "source_size", "target", "_base", left.alias("_left"), at.alias("_at"), (F.col("_done") | fits).alias("_done"), F.col("_e._t").alias("_t"))
    # the last bucket is one hash value: it is taken if that brings the sum nearer
    more = F.when(~F.col("_done") & (2 * F.col("_left") > F.col("_t")), 1).otherwise(0)
    return g.select("_src", "source_size", "target", "_base", (F.col("_at") + more).alias("_lim"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for each row of
    ``docs``. Null texts have size 0, null sources are a source of their own (the
    last). Rows with one id are taken or left together; sources without words have
    target 0. Runs agree: nothing depends on order or chance."""
    sizes = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("_src"), words(text).alias("_size"), hash48(doc_id).alias("_hash")))
    goal = thresholds(sizes, targets(sizes, weights, cap))
    goal = goal.withColumnRenamed("_src", "_s")
    out = sizes.join(goal, F.col("_src").eqNullSafe(F.col("_s")))
    copies = (F.col("_base") + (F.col("_hash") < F.col("_lim")).cast("long")).alias("copies")
    out = out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged."""
    own = boxed(docs, _src=docs[source], _size=words(text), _hash=hash48(doc_id))
    sizes = cut(own.select("_src", "_size", "_hash"))
    goal = thresholds(sizes, targets(sizes, weights, cap)).select(F.col("_src").alias("_s"), "_base", "_lim")
    n = F.col("_base") + (F.col("_hash") < F.col("_lim")).cast("long")
    out = own.join(goal, F.col("_src").eqNullSafe(F.col("_s"))).withColumn("_n", n).where("_n > 0")
    return unboxed(out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))), docs.columns)


SQL = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
r AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s GROUP BY source),
w AS (SELECT source, n, 3 * n AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
f AS (SELECT *, ((SELECT sum(n) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS place FROM f),
l AS (SELECT arg_min(share, place) AS lam, min(place) AS place FROM o WHERE share * w <= cap),
t AS (SELECT source, n, CASE WHEN o.place >= l.place THEN lam * w ELSE cap::DOUBLE END AS target FROM o LEFT JOIN l ON true),
b AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS gs FROM s GROUP BY source, h),
c AS (SELECT g.source, h, gs, sum(gs) OVER (PARTITION BY g.source ORDER BY h) AS upto, target - base * n AS extra
    FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
k AS (SELECT source, h FROM c WHERE extra > 0 AND (upto <= extra OR (upto - gs <= extra AND 2 * (extra - (upto - gs)) > gs)))
SELECT s.doc_id, s.size, b.n AS source_size, b.target, base + (k.h IS NOT NULL)::BIGINT AS copies, (base + (k.h IS NOT NULL)::BIGINT) * s.size AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM s.source AND k.h = s.h
"""
