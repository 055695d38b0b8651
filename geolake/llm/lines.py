"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

Two lines are within one edit if deleting one character at the same place makes
them equal, or deleting one character of one makes it the other. Every such variant
is a hashed key; equal keys meet. A line is dropped if a line at an earlier
position (document, then line number) is within the bound, whether or not that one
is dropped too. Below SHORT characters one edit changes what a line says ("1." and
"2."), so such lines must be equal. Only lines that share a half with another line of fitting length
can have a partner at all, so only these are given variants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import cut
from .common import boxed, map_batches, mix64, unboxed

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
LOWEST = -(1 << 63)
SHORT = 8  # characters; the bound is one edit between lines of at least so many, none below
BROADCAST = 200_000  # candidate lines (position and four flags, no text: at most 30 MB) that are sent to all tasks; more are joined by a shuffle


def within_one(a: str, b: str) -> bool:
    """Is the edit distance (insert, delete, replace) at most one?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants(line: str) -> tuple[np.uint64, np.ndarray]:
    """Key of the line, and of the line without each of its characters: differences
    of a running polynomial, linear in the length."""
    n = len(line)
    with np.errstate(over="ignore"):
        c = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(BASE))
        power = np.ones(n, np.uint64)
        if n > 1:
            power[1:] = np.cumprod(np.full(n - 1, BASE, np.uint64))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(c * power, out=run[1:])
        cut_out = run[:-1] + (run[-1] - run[1:]) * np.uint64(UNBASE)
        return mix64(run[-1:] + np.uint64(n))[0], mix64(cut_out + np.uint64(n - 1))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_d, _t, _i: position (id, hash of the text, number); _line, and its 128-bit hash."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_i", "_line"))
    d = d.where(F.col("_line").rlike("\\S"))
    return d.select(F.struct("_d", "_t", "_i").alias("_pos"), "_line", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))


def near_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """_h1, _h2 of the distinct lines that have another line within one edit whose
    first position is earlier, both of at least SHORT characters. ``first`` has _h1, _h2, _pos of each distinct line.

    Of two lines within one edit, of n and n or n + 1 characters, the first or the
    last n / 2 characters are equal. That half tells where the edit must be.
    """
    n = F.length("_line")
    lines = lines.where(n >= SHORT)
    keys = []
    for less in (0, 1):
        m = F.floor((n - less) / 2).cast("int")
        for side, part in ((0, F.substring(F.col("_line"), F.lit(1), m)), (1, F.right(F.col("_line"), m))):
            keys.append(F.struct(F.xxhash64(n - less, F.lit(side), part).alias("_k"), F.lit(less == 0).alias("_short"), F.lit(side).alias("_side")))
    k = lines.select("_h1", F.explode(F.array(*keys)).alias("_e")).select("_h1", "_e.*")
    low = lambda short: F.min(F.when(F.col("_short") == short, F.col("_h1")))
    high = F.max(F.when(F.col("_short"), F.col("_h1")))
    shared = k.groupBy("_k").agg(low(True).alias("_a"), high.alias("_b"), low(False).alias("_c")).where("_a <> _b or (_a is not null and _c is not null)")
    mine = k.join(shared, "_k").withColumn("_swap", F.col("_short") & (F.col("_a") != F.col("_b"))).withColumn("_shift", F.col("_c").isNotNull())
    use = lambda what, side: F.max(F.col(what) & (F.col("_side") == side)).alias(f"{what}{side}")
    cand = mine.groupBy("_h1").agg(use("_swap", 0), use("_swap", 1), use("_shift", 0), use("_shift", 1))
    cand = cut(cand.where("_swap0 or _swap1 or _shift0 or _shift1").join(first, "_h1"))
    few = cand.drop("_h1", "_h2")
    texts = cut(lines.select("_pos", "_line").join(F.broadcast(few) if few.count() <= BROADCAST else few, "_pos").dropDuplicates(["_pos"]))

    def setup():
        def step(b):
            out = {"_key": [], "_whole": [], "_at": []}
            for i, line in enumerate(b["_line"]):
                whole, less = variants(line)
                n, p = len(line), np.arange(len(line))
                # an edit lies behind an equal first half, or before an equal last half
                behind, before = p >= (n - 1) // 2, p < n - (n - 1) // 2
                swap = (behind & b["_swap0"][i]) | (before & b["_swap1"][i])
                shift = (behind & b["_shift0"][i]) | (before & b["_shift1"][i])
                with np.errstate(over="ignore"):
                    swaps = mix64(less[swap] + (p[swap].astype(np.uint64) + np.uint64(2)) * np.uint64(BASE))
                    shifts = mix64(np.concatenate([[whole], less[shift]]).astype(np.uint64) + np.uint64(BASE))
                if not (b["_shift0"][i] or b["_shift1"][i]):
                    shifts = shifts[:0]
                out["_key"].append(np.unique(np.concatenate([swaps, shifts[1:]])))
                out["_whole"].append(np.zeros(len(out["_key"][-1]), bool))
                out["_key"].append(shifts[:1])
                out["_whole"].append(np.ones(len(shifts[:1]), bool))
                out["_at"].append(np.full(len(out["_key"][-2]) + len(shifts[:1]), b["_no"][i]))
            return {"_key": np.concatenate(out["_key"]).view(np.int64), "_whole": np.concatenate(out["_whole"]), "_no": np.concatenate(out["_at"])}

        return step

    # keys for a swap hold the place; keys for a shift are whole for the shorter line only
    v = map_batches(texts.withColumn("_no", F.xxhash64("_line")), "_key long, _whole boolean, _no long", setup, 256 << 10)
    met = v.groupBy("_key").agg(F.min("_no").alias("_lo"), F.max("_no").alias("_hi")).where("_lo <> _hi").select("_key")
    v = cut(v.join(met, "_key").join(texts.select(F.xxhash64("_line").alias("_no"), "_pos"), "_no").select("_key", "_whole", "_pos"))
    # the earliest line of a key answers for all; where one holds the key whole, it meets those that lack a character
    best = v.groupBy("_key").agg(F.min(F.when(F.col("_whole"), F.col("_pos"))).alias("_w"), F.min(F.when(~F.col("_whole"), F.col("_pos"))).alias("_l"))
    partner = F.when(F.col("_whole"), F.col("_l")).otherwise(F.coalesce("_w", "_l"))
    pairs = v.join(best, "_key").select("_pos", partner.alias("_of")).where("_of < _pos").distinct()
    checked = F.udf(within_one, "boolean", useArrow=True)
    both = pairs.join(texts.select("_pos", F.col("_line").alias("_a")), "_pos").join(texts.select(F.col("_pos").alias("_of"), F.col("_line").alias("_b")), "_of")
    found = both.where(checked("_a", "_b")).select("_pos").distinct()
    return cand.join(found, "_pos").select("_h1", "_h2")


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_d, _t, _drop: the numbers of the lines to drop of each document that has any."""
    lines = _lines(docs, doc_id, text)
    own = lines.select("_pos", "_h1", "_h2")
    first = cut(own.groupBy("_h1", "_h2").agg(F.min("_pos").alias("_pos"), F.count("*").alias("_n")))
    near = cut(near_lines(lines, first.drop("_n"))).withColumn("_near", F.lit(True))
    first = first.withColumnRenamed("_pos", "_first").join(near, ["_h1", "_h2"], "left").where("_n > 1 or _near").withColumn("_near", F.coalesce("_near", F.lit(False)))
    hit = own.join(first, ["_h1", "_h2"]).where("_near or _pos > _first")
    return hit.groupBy("_pos._d", "_pos._t").agg(F.collect_set("_pos._i").alias("_drop"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated and nearly repeated lines, one row for each row.

    Lines are what stands between line feeds. Blank lines stay, null texts stay
    null, a document that loses all its lines keeps an empty text. Rows with one id
    are ordered by a hash of their text; equal rows share their positions, so each
    keeps the same lines. A null id comes before all others.
    """
    gone = dropped(docs, doc_id, text).withColumnsRenamed({"_d": "_line_d", "_t": "_line_t"})
    # texts travel compressed
    rest = [c for c in docs.columns if c != text]
    d = boxed(docs.select(*rest, text), _own_d=F.coalesce(docs[doc_id].cast("long"), F.lit(LOWEST)), _own_t=F.xxhash64(docs[text]), _packed=_pack(docs[text]))
    d = d.withColumn("_row", F.col("_row").dropFields(text))
    d = d.join(gone, (F.col("_own_d") == F.col("_line_d")) & (F.col("_own_t") == F.col("_line_t")), "left")
    return unboxed(d, docs.columns, **{text: _unpack(F.col("_packed"), F.col("_drop"))})


@F.pandas_udf(BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: None if t is None else z.compress(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(StringType())
def _unpack(packed: pd.Series, drop: pd.Series) -> pd.Series:
    out = []
    for z, gone in zip(packed, drop, strict=True):
        text = None if z is None else zstandard.decompress(z, max_output_size=1 << 31).decode("utf-8", "surrogatepass") if z else ""
        if gone is not None and text is not None:
            numbers = set(gone.tolist())
            text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in numbers])
        out.append(text)
    return pd.Series(out, dtype=object)
