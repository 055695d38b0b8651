"""Context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text wherever it hits a multiple of the block
size; each chunk becomes one letter. A fingerprint holds the letters at a block size
that suits the length and at its double, so that texts of up to twice the length
still share one size. Likeness is an edit distance between letters of one size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, mix64, typed

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SPAN, LENGTH, SMALLEST, COMMON = 7, 64, 2, 4
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
LOWEST = -(1 << 63)


def _letters(marks: np.ndarray, run: np.ndarray, n: int) -> str:
    """One letter for each chunk between ``marks`` (last bytes of chunks), from
    differences of the running polynomial ``run``."""
    ends = marks + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    with np.errstate(over="ignore"):
        h = mix64((run[ends] - run[starts]) * _POWERS.back(starts) + (ends - starts).astype(np.uint64))
    return LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


class _Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)

    def get(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            p = np.full(size, BASE, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                self.up = np.cumprod(p)
        return self.up[:n]

    def back(self, at: np.ndarray) -> np.ndarray:
        """UNBASE ** at, by squaring."""
        out, e, b = np.ones(len(at), np.uint64), at.astype(np.uint64), UNBASE
        with np.errstate(over="ignore"):
            while len(e) and e.any():
                out = np.where(e & np.uint64(1) == 1, out * np.uint64(b), out)
                e, b = e >> np.uint64(1), b * b & (1 << 64) - 1
        return out


_POWERS = _Powers()


def fingerprint(data: bytes) -> str:
    """``size:letters:letters at twice the size``. The block size is the smallest
    power of two that keeps the letters within 64 by expectation, halved while there
    are fewer than 32 chunks. Repetitive texts may hit far more often; all letters stay."""
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    c = np.frombuffer(data, np.uint8).astype(np.uint32)
    roll = np.zeros(n, np.uint32)
    for k in range(min(SPAN, n)):
        roll[k:] += c[: n - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    # how many low bits are all ones: the largest block size that cuts here
    size = SMALLEST
    while size * LENGTH < n:
        size *= 2
    while True:
        marks = np.flatnonzero((roll & np.uint32(size - 1)) == size - 1)
        if len(marks) >= LENGTH // 2 or size <= SMALLEST:
            break
        size //= 2
    twice = marks[(roll[marks] & np.uint32(2 * size - 1)) == 2 * size - 1]
    run = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _POWERS.get(n), out=run[1:])
    return f"{size}:{_letters(marks, run, n)}:{_letters(twice, run, n)}"


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, 64 letters a machine word: the edit distance with
    insertions and deletions is the sum of the lengths less twice this."""
    # what both begin or end with is common, whatever is between
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[head:], b[head:]
    n -= head
    tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    rows: dict[str, bytearray] = {}
    for i, x in enumerate(a):
        if x not in rows:
            rows[x] = bytearray(len(a) // 8 + 1)
        rows[x][i >> 3] |= 1 << (i & 7)
    where = {x: int.from_bytes(r, "little") for x, r in rows.items()}
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & where.get(y, 0)
        s = (s + u | s - u) & full
    return head + tail + len(a) - s.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON, max(1, min(len(a), len(b)) // 3))  # short texts have few letters
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: one less the edit distance in shares of both lengths, at the block sizes
    that both have (the best of them). 0 if no size fits or no four letters in a row (fewer
    for a few letters in all) are common; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    best = 0.0
    for x, p in ((sa, a1), (2 * sa, a2)):
        for y, q in ((sb, b1), (2 * sb, b2)):
            if x == y and p and q:
                best = max(best, _alike(p, q))
    return min(best, 1.0 - 1e-9)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint: one row for each row; a null text counts as empty."""

    def setup():
        return lambda b: {"doc_id": b["_id"], "n_chars": [len(t or "") for t in b["_text"]], "fingerprint": [fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b["_text"]]}

    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(own, "doc_id long, n_chars long, fingerprint string", setup)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited forms, and how alike they are.

    Rows are ordered by id, null ids first, rows with one id by their text; equal rows
    follow each other. The last row is followed by the first; a single row follows
    itself. Ranges of ids are dealt to partitions at quantiles of the ids; the first
    row of a range also goes to the range before it, so that each partition reads its
    rows once, in order, and holds two of them.
    """
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_k"), F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = own.agg(F.min("_k"), F.percentile_approx("_k", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()
    low = marks[0]
    starts = sorted({low, *(m for m in marks[1] or [] if m is not None)}) if low is not None else [0]
    if parts == 1:
        starts = starts[:1]
    last = len(starts) - 1
    bounds = np.array(starts, np.int64)

    def deal():
        def step(b):
            k = np.array(b["_k"], np.int64)
            part = np.maximum(np.searchsorted(bounds, k, side="right") - 1, 0)
            prints = [fingerprint(t.encode("utf-8", "surrogatepass")) for t in b["_text"]]
            # rows with the first id of a range follow the last row of the range before
            ends = np.flatnonzero(bounds[part] == k)
            rows = [*range(len(k)), *ends.tolist()]
            before = np.where(part[ends] == 0, last, part[ends] - 1)
            return {"_part": np.concatenate([part, before]), "_halo": [False] * len(k) + [True] * len(ends), **{c: [b[c][r] for r in rows] for c in ("_k", "_id", "_text")}, "_print": [prints[r] for r in rows]}

        return step

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = to_arrow_schema(typed(out))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list] = {n: [] for n in arrow.names}
        size = 0

        def emit(row, nxt):
            text = edited(row["_text"], nxt["_text"])
            data = text.encode("utf-8", "surrogatepass")
            p = fingerprint(data)
            for n, v in zip(arrow.names, (row["_id"], len(row["_text"]), hashlib.sha256(data).hexdigest(), row["_print"], p, likeness(row["_print"], p), likeness(row["_print"], nxt["_print"])), strict=True):
                made[n].append(v)

        held, closed = None, True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if held is not None and not closed and (row["_part"] == held["_part"]):
                        emit(held, row)
                        size += 1
                        closed = row["_halo"]
                    elif held is None or row["_part"] != held["_part"]:
                        closed = False
                    held = row
                    if size >= 2000:
                        yield pa.RecordBatch.from_pydict(made, schema=arrow)
                        made.update({n: [] for n in arrow.names})
                        size = 0
        yield pa.RecordBatch.from_pydict(made, schema=arrow)

    dealt = map_batches(own, "_part int, _halo boolean, _k long, _id long, _text string, _print string", deal)
    placed = dealt.repartitionById(len(starts), F.col("_part")).sortWithinPartitions("_part", "_halo", "_k", "_text")
    return placed.mapInArrow(walk, out)
