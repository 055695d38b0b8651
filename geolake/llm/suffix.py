"""Exact removal of repeated byte strings with suffix arrays.

Every string of ``length`` bytes holds one smallest ``GRAM``-byte piece (by hash, the
leftmost of equal ones); neighbouring strings with the same piece form a segment.
Equal strings have equal pieces, so segments are grouped by piece, and groups with a
single segment can't hold a repeat. Every string of a segment that occurs twice is a
repeat, so groups of such segments alone are done. The other groups are packed into
shards of bounded size; strings whose hash no other string of the shard has are left
out, the suffix array of the rest comes from induced sorting, and its permuted common
prefixes tell which strings start twice. Groups with too many segments are split by
the bytes beside the piece, left or right, whichever side the string has more of.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches, mix64

LENGTH, GRAM = 200, 48
PIECE = 4096  # strings in one segment at most
SHARD = 2 << 20  # bytes of a shard
CROWDED = 10_000  # segments of a group, about 3 MB
HOT = 10_000  # segments of a key that one task of a join meets; more are dealt over several
LISTED = 100_000  # keys at most that are sent to all tasks to be dealt so
BROADCAST = 200_000  # texts whose segment lists (at most 50 MB) are sent to all tasks; more are joined by a shuffle
BLOCK = 8 << 20
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


# --- suffix arrays ---------------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than the one after it? The last one is."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        d = np.sign(s[1:].astype(np.int64) - s[:-1])
        nxt = np.minimum.accumulate(np.where(d != 0, np.arange(n - 1), n - 1)[::-1])[::-1]
        out[:-1] = np.where(nxt < n - 1, d[np.minimum(nxt, n - 2)] > 0, True)
    return out


def _deal(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, edge: np.ndarray, forward: bool) -> None:
    """One induction scan. Slots are read in order; each suffix found gives the one
    before it a slot at its bucket's edge. A stretch of slots is handled at once up to
    the first slot that the stretch itself fills."""
    n = len(sa)
    small = s.max() < 65536
    at, step = 0, 4096
    while at < n:
        end = min(n, at + step)
        part = sa[at:end] if forward else sa[n - end : n - at][::-1]
        t = part - 1
        where = ((part > 0) & wanted[t]).nonzero()[0]
        if len(where):
            t = t[where]
            c = s[t]
            slot = edge[c]
            stop = int(slot.min()) if forward else n - 1 - int(slot.max())
            if stop < end:
                k = int(where.searchsorted(stop - at))
                t, c, slot = t[:k], c[:k], slot[:k]
                end = stop
            order = (c.astype(np.uint16) if small else c).argsort(kind="stable")
            c = c[order]
            new = (c[1:] != c[:-1]).nonzero()[0] + 1
            if len(new) + 1 >= len(c):  # each in a bucket of its own
                sa[slot] = t
                edge[c] += 1 if forward else -1
            else:
                first = np.concatenate(([0], new))
                count = np.concatenate((new, [len(c)])) - first
                rank = np.arange(len(c)) - first.repeat(count)
                sa[slot[order] + rank if forward else slot[order] - rank] = t[order]
                edge[c[first]] += count if forward else -count
        step = max(64, min(1 << 20, 2 * (end - at)))
        at = end


def _induce(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` from its sorted leftmost-smaller suffixes."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    c = s[seeds]
    last = np.flatnonzero(np.concatenate([c[1:] != c[:-1], [True]]))
    sizes = np.diff(np.concatenate([[-1], last]))
    back = np.repeat(last, sizes) - np.arange(len(c))
    sa[ends[c] - back] = seeds
    _deal(sa, s, ~smaller, starts.copy(), True)
    lms = np.zeros(n, bool)
    lms[seeds] = True
    sa[(sa >= 0) & lms[np.maximum(sa, 0)]] = -1
    sa[0] = n - 1
    _deal(sa, s, smaller, ends.copy(), False)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last value is its only 0, by induced sorting."""
    s = s.astype(np.int64)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(s)
    seeds = np.flatnonzero(smaller & np.concatenate([[False], ~smaller[:-1]]))
    size = np.bincount(s)
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    # sort the substrings between leftmost-smaller positions: induce from any order by first letter
    rough = _induce(s, smaller, starts, ends, seeds[np.argsort(s[seeds], kind="stable")])
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    order = rough[is_seed[rough]]
    till = np.full(n, n - 1)
    till[seeds[:-1]] = seeds[1:]
    with np.errstate(over="ignore"):
        power = np.full(n, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(n, UNBASE, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s.astype(np.uint64) + np.uint64(BASE)) * power)])
        print_ = (run[till[order] + 1] - run[order]) * back[order]
    span = till[order] - order
    new = np.concatenate([[True], (print_[1:] != print_[:-1]) | (span[1:] != span[:-1])])
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(order):
        names = np.empty(n, np.int64)
        names[order] = name
        order = seeds[suffix_array(names[seeds])]
    return _induce(s, smaller, starts, ends, order)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before it in the array (-1: none), and the length
    of their common prefix. Where the letters before both are equal the length is that
    of the position before less one; only the others are compared."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    has = phi >= 0
    own = np.ones(n, bool)
    i = np.arange(n)
    inner = has & (i > 0) & (phi > 0)
    own[inner] = s[i[inner] - 1] != s[phi[inner] - 1]
    own[~has] = True
    heads = np.flatnonzero(own)
    a, b = heads[has[heads]], phi[heads[has[heads]]]
    got = np.zeros(len(a), np.int64)
    padded = np.concatenate([s, np.full(64, -1, s.dtype)])
    live = np.arange(len(a))
    wide = 16
    while len(live):
        x = padded[(a[live] + got[live])[:, None] + np.arange(wide)]
        y = padded[(b[live] + got[live])[:, None] + np.arange(wide)]
        differ = x != y
        found = differ.any(1)
        got[live] += np.where(found, differ.argmax(1), wide)
        live = live[~found]
    plcp = np.zeros(n, np.int64)
    plcp[a] = got
    head_of = np.maximum.accumulate(np.where(own, i, 0))
    return phi, np.where(has, plcp[head_of] - (i - head_of), 0)


def _hashed_twice(text: np.ndarray, start: np.ndarray, count: np.ndarray, single: np.ndarray, length: int) -> np.ndarray:
    """The positions whose string's hash comes twice, at least once in a single segment:
    all real repeats that matter, and the strings they repeat, are among them."""
    at = np.arange(count.sum()) + (start - np.cumsum(count) + count).repeat(count)
    h = _grams(text, length)[at]
    order = h.argsort(kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    times = np.diff(np.append(first, len(h)))
    wanted = (times > 1) & np.logical_or.reduceat(single.repeat(count)[order], first)
    return at[order[wanted.repeat(times)]]


def starts_twice(segments: list[bytes], copied: list[bool], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, number): the runs of strings of ``length`` bytes in the segments
    not copied that start anywhere else in the shard."""
    size = np.array([len(x) for x in segments], np.int64)
    start = np.cumsum(size + 1) - size - 1
    count, single = np.maximum(size - length + 1, 0), ~np.array(copied, bool)
    twice = np.zeros(int((size + 1).sum()), bool)
    if count[single].any():
        text = np.frombuffer(b"\0".join(segments), np.uint8)
        at = _hashed_twice(text, start, count, single, length)
        edge = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + length, minlength=len(text) + 1)
        kept = np.flatnonzero(np.cumsum(edge) > 0)  # the bytes of these strings; never those between segments
        if len(kept):
            # each stretch of kept bytes ends with a letter of its own
            piece = np.cumsum(np.concatenate([[False], np.diff(kept) > 1]))
            k = int(piece[-1]) + 1
            slot = np.arange(len(kept)) + piece
            s = np.zeros(len(kept) + k + 1, np.int32)
            s[slot] = text[kept].astype(np.int32) + (k + 1)
            s[np.append(slot[np.flatnonzero(np.diff(piece))], slot[-1]) + 1] = np.arange(1, k + 1)
            phi, lcp = common_prefixes(s, suffix_array(s))
            long = lcp >= length
            long[phi[np.flatnonzero(long)]] = True
            twice[kept] = long[slot]
            twice &= single.repeat(size + 1)
    edge = np.diff(np.concatenate([[False], twice]).astype(np.int8))
    a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    segment = start.searchsorted(a, "right") - 1
    return segment, a - start[segment], b - a


# --- segments --------------------------------------------------------------------


def _grams(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on."""
    n = len(c)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _UP.get(n), out=run[1:])
        return mix64((run[k:] - run[: n - k + 1]) * _DOWN.get(n - k + 1))


class _Powers:
    def __init__(self, base: int):
        self.base, self.kept = base, np.ones(1, np.uint64)

    def get(self, n: int) -> np.ndarray:
        if len(self.kept) < n:
            p = np.full(1 << (n - 1).bit_length(), self.base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                self.kept = np.cumprod(p)
        return self.kept[:n]


_UP, _DOWN = _Powers(BASE), _Powers(UNBASE)


def _content(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range."""
    n = len(c)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(7)) * _UP.get(n), out=run[1:])
        return mix64((run[stop] - run[start]) * _DOWN.get(n + 1)[start] + (stop - start).astype(np.uint64) * np.uint64(BASE)).view(np.int64)


def cut_segments(data: bytes, length: int = LENGTH, gram: int = GRAM, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(key, content, start, strings, low): segments of one text. ``low`` is where the
    shared piece begins. A text below ``length`` bytes has none. Only the keys unless
    ``whole``."""
    c = np.frombuffer(data, np.uint8)
    n, w = len(c), length - gram + 1
    if n < length:
        return (np.empty(0, np.int64),) * 5
    h = _grams(c, gram)
    lows = []
    for at in range(0, n - length + 1, BLOCK):
        x = h[at : at + BLOCK + w - 1]
        x = (x & ~np.uint64(0xFFFFFF)) | np.arange(len(x), dtype=np.uint64)
        m = len(x)
        full = np.concatenate([x, np.full(-m % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
        pre = np.minimum.accumulate(full, 1).ravel()
        suf = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        best = np.minimum(suf[: m - w + 1], pre[w - 1 : m])
        lows.append((best & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    low = np.concatenate(lows)
    i = np.arange(len(low))
    fresh = np.concatenate([[True], low[1:] != low[:-1]])
    begin = np.maximum.accumulate(np.where(fresh, i, 0))
    fresh |= (i - begin) % PIECE == 0
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(low)))
    low = low[start]
    if not whole:
        return (h[low].view(np.int64),)
    return h[low].view(np.int64), _content(c, start, start + count + length - 1), start, count, low


def halve(data: bytes, start: int, count: int, low: int, high: int, length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(key, content, start, strings, low, high) of the two parts of a segment: strings
    with more bytes left of the shared piece, and the others. The shared piece grows."""
    rest = length - (high - low)
    half = (rest + 1) // 2
    split = min(max(low - half + 1 - start, 0), count)
    out = []
    for a, n, lo, hi in ((start, split, low - half, high), (start + split, count - split, low, high + rest - half + 1)):
        if n > 0:
            key = hashlib.blake2b(data[lo:hi] + bytes([lo == low]), digest_size=8).digest()
            seg = hashlib.blake2b(data[a : a + n + length - 1], digest_size=8).digest()
            out.append((int.from_bytes(key, "little", signed=True), int.from_bytes(seg, "little", signed=True), a, n, lo, hi))
    return out


# where a segment is: start (29 bits), strings (13), shared piece from the start (13), its length (8)
SEGMENT = "_key long, _seg long, _node long, _at long"


def _pack(start, count, low, high):
    return (start << 34) | (count << 21) | ((low - start) << 8) | (high - low)


def _unpack(at):
    start = at >> 34
    low = start + ((at >> 8) & 8191)
    return start, (at >> 21) & 8191, low, low + (at & 255)


def _start(at: str):
    return F.shiftright(at, 34)


def _count(at: str):
    return F.shiftright(at, 21).bitwiseAND(8191)


def _packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_node (a hash of the id and the text), _id, _z: the compressed bytes."""

    def setup():
        z = zstandard.ZstdCompressor(level=1)
        return lambda b: {"_node": b["_node"], "_id": b["_id"], "_z": [z.compress(t.encode("utf-8", "surrogatepass")) for t in b["_text"]]}

    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return map_batches(own.select(F.xxhash64("_id", "_text").alias("_node"), "_id", "_text"), "_node long, _id long, _z binary", setup)


def _open(b: bytes) -> bytes:
    return zstandard.decompress(b, max_output_size=1 << 31) if b else b""


def repeated_ranges(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_node, _runs: for each text with repeats, the (start, number) of the strings of
    ``length`` bytes that also start anywhere else, the same text included."""
    if not GRAM <= length <= 255:
        raise ValueError(f"length must be {GRAM} to 255")
    packed = _packed(docs, doc_id, text)

    def keys():
        def step(b):
            return {"_key": np.concatenate([cut_segments(t.encode("utf-8", "surrogatepass"), length, whole=False)[0] for t in b["_text"]])}

        return step

    def cutting():
        def step(b):
            out = {n: [] for n in ("_key", "_seg", "_node", "_at")}
            for node, t in zip(b["_node"], b["_text"], strict=True):
                data = t.encode("utf-8", "surrogatepass")
                if len(data) >= 1 << 29:
                    raise ValueError("a text of 512 MB or more")
                key, seg, start, count, low = cut_segments(data, length)
                for n, v in zip(out, (key, seg, np.full(len(key), node, np.int64), _pack(start, count, low, low + GRAM)), strict=True):
                    out[n].append(v)
            return {n: np.concatenate(v).astype(np.int64) for n, v in out.items()}

        return step

    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    own = own.select(F.xxhash64("_id", "_text").alias("_node"), "_text")
    segs = map_batches(own, SEGMENT, cutting, 1 << 20)
    segs = cut(_shared(segs, map_batches(own.select("_text"), "_key long", keys, 1 << 20)))
    while True:
        distinct = segs.where(F.col("_at").bitwiseAND(255) < length).groupBy("_key", "_seg").agg(F.count("*").alias("_n"))
        crowd = cut(distinct.groupBy("_key").agg(F.count("*").alias("_m"), F.sum("_n").alias("_n")).where(F.col("_m") > CROWDED).select("_key", "_n"))
        if crowd.isEmpty():
            break
        hot = cut(_dealt(segs.where(F.col("_at").bitwiseAND(255) < length), crowd, ["_key"], "left_semi"))
        cold = _dealt(segs, crowd, ["_key"], "left_anti")
        lists = hot.groupBy("_node").agg(F.collect_set("_at").alias("_list"))
        times = hot.groupBy("_node", "_at").agg(F.count("*").alias("_times"))

        def halving():
            def step(b):
                out = {n: [] for n in ("_key", "_seg", "_node", "_at", "_old")}
                for node, t, parts in zip(b["_node"], b["_z"] if "_z" in b else b["_text"], b["_list"], strict=True):
                    data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else _open(t)
                    for p in parts:
                        for key, seg, *where in halve(data, *_unpack(p), length):
                            for n, v in zip(out, (key, seg, node, _pack(*where), p), strict=True):
                                out[n].append(v)
                return out

            return step

        lists = cut(lists)
        if lists.count() <= BROADCAST:
            one = own.join(F.broadcast(lists), "_node")
        else:
            one = packed.select("_node", "_z").join(lists, "_node")
        one = one.dropDuplicates(["_node"])  # equal rows are one text
        halves = map_batches(one, SEGMENT + ", _old long", halving)
        # rows that stand for equal documents count as often as before
        again = halves.join(times.withColumnRenamed("_at", "_old"), ["_node", "_old"]).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        segs = cut(cold.unionByName(_shared(again.select("_key", "_seg", "_node", "_at"))))
    reps = segs.groupBy("_key", "_seg").agg(F.count("*").alias("_n"), F.min(F.struct("_node", "_at")).alias("_rep"))
    group = Window.partitionBy("_key")
    mixed = (F.count("*").over(group) > 1) & (F.min("_n").over(group) == 1)
    reps = cut(reps.select("_key", "_seg", "_n", "_rep._node", "_rep._at", mixed.alias("_mixed")))
    copies = _dealt(segs, reps.where("_n > 1"), ["_key", "_seg"], "left_semi")
    copies = copies.select("_node", _start("_at").cast("int").alias("at"), _count("_at").cast("int").alias("n"))
    mixed = reps.where("_mixed")
    total = mixed.agg(F.sum(_count("_at") + length - 1)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD))
    lists = mixed.groupBy("_node").agg(F.collect_list(F.struct("_key", (F.col("_n") > 1).alias("_copied"), "_at")).alias("_list"))

    def fetching():
        def step(b):
            out = {n: [] for n in ("_key", "_copied", "_node", "_start", "_bytes")}
            for node, z, parts in zip(b["_node"], b["_z"], b["_list"], strict=True):
                data = _open(z)
                for p in parts:
                    start, count, _, _ = _unpack(p["_at"])
                    for n, v in zip(out, (p["_key"], p["_copied"], node, start, data[start : start + count + length - 1]), strict=True):
                        out[n].append(v)
            return out

        return step

    one = packed.select("_node", "_z").join(lists, "_node").dropDuplicates(["_node"])
    fetched = map_batches(one, "_key long, _copied boolean, _node long, _start int, _bytes binary", fetching, 1 << 20)
    fetched = fetched.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards))).drop("_key")

    def sort_shard(g: pd.DataFrame) -> pd.DataFrame:
        segment, at, n = starts_twice(g["_bytes"].tolist(), g["_copied"].tolist(), length)
        return pd.DataFrame({"_node": g["_node"].to_numpy()[segment], "at": g["_start"].to_numpy()[segment] + at, "n": n})

    found = fetched.groupBy("_shard").applyInPandas(sort_shard, "_node long, at int, n int")
    return copies.unionByName(found).groupBy("_node").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("_runs"))


def _shared(segs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Segments whose piece another segment has too. ``keys`` has their keys alone."""
    twice = cut((segs if keys is None else keys).groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"))
    return _dealt(segs, twice, ["_key"], "left_semi")


def _dealt(segs: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """The semi or anti join of segments with ``keys``, which say in ``_n`` how many segments
    they have. Keys of more than ``HOT`` are dealt over several tasks by text and place."""
    total = keys.agg(F.sum("_n")).first()[0] or 0
    most = max(HOT, int(total) // LISTED)
    parts = F.ceil(F.col("_n") / most)
    many = keys.where(F.col("_n") > most).select(*on, parts.alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64("_node", "_at"), "_parts"), F.lit(0).cast("long"))
    own = segs.join(F.broadcast(many), on, "left").withColumn("_part", part)
    every = keys.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return own.join(every, [*on, "_part"], how).select(segs.columns)


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, end), kept (the remaining bytes): one row for each
    row of ``docs``. A null text is empty. Equal rows are each other's repeats."""
    runs = repeated_ranges(docs, length, doc_id, text)

    def setup():
        def step(b):
            out = {"doc_id": b["_id"], "n_bytes": [], "spans": [], "kept": []}
            for z, found in zip(b["_z"], b["_runs"], strict=True):
                data = _open(z)
                spans: list[list[int]] = []
                for r in found or ():
                    a, e = r["at"], r["at"] + r["n"] + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([a, e])
                kept, at = [], 0
                for a, e in spans:
                    kept.append(data[at:a])
                    at = e
                out["n_bytes"].append(len(data))
                out["spans"].append([{"start": a, "end": e} for a, e in spans])
                out["kept"].append(b"".join([*kept, data[at:]]))
            return out

        return step

    both = _packed(docs, doc_id, text).join(runs, "_node", "left")
    return map_batches(both.select("_id", "_z", "_runs"), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary", setup, 1 << 20)
