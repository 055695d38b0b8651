"""Interpolated modified Kneser-Ney language model of word pairs.

Counting: tasks hash the words of their texts (no word becomes a Python string), fold
equal ones and send sorted runs of hashes and counts to the shard of their leading
bits. A shard merges its runs and stores one sorted array of hashes and one of counts.
The place of a word in the arrays of all shards is its number; a pair is hashed from
two numbers by a one-to-one function and counted in the same way. The merged pairs
tell how many pairs begin and end with each word, which is added up by ranges of
numbers. Shards follow the size of the corpus, so no task grows with it.

The arrays are files in the shared folder. Scoring tasks map them into memory and look
up sorted queries; nothing of the model passes through the driver or a broadcast.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path
from .common import mix64, typed

WINDOW = (1 << 20) - 1
SLICE_BYTES = 8 << 20
#: A task folds this many numbers before it sends them.
HELD = 1 << 22
SHARD_BYTES = 1 << 25
BEGIN, UNKNOWN = 0xFFFFFFFE, 0xFFFFFFFF
END = np.uint64(0x9AE16A3B2F90404F)
FOLDS, HELD_FOLD = 7, 2
_ODD = 0x9E3779B97F4A7C15


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


# --- words -----------------------------------------------------------------------


@lru_cache(1)
def _letters() -> np.ndarray:
    """A random number for each byte; capitals have those of their small letters, white space has 0."""
    with np.errstate(over="ignore"):
        t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    t[65:91] = t[97:123]
    t[[32, *range(9, 14)]] = 0
    return t


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    with np.errstate(over="ignore"):
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes of several texts, and the words in each text.
    Text ``k`` lies between ``ends[k]`` and ``ends[k + 1]``. A hash is the sum of the
    bytes' numbers times powers by place: sums over all bytes, taken at once, give it."""
    letters = _letters()
    found, at = [], []
    lo, stop = int(ends[0]), int(ends[-1])
    breaks = np.unique(ends)
    while lo < stop:
        size = WINDOW
        while True:
            hi = min(stop, lo + size)
            v = letters[data[lo:hi]]
            inside = v != 0
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi, "right")] - lo
            b = cut[cut < hi - lo]
            first[b] = inside[b]
            b = cut[cut > 0] - 1
            last[b] = inside[b]
            starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
            # a word that goes on behind the window is left for the next one
            if hi < stop and len(stops) and stops[-1] == hi - lo and not (len(cut) and cut[-1] == hi - lo):
                if starts[-1] == 0:
                    size *= 2
                    continue
                hi = lo + int(starts[-1])
                starts, stops = starts[:-1], stops[:-1]
            break
        up, down = _powers(1 << max(20, len(v).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(v) + 1, np.uint64)
            np.cumsum(v * up[: len(v)], out=sums[1:])
            h = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
            found.append(mix64(h))
        at.append(starts + lo)
        lo = hi
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    places = np.concatenate(at) if at else np.empty(0, np.int64)
    return hashes, np.diff(np.searchsorted(places, ends))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by ``END``, and the tokens of each."""
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    hashes, n = word_hashes(np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), ends)
    n = n + 1
    out = np.full(len(hashes) + len(n), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = hashes
    return out, n


def pair_ids(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number before each token, ``BEGIN`` at the start of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = BEGIN
    return before


def pair_hash(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix64((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))


_INVERSE = (pow(0xBF58476D1CE4E5B9, -1, 1 << 64), pow(0x94D049BB133111EB, -1, 1 << 64))


def unhash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of a pair: :func:`mix64` backwards."""
    with np.errstate(over="ignore"):
        x = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
        x = x * np.uint64(_INVERSE[1])
        x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
        x = x * np.uint64(_INVERSE[0])
        x = x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``SLICE_BYTES`` or one row at a time."""
    for batch in batches:
        size = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


# --- counting --------------------------------------------------------------------


def _add(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _pack(x: np.ndarray) -> bytes:
    x = _small(x)
    return bytes([x.itemsize]) + x.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


RUN = "shard int, keys binary, counts binary"


def _runs(keys: np.ndarray, n: np.ndarray, bits: int) -> dict:
    """A sorted run as one row for each shard that it meets."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int32)
    head = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.empty(0, np.int64)
    stop = np.append(head[1:], len(keys))
    return {"shard": shard[head], "keys": [keys[a:b].tobytes() for a, b in zip(head, stop, strict=True)], "counts": [_pack(n[a:b]) for a, b in zip(head, stop, strict=True)]}


def _folded(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Array], np.ndarray], bits: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs of all keys of a task, folded as far as ``HELD`` of them allow."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold():
        keys, n = _add(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        held[:] = [(keys, n)]
        return len(keys)

    for batch in _sliced(batches):
        held.append(_add(keys_of(batch.column(0))))
        if sum(len(k) for k, _ in held) > HELD and fold() > HELD // 2:
            yield pa.RecordBatch.from_pydict(_runs(*held.pop(), bits), schema=arrow)
    if held:
        fold()
        yield pa.RecordBatch.from_pydict(_runs(*held.pop(), bits), schema=arrow)


def _save(folder: str, name: str, x: np.ndarray) -> None:
    """Written beside its place and moved there: a task that runs twice leaves one whole file."""
    path = os.path.join(folder, f"{name}.npy")
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        np.save(f, x)
    os.replace(draft, path)


@lru_cache(512)
def _load(folder: str, name: str) -> np.ndarray:
    return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")


def mounted(path: str) -> str:
    """The path under which all machines see a folder of the shared store."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"the model is mapped into memory: spark.checkpoint.dir must be a mounted folder, not {path}")
    return unquote(at.path)


def _merged(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _add(np.concatenate([np.frombuffer(k, np.uint64) for k in g["keys"]]), np.concatenate([_unpack(c) for c in g["counts"]]))


# --- the model -------------------------------------------------------------------


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What is taken off a count of 1, of 2 and of more, by how many there are of each.
    Where a small corpus lacks one of them or gives less than 0: 0.5, 1 and 1.5."""
    if min(ones, twos, threes, fours) > 0:
        y = ones / (ones + 2 * twos)
        d = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
        if min(d) >= 0 and d[0] <= 1 and d[1] <= 2 and d[2] <= 3:
            return d
    return 0.5, 1.0, 1.5


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that belong to all of them. ``first``
    holds the number of the first word of each shard; the folder has, by shard, the
    hashes and counts of words (``w``, ``c``), how many pairs end with a word (``e``)
    and begin with it, by the count of the pair (``b1``, ``b2``, ``b3``), and the hashes
    and counts of pairs (``p``, ``n``)."""

    folder: str
    bits: int
    first: np.ndarray
    docs: int
    tokens: int
    pairs: int
    begins: tuple[int, int, int]
    pair_off: tuple[float, float, float]
    end_off: tuple[float, float, float]
    end_off_sum: float

    @property
    def vocabulary(self) -> int:
        return int(self.first[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by sorted lookups, shard by shard."""
        return _find(self, hashes, "w", lambda shard, at: self.first[shard] + at, UNKNOWN)

    def of_word(self, ids: np.ndarray, name: str) -> np.ndarray:
        """What array ``name`` holds for words; 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        cuts = np.searchsorted(s, self.first)
        for k in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[k], cuts[k + 1])
            out[order[at]] = _load(self.folder, f"{name}-{k}")[s[at].astype(np.int64) - self.first[k]]
        return out

    def of_pair(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often a pair was counted."""
        return _find(self, pair_hash(before, ids), "p", lambda shard, at: _load(self.folder, f"n-{shard}")[at], 0)

    def log10(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of the probability of each token, ``n`` of them in each text."""
        vocabulary = self.vocabulary
        words, back = np.unique(ids, return_inverse=True)
        if self.pairs:
            ends = self.of_word(words, "e")
            rest = self.end_off_sum / self.pairs
            low = np.maximum(ends - _off(self.end_off, ends), 0) / self.pairs + rest / (vocabulary + 1)
        else:
            low = np.full(len(words), 1 / (vocabulary + 1))
        low = low[back]
        before = pair_ids(ids, n)
        words, back = np.unique(before, return_inverse=True)
        begins = [self.of_word(words, f"b{k}") for k in (1, 2, 3)]
        total = self.of_word(words, "c")
        at = np.flatnonzero(words == BEGIN)
        if len(at):
            total[at[0]] = self.docs
            for k in range(3):
                begins[k][at[0]] = self.begins[k]
        seen = total > 0
        # nothing follows an unknown word: all of its weight goes to the lower order
        left = np.where(seen, sum(d * b for d, b in zip(self.pair_off, begins, strict=True)) / np.maximum(total, 1), 1.0)
        pairs, again = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_inverse=True)
        c = self.of_pair((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))[again]
        high = np.maximum(c - _off(self.pair_off, c), 0) / np.maximum(total, 1)[back]
        return np.log10(high + left[back] * low)


def _off(d: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _find(m: Model, hashes: np.ndarray, name: str, value: Callable[[int, np.ndarray], np.ndarray], absent: int) -> np.ndarray:
    out = np.full(len(hashes), absent, np.int64)
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    shard = (s >> np.uint64(64 - m.bits)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange((1 << m.bits) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[k], cuts[k + 1]
        there = _load(m.folder, f"{name}-{k}")
        if len(there):
            at = np.minimum(np.searchsorted(there, s[a:b]), len(there) - 1)
            hit = np.flatnonzero(there[at] == s[a:b])
            out[order[a:b][hit]] = value(int(k), at[hit])
    return out


def _ranges(shard: np.ndarray, ids: np.ndarray, kind: np.ndarray, n: np.ndarray) -> dict:
    """Counts of words as rows for the shards that hold the words."""
    head = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    stop = np.append(head[1:], len(shard))
    return {
        "shard": shard[head].astype(np.int32),
        "keys": [_pack(ids[a:b]) for a, b in zip(head, stop, strict=True)],
        "kinds": [kind[a:b].astype(np.uint8).tobytes() for a, b in zip(head, stop, strict=True)],
        "counts": [_pack(n[a:b]) for a, b in zip(head, stop, strict=True)],
    }


def fit(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the words and pairs of all ``docs``. The folder holds files of its own, and
    the driver sees a few numbers of each shard; there are at least eight shards, and
    more than one for every ``shard_bytes`` of text. Null texts count as empty. Words
    are numbered with 32 bits: a corpus with more different ones raises."""
    spark = docs.sparkSession
    folder = mounted(scratch_path(spark, "ngram"))
    os.makedirs(folder)
    own = docs.select(F.col(text).alias("_text"))
    size = own.agg(F.sum(F.octet_length("_text")).alias("bytes"), F.count("*").alias("docs")).first()
    bits = max(3, int((size["bytes"] or 0) // shard_bytes).bit_length())

    run = to_arrow_schema(typed(RUN))

    def count_words(batches):
        return _folded(batches, lambda texts: tokens(texts)[0], bits, run)

    def store_words(g: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merged(g)
        shard = int(g["shard"].iloc[0])
        _save(folder, f"w-{shard}", keys)
        _save(folder, f"c-{shard}", _small(n))
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(n.sum())]})

    made = own.mapInArrow(count_words, RUN).groupBy("shard").applyInPandas(store_words, "shard int, words long, tokens long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in made:
        sizes[r["shard"]] = r["words"]
    for k in np.flatnonzero(sizes == 0):
        for name in ("w", "c"):
            _save(folder, f"{name}-{k}", np.empty(0, np.uint64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    if first[-1] >= BEGIN:
        raise ValueError("more different words than 32-bit numbers")
    m = Model(folder, bits, first, size["docs"], sum(r["tokens"] for r in made), 0, (0, 0, 0), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0.0)

    def count_pairs(batches):
        def keys_of(texts):
            ids, n = _numbered(m, texts)
            return pair_hash(pair_ids(ids, n), ids)

        return _folded(batches, keys_of, bits, run)

    arrow = to_arrow_schema(typed("shard int, keys binary, kinds binary, counts binary"))

    def store_pairs(table: pa.Table) -> pa.Table:
        g = table.to_pandas()
        keys, n = _merged(g)
        shard = int(g["shard"].iloc[0])
        _save(folder, f"p-{shard}", keys)
        _save(folder, f"n-{shard}", _small(n))
        before, word = unhash(keys)
        # kinds 1 to 3: pairs that begin with the word, by count; 0: pairs that end with it
        k, v = _add(np.concatenate([(before.astype(np.uint64) << np.uint64(2)) | np.minimum(n, 3).astype(np.uint64), word.astype(np.uint64) << np.uint64(2)]), np.ones(2 * len(keys), np.int64))
        ids, kind = (k >> np.uint64(2)).astype(np.int64), (k & np.uint64(3)).astype(np.int64)
        at = np.searchsorted(first, ids, "right") - 1  # BEGIN lies behind all shards
        rows = _ranges(at, ids - first[at], kind, v)
        met = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        rows = {c: [*v, [-1, _pack(np.arange(1, 5)), bytes(4), _pack(met)][i]] for i, (c, v) in enumerate(rows.items())}
        return pa.Table.from_pydict(rows, schema=arrow)

    told = own.mapInArrow(count_pairs, RUN).groupBy("shard").applyInArrow(store_pairs, "shard int, keys binary, kinds binary, counts binary")

    def store_ends(g: pd.DataFrame) -> pd.DataFrame:
        shard = int(g["shard"].iloc[0])
        out = {"shard": shard, "pairs": 0, "met": [0] * 4, "begins": [0] * 3}
        ids = np.concatenate([_unpack(k) for k in g["keys"]])
        kind = np.concatenate([np.frombuffer(k, np.uint8) for k in g["kinds"]])
        n = np.concatenate([_unpack(c) for c in g["counts"]])
        if shard < 0:
            out["met"] = [int(n[ids == c].sum()) for c in range(1, 5)]
        elif shard == 1 << bits:
            out["begins"] = [int(n[kind == c].sum()) for c in range(1, 4)]
        else:
            for c, name in enumerate(("e", "b1", "b2", "b3")):
                at = kind == c
                full = np.bincount(ids[at], n[at], sizes[shard]).astype(np.int64)
                _save(folder, f"{name}-{shard}", _small(full))
                if not c:
                    out["pairs"] = int(full.sum())
                    out["met"] = np.bincount(np.minimum(full, 5), minlength=6)[1:5].tolist()
                    out["begins"] = [int((full == 1).sum()), int((full == 2).sum()), int((full > 2).sum())]
        return pd.DataFrame([out])

    done = {r["shard"]: r for r in told.groupBy("shard").applyInPandas(store_ends, "shard int, pairs long, met array<long>, begins array<long>").collect()}
    for k in np.flatnonzero(sizes == 0):
        for name in ("e", "b1", "b2", "b3"):
            _save(folder, f"{name}-{k}", np.empty(0, np.uint8))
    for k in range(1 << bits):
        if not os.path.exists(os.path.join(folder, f"n-{k}.npy")):
            _save(folder, f"p-{k}", np.empty(0, np.uint64))
            _save(folder, f"n-{k}", np.empty(0, np.uint8))
    inner = [r for s, r in done.items() if 0 <= s < 1 << bits]
    end_off = discounts(*(sum(r["met"][c] for r in inner) for c in range(4)))
    end_off_sum = sum(d * sum(r["begins"][k] for r in inner) for k, d in enumerate(end_off))
    pair_off = discounts(*done[-1]["met"]) if -1 in done else (0.5, 1.0, 1.5)
    begins = tuple(done[1 << bits]["begins"]) if 1 << bits in done else (0, 0, 0)
    return Model(folder, bits, first, size["docs"], m.tokens, sum(r["pairs"] for r in inner), begins, pair_off, end_off, end_off_sum)


def _numbered(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, n = tokens(texts)
    words, back = np.unique(hashes, return_inverse=True)
    return m.ids(words)[back].astype(np.uint32), n


def score(docs: DataFrame, m: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity:
    one row for each row of ``docs``, repeated rows included. Words are what lies between
    ASCII white space, A-Z in lower case; a text ends in one more token, so an empty or
    null text has one. With nothing learnt every token has the same probability."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    arrow = to_arrow_schema(typed(schema))

    def run(batches):
        for batch in _sliced(batches):
            ids, n = _numbered(m, batch.column(2))
            owner = np.repeat(np.arange(len(n)), n)
            words, back = np.unique(ids, return_inverse=True)
            c = m.of_word(words, "c")
            base = np.log10((c + 1) / (m.tokens + m.vocabulary + 1))
            full = np.bincount(owner, m.log10(ids, n), len(n))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "n_tokens": n,
                    "n_known": np.bincount(owner, (c > 0)[back], len(n)).astype(np.int64),
                    "train_tokens": np.full(len(n), m.tokens),
                    "base_score": np.bincount(owner, base[back], len(n)),
                    "score": full,
                    "perplexity": 10.0 ** np.minimum(-full / n, 300),
                },
                schema=arrow,
            )

    return docs.select(F.col(doc_id).cast("long").alias("_id"), held_out(doc_id).alias("_held"), F.col(text).alias("_text")).mapInArrow(run, schema)


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All of ``docs``, scored by what those outside the held-out fold say."""
    return score(docs, fit(docs.where(~held_out(doc_id)), text), doc_id, text)
