"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

Leaf ``i`` of the tree holds the rank of the pair that starts at symbol ``i``; the
root is the smallest (rank, position), so it names the leftmost pair of lowest
rank. A merge changes three leaves, each updated along one path to the root.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_KEPT, map_batches

NONE = 1 << 62


def byte_letters() -> list[str]:
    """A visible character for each byte: printable ones stand for themselves,
    the others for the code points from 256 on, in byte order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for b in range(256):
        if b in shown:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def merge_all(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge until no pair of ``symbols`` is left in ``pairs``: (a, b) -> (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        p = get((symbols[i], symbols[i + 1]))
        if p:
            tree[size + i] = p[0] * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    if tree[1] == NONE:
        return symbols
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            v = a if a < b else b
            if tree[i] == v:
                break
            tree[i] = v
            i >>= 1

    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        sym[i] = get((sym[i], sym[j]))[1]
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            p = get((sym[i], sym[k]))
            put(i, p[0] * n + i if p else NONE)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            p = get((sym[h], sym[i]))
            put(h, p[0] * n + h if p else NONE)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: ids, merges, word-end mark, pattern, special tokens."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    end: str
    pattern: str
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        split = next(p for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]
        special = {a["content"]: a["id"] for a in t["added_tokens"]}
        return Vocabulary(t["model"]["vocab"], merges, t["model"]["end_of_word_suffix"] or "", split["pattern"]["Regex"], special)


def merge_many(sym: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge_all`` for many words of equal length at once: one row a word, merged
    away symbols become -1. Every round takes the root of each word's tree, applies
    that merge and renews the paths of the three leaves it touches."""
    w, n = sym.shape
    if n < 2:
        return sym
    size = 1 << (n - 1).bit_length()
    sym = np.concatenate([sym.astype(np.int64), np.full((w, 1), -1)], 1)
    after = np.tile(np.arange(1, n + 2), (w, 1))
    before = np.tile(np.arange(-1, n), (w, 1))
    tree = np.full((w, 2 * size), NONE, np.int64)
    rank = table.rank(sym[:, : n - 1], sym[:, 1:n])
    tree[:, size : size + n - 1] = np.where(rank < 0, NONE, rank * n + np.arange(n - 1))
    for i in range(size - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        root = tree[live, 1]
        i = root % n
        j = after[live, i]
        k = after[live, j]
        h = before[live, i]
        sym[live, i] = table.merged[root // n]
        sym[live, j] = -1
        after[live, i] = k
        before[live, k] = i
        mine, left, right = sym[live, i], sym[live, h], sym[live, k]
        ri = np.where(k < n, table.rank(mine, right), -1)
        rh = np.where(h >= 0, table.rank(left, mine), -1)
        # with no symbol before, the first leaf is only renewed
        rows = np.concatenate([live, live, live])
        at = np.concatenate([j, np.where(h >= 0, h, i), i]) + size
        new = np.concatenate([np.full(len(live), NONE), np.where(rh < 0, NONE, rh * n + h), np.where(ri < 0, NONE, ri * n + i)])
        tree[rows, at] = new
        while at[0] > 1:
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        live = live[tree[live, 1] < NONE]
    return sym[:, :n]


class PairTable:
    """Ranks of symbol pairs and the merged symbol of each rank, as sorted arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        key = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(key)
        ranks = np.array([r for r, _ in pairs.values()], np.int64)
        self.keys, self.ranks = key[order], ranks[order]
        self.merged = np.zeros(ranks.max(initial=-1) + 1, np.int64)
        self.merged[ranks] = [m for _, m in pairs.values()]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], -1)


class Encoder:
    """Lower-case, white-space-free BPE as the tokenizer file describes it."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.letters = byte_letters()
        self.names = {i: t for t, i in v.ids.items()} | {i: t for t, i in v.special.items()}
        ids = v.ids
        self.pairs = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(v.merges)}
        self.table = PairTable(self.pairs)
        # white space by the Unicode property, control separators are not part of it
        self.words = regex.compile(v.pattern.replace(r"\s", r"\p{White_Space}"))
        self.quick = self._quick(v.pattern)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    @staticmethod
    def _quick(pattern: str):
        """The same pattern for the standard library, and what it can't be used on:
        numbers that are no decimal digits, control separators, planes beyond the first."""
        plain = pattern.replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+")
        if "\\p" in plain:
            return None
        odd = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No"))
        return re.compile(plain), re.compile("[\x1c-\x1f\U00010000-\U0010ffff" + re.escape(odd) + "]")

    def split(self, text: str) -> list[str]:
        # one letter at a time: no special form of sigma at the end of a word
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.quick and not self.quick[1].search(text):
            return self.quick[0].findall(text)
        return self.words.findall(text)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not remembered yet, those of one length together."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > WORDS_KEPT:
            self.ids.clear()
            self.shown.clear()
            new = list(words)
        vocab, end = self.v.ids, self.v.end
        groups: dict[int, list[tuple[str, list[int]]]] = {}
        for w in new:
            marks = [self.letters[b] for b in w.encode("utf-8", "surrogatepass")]
            marks[-1] += end
            sym = [i for m in marks if (i := vocab.get(m)) is not None]
            groups.setdefault(len(sym), []).append((w, sym))
        for n, group in groups.items():
            if 2 <= n <= 64:
                out = merge_many(np.array([x for _, x in group]), self.table)
                keep = out >= 0
                flat, sizes = out[keep].tolist(), keep.sum(1).tolist()
                at = 0
                for (w, _), size in zip(group, sizes, strict=True):
                    self._put(w, flat[at : at + size])
                    at += size
            else:
                for w, x in group:
                    self._put(w, merge_all(x, self.pairs))

    def _put(self, word: str, ids: list[int]) -> None:
        self.ids[word] = struct.pack(f"<{len(ids)}I", *ids)
        self.shown[word] = " ".join([self.names[i] for i in ids])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, token texts joined by a space) of each text."""
        split: list[list[tuple[str | None, list[str]]]] = []
        for t in texts:
            parts = self.special.split(t or "") if self.special else [t or ""]
            split.append([(p, []) if i % 2 else (None, self.split(p)) for i, p in enumerate(parts)])
        self.learn({w for parts in split for _, ws in parts for w in ws})
        out = []
        for parts in split:
            ids, shown = [], []
            for special, ws in parts:
                if special is not None:
                    ids.append(self.v.special[special].to_bytes(4, "little"))
                    shown.append(special)
                ids += map(self.ids.__getitem__, ws)
                shown += map(self.shown.__getitem__, ws)
            out.append((b"".join(ids), " ".join(filter(None, shown))))
        return out


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded: one row for
    each row of ``docs``, repeated rows included. Null and empty texts have no ids
    and an empty decoded text. The vocabulary, of fixed size, is broadcast."""
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def setup():
        enc = Encoder(share.value)

        def step(b):
            both = enc.encode(b["_text"])
            return {"doc_id": b["_id"], "ids": [a for a, _ in both], "decoded": [d for _, d in both]}

        return step

    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(own, "doc_id long, ids binary, decoded string", setup, 2 << 20)
