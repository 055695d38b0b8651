"""Near-duplicate documents by ProbMinHash over weighted word shingles.

The likeness of two documents is the probability Jaccard index of their five-word
shingles, weighted by their counts. Each shingle sends a Poisson process of arrivals
whose rate is its weight; an arrival belongs to a random component, which remembers
its first. Processes stop once they are later than every component's first arrival.
Two documents agree in a component with the probability of their likeness.

Components are joined into bands; documents with an equal band are candidates. Of
each band's group every member meets the smallest one, and verified links give classes.
Groups that still hold several classes are cut into tiles of bounded size. A tile joins
its classes by verified links until no pair of different ones is left unchecked, and
hands on just the links that joined two.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .common import WordHash, boxed, map_batches, mix64, pack_text, shingles, unboxed, unpack_text

ROWS, BANDS = 6, 40
COMPONENTS = ROWS * BANDS
WORDS, LIKENESS = 5, 0.8
TILE, TILE_BYTES = 1500, 16 << 20  # rows and compressed text of one side of a tile
SHINGLES_KEPT = 1 << 22
STEP, SPLIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def signatures(elems: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int = COMPONENTS) -> np.ndarray:
    """The shingle that arrives first in each component of each document (0: none)."""
    first = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, np.uint64)
    clock = np.zeros(len(elems))
    live = np.arange(len(elems))
    turn = 1
    while len(live):
        many = int(min(64, max(1, 8192 // len(live))))
        with np.errstate(over="ignore"):
            x = mix64(elems[live][:, None] + STEP * np.arange(turn, turn + many, dtype=np.uint64)[None, :])
            slot = (mix64(x ^ SPLIT) % np.uint64(m)).astype(np.int64)
        wait = -np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights[live][:, None]
        at = clock[live][:, None] + np.cumsum(wait, 1)
        clock[live] = at[:, -1]
        key = (doc[live][:, None] * m + slot).ravel()
        flat = at.ravel()
        np.minimum.at(first, key, flat)
        won = np.flatnonzero(flat == first[key])
        who[key[won]] = np.repeat(elems[live], many)[won]
        turn += many
        there, back = np.unique(doc[live], return_inverse=True)
        last = first.reshape(docs, m)[there].max(1)
        live = live[at[:, -1] < last[back]]
    return who.reshape(docs, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * STEP
        for r in range(ROWS):
            h = mix64(h * STEP + sig[:, r::ROWS])
    return h.view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two sorted (hashes, counts): over common elements
    d, the sum of 1 / sum over all e of max(x_e / x_d, y_e / y_d). 0 if one is empty."""
    (ha, na), (hb, nb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = na[ia].astype(float), nb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = na.sum() - x.sum() + np.cumsum(x[::-1])[::-1]  # ratios from here on, and what only a has
    below = nb.sum() - y.sum() + np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1 / (above / x + below / y)).sum())


def _sketch(own: DataFrame) -> DataFrame:
    def setup():
        words = WordHash()

        def step(b):
            parts = [shingles(t, words, WORDS) for t in b["_text"]]
            sizes = np.array([len(h) for h, _ in parts])
            n = len(parts)
            sig = signatures(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]).astype(float), np.repeat(np.arange(n), sizes), n)
            keys = band_keys(sig)
            low = sig.astype(np.uint8)
            return {"_node": b["_node"], "_id": b["_id"], "_keys": [k if s else k[:0] for k, s in zip(keys, sizes, strict=True)], "_sig": [r.tobytes() for r in low]}

        return step

    return map_batches(own, "_node long, _id long, _keys array<long>, _sig binary", setup, 1 << 20)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of each row: eight side by side in one word, 30 words a row, so that
    no byte of a sum overflows."""
    same = (a == b).view(np.uint64).sum(-1)
    with np.errstate(over="ignore"):
        return (same * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _least(at_least: float, deviations: float = 0.0) -> int:
    """Equal low bytes to expect at a likeness, chance ones included, less so many
    standard deviations of it."""
    floor = at_least - deviations * (at_least * (1 - at_least) / COMPONENTS) ** 0.5
    return int(np.ceil(COMPONENTS * (floor * (1 - 1 / 256) + 1 / 256) - 1e-9))


def _memo(text_of: Callable) -> Callable:
    """Shingles by key; remembers a bounded number of them."""
    words = WordHash()
    known: dict = {}
    held = 0

    def get(key):
        nonlocal held
        if key not in known:
            if held > SHINGLES_KEPT:
                known.clear()
                held = 0
            known[key] = shingles(text_of(key), words, WORDS)
            held += len(known[key][0])
        return known[key]

    return get


def verified(pairs: DataFrame, texts: DataFrame, at_least: float = LIKENESS) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are as like as that. ``texts`` has one
    compressed text for each of the nodes."""
    both = pairs.join(texts.select(F.col("_node").alias("a"), F.col("_packed").alias("_a")), "a").join(texts.select(F.col("_node").alias("b"), F.col("_packed").alias("_b")), "b")

    def setup():
        get = _memo(unpack_text)

        def step(b):
            ok = [likeness(get(x), get(y)) >= at_least - 1e-12 for x, y in zip(b["_a"], b["_b"], strict=True)]
            return {"a": [v for v, k in zip(b["a"], ok, strict=True) if k], "b": [v for v, k in zip(b["b"], ok, strict=True) if k]}

        return step

    return map_batches(both.select("a", "b", "_a", "_b"), "a long, b long", setup)


def _close(pairs: DataFrame, sigs: DataFrame, at_least: float) -> DataFrame:
    """Pairs whose sketches agree nearly as often as the likeness asks: five standard
    deviations below it, so that none is lost."""
    least = _least(at_least, 5)
    both = pairs.join(sigs.select(F.col("_node").alias("a"), F.col("_sig").alias("_a")), "a").join(sigs.select(F.col("_node").alias("b"), F.col("_sig").alias("_b")), "b")

    def setup():
        def step(b):
            x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, COMPONENTS) for c in ("_a", "_b"))
            ok = np.flatnonzero(_agreeing(x, y) >= least)
            return {"a": [b["a"][i] for i in ok], "b": [b["b"][i] for i in ok]}

        return step

    return map_batches(both.select("a", "b", "_a", "_b"), "a long, b long", setup)


def _joined(sig: np.ndarray, keys: np.ndarray, band: int, cls: np.ndarray, rows: np.ndarray, cols: np.ndarray, close: Callable[[int, int], bool], at_least: float) -> list[tuple[int, int]]:
    """Links between ``rows`` and ``cols`` that join classes ``cls``, until each pair that
    is in different classes, and shares ``band`` as its first one, has been looked at.

    Pairs that are alike by their sketches are checked at once, doubtful ones (down to five
    deviations below) at the end, the most alike first: most are in one class by then.
    """
    least, sure = _least(at_least, 5), _least(at_least)
    cls = cls.copy()
    links: list[tuple[int, int]] = []
    doubt: list[np.ndarray] = []

    def meet(a: int, b: int) -> None:
        if cls[a] != cls[b] and close(a, b):
            links.append((a, b))
            cls[cls == cls[b]] = cls[a]

    same_side = rows is cols
    for r in rows:
        k = cols[cls[cols] != cls[r]]
        k = k[k > r] if same_side else k
        if not len(k):
            continue
        agree = _agreeing(sig[k], sig[r])
        k, agree = k[agree >= least], agree[agree >= least]
        mine = (keys[k] == keys[r]).argmax(1) == band
        k, agree = k[mine], agree[mine].astype(np.int64)
        for x in k[np.argsort(-agree, kind="stable")][: int((agree >= sure).sum())]:
            meet(r, x)
        k, agree = k[agree < sure], agree[agree < sure]
        if len(k):
            doubt.append(np.stack([np.full(len(k), r), k, agree]).astype(np.int32))
    if doubt:
        a, b, agree = np.concatenate(doubt, 1)
        order = np.argsort(-agree, kind="stable")
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            for i in some[cls[a[some]] != cls[b[some]]]:
                meet(a[i], b[i])
    return links


def _across(bands: DataFrame, sketches: DataFrame, texts: DataFrame, comp: DataFrame, at_least: float) -> DataFrame:
    """Verified links that join the classes of one band's group. Groups are cut into
    tiles, and each pair of tiles is one bounded task, which gets each of its texts
    once. A pair is looked at in the first band that its members share."""
    own = bands.join(comp.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("_c", F.coalesce("component", "_node")).drop("component")
    mixed = own.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi")
    own = cut(own.join(mixed.select("_key"), "_key").join(texts.select("_node", F.octet_length("_packed").alias("_size")), "_node"))
    tiles = own.groupBy("_key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("_size") / TILE_BYTES)).alias("_tiles"))
    own = own.drop("_size").join(tiles, "_key").withColumn("_tile", F.pmod(F.xxhash64("_node", F.lit(7)), F.col("_tiles")))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    own = own.select("_key", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"), (F.col("_tile") > F.col("_other")).alias("_right"), "_node", "_c")
    own = own.join(sketches, "_node").join(texts, "_node").select(*own.columns, "_sig", "_keys", "_packed")

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(g["_sig"]), np.uint8).reshape(-1, COMPONENTS)
        keys = np.array(g["_keys"].tolist(), np.int64)
        right = g["_right"].to_numpy(bool)
        rows = np.flatnonzero(~right)
        cols = rows if g["_i"].iat[0] == g["_j"].iat[0] else np.flatnonzero(right)
        packed = g["_packed"].tolist()
        get = _memo(lambda i: unpack_text(packed[i]))
        links = _joined(sig, keys, int(np.argmax(keys[0] == g["_key"].iat[0])), g["_c"].to_numpy(), rows, cols, lambda i, j: likeness(get(i), get(j)) >= at_least - 1e-12, at_least)
        at = np.array(links, np.int64).reshape(-1, 2)
        node = g["_node"].to_numpy()
        return pd.DataFrame({"a": node[at[:, 0]], "b": node[at[:, 1]]})

    return own.groupBy("_key", "_i", "_j").applyInPandas(tile, "a long, b long")


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.withColumn("_node", F.xxhash64("_text"))


def _named(own: DataFrame, at_least: float) -> DataFrame:
    """_node (a distinct text), _id (its smallest id), _n (its rows), component."""
    sketch = _sketch(own.select("_node", "_id", "_text"))
    one = cut(sketch.groupBy("_node").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"), F.first("_keys").alias("_keys"), F.first("_sig").alias("_sig")))
    sigs = one.select("_node", "_sig")
    bands = one.select("_node", F.explode("_keys").alias("_key"))
    pivot = bands.groupBy("_key").agg(F.min("_node").alias("_p"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    bands = cut(bands.join(pivot, "_key"))
    star = bands.where("_node <> _p").select(F.col("_p").alias("a"), F.col("_node").alias("b")).distinct()
    bands = bands.select("_node", "_key")
    texts = cut(_texts(own, bands))
    edges = verified(cut(_close(star, sigs, at_least)), texts, at_least)
    comp = cut(components(edges, src="a", dst="b"))
    more = cut(_across(bands, one.select("_node", "_sig", "_keys"), texts, comp, at_least))
    if not more.isEmpty():
        # stars stand for the links found before
        stars = comp.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        comp = cut(components(more.unionByName(stars), src="a", dst="b"))
    named = one.select("_node", "_id", "_n").join(comp.select(F.col("node").alias("_node"), "component"), "_node", "left")
    return cut(named.withColumn("component", F.coalesce("component", "_node")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: float = LIKENESS) -> DataFrame:
    """doc_id, class_id, class_size: one row for each row of ``docs``.

    Documents linked by a likeness of at least 0.8 form a class, named by its
    smallest doc_id. Equal texts are one class whatever they hold; a null text is an
    empty one. Texts without words have no likeness to other texts; those with fewer
    than five words are one shingle. Null ids sort behind all others. Texts are told
    apart by a 64-bit hash.
    """
    own = _own(docs, doc_id, text)
    named = _named(own, at_least)
    size = named.groupBy("component").agg(F.min("_id").alias("class_id"), F.sum("_n").alias("class_size"))
    label = named.select("_node", "component").join(size, "component")
    return own.select(F.col("_id").alias("doc_id"), "_node").join(label, "_node").select("doc_id", "class_id", "class_size")


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """_node, _packed: one compressed text for each of the nodes."""
    asked = nodes.select("_node").distinct()
    packed = map_batches(own.select("_node", "_text"), "_node long, _packed binary", lambda: lambda b: {"_node": b["_node"], "_packed": [pack_text(t) for t in b["_text"]]})
    return packed.join(asked, "_node", "left_semi").groupBy("_node").agg(F.first("_packed").alias("_packed"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: float = LIKENESS) -> DataFrame:
    """One row of ``docs`` for each class: the one with its smallest id (null ids
    last, then by a hash of the text; of equal rows one). All columns unchanged."""
    named = _named(_own(docs, doc_id, text), at_least)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_node")).alias("_w")).select("_w._id", F.col("_w._node").alias("_win"))
    out = boxed(docs, _mine=F.xxhash64(F.coalesce(docs[text], F.lit(""))), _own_id=docs[doc_id].cast("long"))
    out = out.join(best, (F.col("_mine") == F.col("_win")) & F.col("_own_id").eqNullSafe(F.col("_id")))
    return unboxed(out.dropDuplicates(["_mine"]), docs.columns)
