"""Quality by pairwise ranking (Bradley-Terry).

Every document becomes a vector of character-class pair shares and repetition
measures. All labelled rows are compared, in slices: each document meets a few of
the other label; the logistic loss on the feature differences gives the weights.
The cut is the quantile of the scores that matches the share of rejected labels,
and scores are scaled so that the cut lies at 0.5.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import nth_values
from ..session import cut
from .common import held_out, labelled, map_batches, sigmoid, sums

SLICE_ROWS = 1024  # documents of the commoner label that are compared in one piece
RARE_ROWS = 64  # documents of the rarer one beside them, if there are as many
PARTNERS = 4
KINDS = 11
WIDTH = KINDS * KINDS + 6


def _kinds() -> np.ndarray:
    """Character class of each code point of the basic plane; others count as the last."""
    by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Sc": 8, "Sm": 8, "Sk": 8, "So": 8}
    k = np.full(0x10001, 10, np.uint8)
    for c in range(0x10000):
        k[c] = by.get(unicodedata.category(chr(c)), 10)
    for c in "\n\r":
        k[ord(c)] = 5
    for c in ".?;:":
        k[ord(c)] = 6
    for c in ",'\"-()":
        k[ord(c)] = 7
    for c in "#%&*@!$":
        k[ord(c)] = 8
    for c in "|/\\<>[]{}=_~^`":
        k[ord(c)] = 9
    return k


def features(text: str, kinds: np.ndarray) -> np.ndarray:
    """Square roots of the shares of class pairs, then length, share of distinct
    words and lines, word length, share of the commonest word, words a line.
    All zero for an empty text."""
    out = np.zeros(WIDTH)
    words = text.split()
    if not words:
        return out
    c = kinds[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)].astype(np.int64)
    if len(c) > 1:
        out[: KINDS * KINDS] = np.sqrt(np.bincount(c[:-1] * KINDS + c[1:], minlength=KINDS * KINDS) / (len(c) - 1))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    n = len(words)
    out[-6:] = (np.log1p(n), len(seen) / n, min(len(text) / n, 50), max(seen.values()) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.spread) @ self.weights
        return sigmoid(self.slope * (raw - self.cut))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(-1, WIDTH).astype(float)


def _newton(of, rows: DataFrame, ridge: float, width: int, rounds: int = 30) -> np.ndarray:
    """Weights at which the summed gradient less ``ridge`` times the weights is zero;
    ``of`` makes a batch and weights to (gradient, Hessian)."""
    w = np.zeros(width)
    for _ in range(rounds):
        got = sums(rows, lambda b, w=w: np.concatenate([np.ravel(x) for x in of(b, w)]), width + width * width)
        step = np.linalg.solve(got[width:].reshape(width, width) + ridge * np.eye(width), got[:width] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, ridge: float = 3.0, slice_rows: int = SLICE_ROWS) -> QualityModel:
    """Learn from all labelled documents outside the held-out fold. Slices of about
    ``slice_rows`` documents of the commoner label are packed with some of the rarer one,
    which stands in several slices if need be, and every document of a slice meets
    ``PARTNERS`` of the other label or more. The driver sees sums only.
    With no pair to compare all weights are zero and every score is 0.5."""

    def setup():
        kinds = _kinds()
        return lambda b: {"_id": b["_id"], "_y": [int(y > 0) for y in b["_y"]], "_x": [features(t, kinds).astype(np.float32).tobytes() for t in b["_text"]]}

    rows = cut(map_batches(labelled(docs, labels, "quality"), "_id long, _y int, _x binary", setup))

    def moments(b):
        x = _matrix(b["_x"])
        return np.concatenate([[len(x), sum(b["_y"])], x.sum(0), (x * x).sum(0)])

    got = sums(rows, moments, 2 + 2 * WIDTH)
    n, n_good = int(got[0]), int(got[1])
    if not n:
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0)
    mean = got[2 : 2 + WIDTH] / n
    spread = np.sqrt(np.maximum(got[2 + WIDTH :] / n - mean * mean, 0)) + 1e-3
    n_bad = n - n_good
    if not n_good or not n_bad:
        return QualityModel(mean, spread, np.zeros(WIDTH), 0.0, 1.0)
    common, rare = int(n_good >= n_bad), min(n_good, n_bad)
    slices = -(-(n - rare) // slice_rows)
    copies = min(slices, -(-RARE_ROWS * slices // rare))
    own = F.when(F.col("_y") == common, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(copies - 1)))
    dealt = rows.select("*", F.explode(own).alias("_k")).withColumn("_b", F.pmod(F.xxhash64("_id", "_x") + F.col("_k"), F.lit(slices)))

    def pack(key, group):
        t = group.sort_by([("_id", "ascending"), ("_x", "ascending")])
        of = lambda y: b"".join(t.filter(pc.equal(t["_y"], y))["_x"].to_pylist())
        return pa.table({"good": pa.array([of(1)], pa.binary()), "bad": pa.array([of(0)], pa.binary())})

    packed = cut(dealt.groupBy("_b").applyInArrow(pack, "good binary, bad binary"))

    def preferences(b, w):
        grad, hess = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
        for good, bad in zip(b["good"], b["bad"], strict=True):
            g, r = (_matrix([good]) - mean) / spread, (_matrix([bad]) - mean) / spread
            if not len(g) or not len(r):
                continue
            more, less = max(len(g), len(r)), min(len(g), len(r))
            for k in range(min(PARTNERS, less)):
                i = np.arange(more)
                j = (i + k * max(1, less // PARTNERS)) % less
                x = g[i] - r[j] if len(g) >= len(r) else g[j] - r[i]
                p = sigmoid(x @ w)
                grad += x.T @ (1 - p)
                hess += (x * (p * (1 - p))[:, None]).T @ x
        return grad, hess

    w = _newton(preferences, packed, ridge, WIDTH)

    def setup_raw():
        return lambda b: {"_g": [0] * len(b["_y"]), "_y": b["_y"], "raw": ((_matrix(b["_x"]) - mean) / spread) @ w}

    raw = cut(map_batches(rows, "_g int, _y int, raw double", setup_raw))
    # the quantile at the share of rejected labels, between two neighbours
    ranks = raw.sparkSession.createDataFrame([(0, k) for k in sorted({n_bad - 1, min(n_bad, n - 1)})], "_g int, rank long")
    at = nth_values(raw, "_g", "raw", ranks).agg(F.avg("raw")).first()[0]

    def line(b, v):
        d = np.array(b["raw"]) - at
        p = sigmoid(d * v[0])
        return [d @ (np.array(b["_y"]) - p)], [(d * d) @ (p * (1 - p))]

    slope = max(float(_newton(line, raw, 0.1, 1)[0]), 1e-3)
    return QualityModel(mean, spread, w, float(at), slope)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``, repeated
    rows included. A null text counts as empty; a null id is never held out."""

    def setup():
        kinds = _kinds()

        def step(b):
            s = model.scores(np.array([features(t or "", kinds) for t in b["_text"]]))
            return {"doc_id": b["_id"], "held_out": [held_out(i) for i in b["_id"]], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return step

    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(own, "doc_id long, held_out boolean, score double, predicted int", setup)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, all columns unchanged."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scored(texts):
        kinds = _kinds()
        import pandas as pd

        return pd.Series(model.scores(np.array([features(t or "", kinds) for t in texts]).reshape(-1, WIDTH)))

    return docs.where(scored(F.col(text)) >= 0.5)
