"""Toxic passages as maximum-scoring segments.

A word stands for itself and for its beginnings of three to eight letters, so that
inflected forms share evidence. The weight of such a form is its log-odds in toxic
against other labelled documents under a Dirichlet prior with the proportions of
the whole corpus; forms whose weight is clear of its own error are kept, a word
takes its best one, every other word costs a fixed drift. A linear
scan finds all maximal segments; extreme-value statistics turn their scores into
expected numbers of chance finds, which are summed over the significant ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_KEPT, fit_sample, held_out, logistic, map_batches, sigmoid

FIT_ROWS = 20_000
PRIOR = 10_000.0
CLEAR = 4.0
DRIFT = 0.25
SURE = math.log(20)
STEMS = range(3, 9)
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence whose
    tokens at ``hits`` score the given positive weight and all others ``-drift``.

    The scan keeps candidate segments with the running totals before and after
    them; a run of other tokens only lowers the total, so it is taken in one step.
    """
    found: list[list[float]] = []  # first, last, total before, total after
    total, at = 0.0, -1
    for i, s in hits:
        total -= drift * (i - at - 1)
        at = i
        cur = [i, i, total, total + s]
        total += s
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
        found.append(cur)
    return [(int(a), int(b), r - left) for a, b, left, r in found]


def forms(word: str) -> list[str]:
    """The tokens that a word stands for: itself (marked) and its beginnings."""
    return [word + "$", *(word[:k] for k in STEMS if k <= len(word))]


class FormCache(dict):
    """word -> what ``of`` makes of it; remembers a bounded number of words."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        v = self[word] = self.of(word)
        return v


@dataclass(frozen=True)
class ToxicModel:
    weights: dict[str, float]
    drift: float
    lam: float
    log_k: float
    intercept: float = -30.0
    slope: float = 0.0
    clear: float = SURE

    def best(self) -> FormCache:
        """Weight of a word, remembered."""
        return FormCache(lambda w: max((self.weights.get(f, 0.0) for f in forms(w)), default=0.0))

    def passages(self, words: list[str], best: FormCache) -> list[tuple[int, int, float, float]]:
        """(first word, last word, score, -log of the expected number by chance) of significant segments."""
        hits = [(i, s) for i, w in enumerate(words) if (s := best[w])]
        out = []
        for a, b, s in segments(hits, self.drift):
            sure = self.lam * s - self.log_k - math.log(max(len(words), 1))
            if sure > self.clear:
                out.append((a, b, s, sure))
        return out

    def evidence(self, words: list[str], passages: list[tuple[int, int, float, float]]) -> float:
        """Sum over the different passages; a repeated one counts once."""
        return sum({tuple(words[a : b + 1]): sure for a, b, _, sure in passages}.values())

    def score(self, evidence: float) -> float:
        return float(sigmoid(np.array(self.intercept + self.slope * evidence)))


def corpus_counts(docs: DataFrame, wanted: set[str], text: str = "_text") -> tuple[dict[str, int], int]:
    """Counts over all documents of the ``wanted`` forms, and the number of words.
    A document counts a word once, so that one which repeats a rare word gives it
    no weight. Summed in each batch first; ``wanted`` holds forms of the sample only."""
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def setup():
        keep = share.value
        own = FormCache(lambda w: [f for f in forms(w) if f in keep])

        def step(b):
            c: Counter = Counter()
            n = 0
            for t in b[text]:
                words = set(words_of(t))
                n += len(words)
                for w in words:
                    for f in own[w]:
                        c[f] += 1
            return {"form": [None, *c.keys()], "n": [n, *c.values()]}

        return step

    part = map_batches(docs.select(text), "form string, n long", setup, 32 << 20)
    got = {r["form"]: int(r["n"]) for r in part.groupBy("form").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(None, 0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, prior: float = PRIOR, clear: float = CLEAR, drift: float = DRIFT) -> ToxicModel:
    """Learn from at most ``rows`` labelled documents; the prior's proportions come
    from all of ``docs``. What reaches the driver are forms that stand more often in
    the sample's toxic documents. Without toxic and other labels no word has a
    weight and every score is the lowest."""
    sample = fit_sample(docs, labels, "toxic", rows)

    def setup():
        def step(b):
            c = {0: Counter(), 1: Counter()}
            for t, y in zip(b["_text"], b["_y"], strict=True):
                words = set(words_of(t))
                for w in words:
                    c[int(y > 0)].update(forms(w))
                c[int(y > 0)][""] += len(words)
            both = list(c[0].keys() | c[1].keys())
            return {"form": both, "y1": [c[1][w] for w in both], "y0": [c[0][w] for w in both]}

        return step

    own = map_batches(sample, "form string, y1 long, y0 long", setup, 32 << 20).groupBy("form").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    sums = own.where("form = ''").first()
    none = ToxicModel({}, drift, 1.0, 0.0)
    n1, n0 = (int(sums["y1"]), int(sums["y0"])) if sums else (0, 0)
    if not n1 or not n0:
        return none
    more = own.where((F.col("form") != "") & (F.col("y1") >= 3) & (F.col("y1") * n0 > F.col("y0") * (2 * n1)))
    cand = {r["form"]: (int(r["y1"]), int(r["y0"])) for r in more.collect()}
    counts, total = corpus_counts(docs.select(F.col("text").alias("_text")), set(cand))
    weights = {}
    for form, (y1, y0) in cand.items():
        a = prior * counts.get(form, 0) / max(total, 1)
        s = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a)) if y0 + a > 0 else 0.0
        if s > 0 and s / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= clear:
            weights[form] = s
    if not weights:
        return none

    def found():
        best = ToxicModel(weights, drift, 1.0, 0.0).best()

        def step(b):
            out = {"_y": b["_y"], "n": [], "at": [], "s": []}
            for t in b["_text"]:
                w = words_of(t)
                hits = [(i, s) for i, x in enumerate(w) if (s := best[x])]
                out["n"].append(len(w))
                out["at"].append([i for i, _ in hits])
                out["s"].append([s for _, s in hits])
            return out

        return step

    got = map_batches(sample.select("_y", "_text"), "_y int, n long, at array<int>, s array<double>", found).collect()
    clean = [r for r in got if r["_y"] <= 0]
    words = max(1, sum(r["n"] for r in clean))
    lam = _lambda(Counter(round(s, 6) for r in clean for s in r["s"]), words, drift)
    segs = [segments(list(zip(r["at"], r["s"], strict=True)), drift) for r in got]
    log_k = math.log((1 + sum(len(x) for x, r in zip(segs, got, strict=True) if r["_y"] <= 0)) / words)
    model = ToxicModel(weights, drift, lam, log_k)

    def weighed():
        best = model.best()

        def step(b):
            words = [words_of(t) for t in b["_text"]]
            return {"_y": b["_y"], "ev": [model.evidence(w, model.passages(w, best)) for w in words]}

        return step

    got = map_batches(sample.select("_y", "_text"), "_y int, ev double", weighed).collect()
    ev = np.array([r["ev"] for r in got])
    y = np.array([float(r["_y"] > 0) for r in got])
    order = np.lexsort((y, ev))
    b = logistic(np.stack([np.ones(len(ev)), ev], 1)[order], 0.01, y=y[order], rounds=60)
    return replace(model, intercept=float(b[0]), slope=max(0.0, float(b[1])))


def _lambda(hits: Counter, words: int, drift: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over a clean document's words."""
    s, n = np.array(sorted(hits)), np.array([hits[k] for k in sorted(hits)], float)
    if not len(s):
        return 1.0
    p, rest = n / words, max(0.0, 1 - n.sum() / words)
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(-x * drift) - 1)
    if (p * s).sum() - rest * drift >= 0:
        return 1e-3
    lo, hi = 1e-9, 1.0
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages: one row for each row of
    ``docs``, repeated rows included. Null and empty texts have no passage and get
    the lowest score. ``passages`` holds first word, last word and score."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        m = share.value
        best = m.best()

        def step(b):
            out = {"doc_id": b["_id"], "held_out": [held_out(i) for i in b["_id"]], "score": [], "predicted": [], "passages": []}
            for t in b["_text"]:
                words = words_of(t)
                found = m.passages(words, best)
                s = m.score(m.evidence(words, found))
                out["score"].append(s)
                out["predicted"].append(int(s >= 0.7))
                out["passages"].append([{"first_word": x[0], "last_word": x[1], "score": x[2]} for x in found])
            return out

        return step

    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(own, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first_word:int,last_word:int,score:double>>", setup)
