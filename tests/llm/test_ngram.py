"""The language model against counts and formulas over plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from geolake.llm import ngram

SCHEMA = "doc_id long, text string, lang string, score string, _text string, n_tokens int, held_out int"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, 2) for i, t in rows], SCHEMA)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def split(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]  # None ends a text


def plain(rows):
    """The model as dictionaries: a function from (word before, word) to its probability."""
    train = [split(t) for i, t in rows if not held(i)]
    words = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([False, *t[:-1]], t, strict=True))
    ends = Counter(w for _, w in pairs)
    after = defaultdict(list)
    for (v, _), n in pairs.items():
        after[v].append(n)

    def off(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [k - (k + 1) * y * n[k] / n[k - 1] for k in range(1, 4)]
            if min(d) >= 0:
                return [0, *d]
        return [0, 0.5, 1.0, 1.5]

    d2, d1 = off(list(pairs.values())), off(list(ends.values()))
    total, n = len(pairs), sum(words.values())

    def low(w):
        if not total:
            return 1 / (len(words) + 1)
        left = sum(d1[min(c, 3)] for c in ends.values()) / total
        return max(ends[w] - d1[min(ends[w], 3)], 0) / total + left / (len(words) + 1)

    def p(v, w):
        if v not in after:
            return low(w)
        own = sum(after[v])
        left = sum(d2[min(c, 3)] for c in after[v]) / own
        return max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / own + left * low(w)

    return p, words, n


def expected(rows):
    p, words, n = plain(rows)
    out = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((words[x] + 1) / (n + len(words) + 1)) for x in w)
        out.append((i, held(i), len(w), sum(x in words for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([False, *w[:-1]], w, strict=True))))
    return sorted(out, key=str)


def found(df):
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9), (a, b)


def made(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcXYZé.,") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(i, "".join(w + rnd.choice([" ", "\n", "\t ", "\x0b"]) for w in rnd.choices(words, weights, k=rnd.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("shard_bytes", [1 << 25, 500])
def test_against_dictionaries(spark, shard_bytes):
    rows = made(1, 300)
    docs = frame(spark, rows).repartition(5)
    m = ngram.fit(docs.where(~ngram.held_out()), shard_bytes=shard_bytes)
    same(found(ngram.score(docs, m)), expected(rows))


def test_few_keys_held(spark, monkeypatch):
    """Tasks that send their runs early give the same sums."""
    rows = made(2, 100)
    arrow = pa.array([t for _, t in rows])
    keys = ngram.tokens(arrow)[0]
    monkeypatch.setattr(ngram, "HELD", 64)
    total = Counter()
    batches = [pa.RecordBatch.from_arrays([arrow.slice(k, 7)], ["t"]) for k in range(0, 100, 7)]
    for b in ngram._folded(iter(batches), lambda t: ngram.tokens(t)[0], 3, ngram.to_arrow_schema(ngram.typed(ngram.RUN))):
        for r in b.to_pylist():
            k = np.frombuffer(r["keys"], np.uint64)
            assert (k >> np.uint64(61) == r["shard"]).all()
            total.update(dict(zip(k.tolist(), ngram._unpack(r["counts"]).tolist(), strict=True)))
    assert total == Counter(keys.tolist())


def test_probabilities_sum_to_one(spark):
    rows = made(3, 80)
    m = ngram.fit(frame(spark, [r for r in rows if not held(r[0])]))
    words = sorted({w for _, t in rows if t for w in split(t) if w} | {"never seen".replace(" ", "")})
    known = {w for i, t in rows if not held(i) for w in split(t) if w}
    for before in ["", words[3], "neverseen"]:
        texts = pa.array([f"{before} {w}" for w in words] + [before])
        ids, n = ngram._numbered(m, texts)
        p = 10 ** m.log10(ids, n)
        at = np.cumsum(n) - n + (1 if before else 0)
        given = dict(zip([*words, None], p[at], strict=True))
        assert sum(given[w] for w in known) + given[None] + given["neverseen"] == pytest.approx(1)


def test_edges(spark):
    same(found(ngram.train_and_score(frame(spark, []))), [])
    train = next(i for i in range(100) if not held(i))
    out = next(i for i in range(100) if held(i))
    for rows in (
        [(out, "only held out")],
        [(train, None), (train, ""), (train, " \n")],
        [(None, "a text without an id"), (None, "a text without an id"), (train, "A Text"), (out, "a other Text"), (train, "x" * 3_000_000 + " y"), (train, "long words and long texts " * 100_000), (out, "z" * 2_200_000)],
    ):
        same(found(ngram.train_and_score(frame(spark, rows))), expected(rows))


def test_words_over_window_borders(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab C\n") for _ in range(rnd.randrange(0, 60))) for _ in range(50)]
    whole = ngram.tokens(pa.array(texts))
    monkeypatch.setattr(ngram, "WINDOW", 5)
    assert all((a == b).all() for a, b in zip(ngram.tokens(pa.array(texts)), whole, strict=True))
    words = [w for t in texts for w in split(t)]
    assert len(set(zip(words, whole[0].tolist(), strict=True))) == len(set(words)) == len(set(whole[0].tolist()))
    assert whole[1].tolist() == [len(split(t)) for t in texts]
    assert (ngram.tokens(pa.array(["q", *texts]).slice(1))[0] == whole[0]).all()


def test_pair_hash_is_one_to_one():
    a, b = (np.random.default_rng(s).integers(0, 1 << 32, 1000).astype(np.uint32) for s in (1, 2))
    x, y = ngram.unhash(ngram.pair_hash(a, b))
    assert (x == a).all() and (y == b).all()
