"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import os
import random
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.llm import ann, bpe, fingerprint, html, lines, mix, neardup, quality, suffix, toxicity
from geolake.llm.common import WordHash, held_out, shingles, table
from geolake.llm.queries import tokenizer_path
from tools.check import norm

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _node string, _pos int, score string, _row int, held_out int, _drop string, _src int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", 1, "s", 2, 3, "d", 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and blank texts, one row twice, one id with two texts, a null id, a long text."""
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t", None), (3, "one two three four five six", "b"), (3, "one two three four five six", "b"), (4, "zz", None), (4, "zz top\nzz top", "b"), (None, "lost words here", "c"), (9, "long line of words \n" * 20000, "c")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, "/root/testdata/sf0.01", "labels").cache()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(tokenizer_path())


# --- fingerprints ----------------------------------------------------------------


def test_fingerprint_edits(spark, docs):
    got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = fingerprint.edited(t, n)
        assert len(e) <= len(t) and got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].edited_fingerprint == fingerprint.fingerprint(e.encode())
    near = [r.near_edited for r in got.values() if r.n_chars > 200]
    far = [r.near_next for r in got.values() if r.n_chars > 200]
    assert np.mean(near) > 0.45 and np.mean(far) < 0.1


def test_fingerprint_edges(spark, edge, none):
    got = fingerprint.with_edits(edge).collect()
    assert len(got) == 9 and fingerprint.with_edits(none).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprint.with_edits(edge.where("doc_id = 9")).first()
    text = "long line of words \n" * 20000
    assert one.edited_sha256 == hashlib.sha256(fingerprint.edited(text, text).encode()).hexdigest()


def test_common_length():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(70))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert fingerprint.common_length(a, b) == row[-1]


def test_fingerprint_likeness():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    a = " ".join(words)
    b = " ".join(words[:1400] + ["other"] + words[1400:])
    c = " ".join(rnd.sample(words, 3000))
    f = [fingerprint.fingerprint(x.encode()) for x in (a, b, c)]
    assert fingerprint.likeness(f[0], f[0]) == 1 and 0.8 < fingerprint.likeness(f[0], f[1]) < 1 and fingerprint.likeness(f[0], f[2]) < 0.3


def test_fingerprint_of_repeated_lines():
    """The last half replaced: the letters of the whole text count."""
    rnd = random.Random(12)
    for k in range(20):
        a, b = ("".join(rnd.choice("abcdefgh ") for _ in range(79)) + "\n" for _ in "ab")
        p, q = (fingerprint.fingerprint(x.encode()) for x in (a * 10_000, a * 5_000 + b * 5_000))
        assert fingerprint.likeness(p, q) <= 0.9, (k, p[:40], q[:40])
    line = "one line of a text that says it again and again, with no end in sight at all..\n"
    p = fingerprint.fingerprint((line * 10_000).encode()).split(":")
    assert len(p[1]) >= 10_000


# --- near-duplicates -------------------------------------------------------------


def exact_likeness(a, b):
    (ha, na), (hb, nb) = a, b
    x, y = dict(zip(ha.tolist(), na.tolist(), strict=True)), dict(zip(hb.tolist(), nb.tolist(), strict=True))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def brute_classes(rows, at_least=0.8):
    w = WordHash()
    sets = [shingles(t, w) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(np.intersect1d(sets[i][0], sets[j][0], True)) and exact_likeness(sets[i], sets[j]) >= at_least - 1e-12):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(d, low[r])
    return [low[find(i)] for i in range(len(rows))]


def planted(rnd):
    """Groups of edited copies, links through a middle text, repeated words."""
    vocab = ["w%d" % i for i in range(500)]
    rows = []
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(120)]
        rows.append(base)
        chain = base
        for _ in range(rnd.randrange(6)):
            chain = chain[:]
            chain[rnd.randrange(120)] = "edit%d" % rnd.randrange(99)
            rows.append(chain)
        rows.append(base[:60] + [rnd.choice(vocab) for _ in range(60)])
        rows.append(base[:6] * 9)
        rows.append(base[:6] * 10)
    return [" ".join(r) for r in rows]


def test_likeness_is_exact():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ((np.array(sorted(rnd.sample(range(12), k := rnd.randrange(1, 9))), np.uint64), np.array([rnd.randrange(1, 5) for _ in range(k)])) for _ in "ab")
        assert neardup.likeness(a, b) == pytest.approx(exact_likeness(a, b), abs=1e-12)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(1, 1 << 60, 300, dtype=np.uint64))
    b = np.concatenate([a[:240], rng.integers(1, 1 << 60, 60, dtype=np.uint64)])
    wa, wb = rng.integers(1, 4, len(a)).astype(float), None
    wb = np.concatenate([wa[:240], np.ones(60)])
    sig = neardup.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], [len(a), len(b)]), 2, 4000)
    o = np.argsort(b)
    want = exact_likeness((a, wa), (b[o], wb[o]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_near_duplicates_against_brute_force(spark, docs):
    texts = planted(random.Random(7))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r.doc_id, r.text) for r in docs.limit(60).collect()]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_near_duplicates_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    rows = list(enumerate(planted(random.Random(8))))
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_near_duplicates_edges(edge, none):
    got = neardup.classes(edge).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert len(got) == 9 and by[0] == by[1] == {0} and by[3] == {3} and by[2] == {2} and by[None] == {None}
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (False, 4), (False, 9), (True, 0)]


# --- nearest vectors -------------------------------------------------------------


def test_nearest_recall_and_scores(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = ann.nearest(e, e.where("vec_id % 20 = 0")).toPandas()
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    hit = n = 0
    for q, g in got.groupby("query_id"):
        s = sorted(((-float(np.add.accumulate(v * x[q])[-1]), i) for i, v in x.items() if i != q))[:20]
        hit += len({i for _, i in s} & set(g.vec_id))
        n += 20
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-9 for r in g.itertuples())
    assert n == 500 and hit / n >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (20, [-3.0, 0.0]), (9, [])] + [(100 + i, [0.5, 0.5]) for i in range(60)]
    e = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, _id int, rank int")
    got = ann.nearest(e, e.where("vec_id in (0, 4, 8, 20)")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {0, 20}
    assert by[0] == [(2, 5.0), (1, 1.0)] + [(100 + i, 0.5) for i in range(18)]
    assert by[20][:3] == [(100, -1.5), (101, -1.5), (102, -1.5)] and len(by[20]) == 20
    few = ann.nearest(e.where("vec_id < 3"), e.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 2), (2, 1)]
    assert ann.nearest(e.where("false"), e.where("false")).count() == 0


# --- repeated bytes --------------------------------------------------------------


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        out.append(bytes(np.frombuffer(b, np.uint8)[keep]))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        s = np.concatenate([rng.integers(1, k + 1, n), [0]])
        sa, text = suffix.suffix_array(s), s.tolist()
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        phi, lcp = suffix.common_prefixes(s, sa)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            m = 0
            while text[a + m : a + m + 1] == text[b + m : b + m + 1] != []:
                m += 1
            assert phi[a] == b and lcp[a] == m


def repeated_corpus(rnd):
    vocab = ["alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "θ"]
    word = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(50)) for _ in range(n))
    shared = [word(60) for _ in range(4)]
    short = "x" * 150
    rows = []
    for i in range(60):
        parts = [word(rnd.randrange(30))]
        if i % 3 == 0:
            parts.append(rnd.choice(shared)[rnd.randrange(40) :])
        if i % 5 == 0:
            parts.append(short)
        parts.append(word(rnd.randrange(30)))
        rows.append(" ".join(parts))
    return rows + ["ab" * 400, "q" * 700, "q" * 199, rows[3], rows[4], None, ""]


def test_repeats_against_brute_force(spark, monkeypatch):
    texts = repeated_corpus(random.Random(5))
    want = brute_removed(texts, 200)
    for crowded, shard in ((2000, 1 << 20), (2, 3000)):  # the second run splits groups and shards
        monkeypatch.setattr(suffix, "CROWDED", crowded)
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
        assert [bytes(got[i].kept) for i in range(len(texts))] == want
        for i, t in enumerate(texts):
            n = len((t or "").encode())
            assert got[i].n_bytes == n and n - sum(s.end - s.start for s in got[i].spans) == len(want[i])


def test_repeats_edges(edge, none):
    got = suffix.remove_repeats(edge).collect()
    assert len(got) == 9 and suffix.remove_repeats(none).count() == 0
    long = next(r for r in got if r.doc_id == 9)
    assert bytes(long.kept) == b"" and len(long.spans) == 1


def runs_of(segments, copied, length):
    return {(int(j), int(at) + d) for j, at, n in zip(*suffix.starts_twice(segments, copied, length), strict=True) for d in range(int(n))}


def test_shard_sorts_only_what_may_repeat(monkeypatch):
    sizes = []
    real = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s: sizes.append(len(s)) or real(s))
    rnd = random.Random(2)
    noise = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    piece, passage = noise(48), noise(210)
    apart = [noise(150) + piece + noise(150) for _ in range(50)]
    assert runs_of(apart, [False] * 50, 200) == set() and not sizes  # a shared piece alone is not sorted
    both = [*apart, noise(100) + passage, passage + noise(100)]
    assert runs_of(both, [False] * 52, 200) == {(50, 100 + i) for i in range(11)} | {(51, i) for i in range(11)}
    assert max(sizes) <= 2 * 211 + 1


@pytest.mark.parametrize("bits", [0, 3, 2**64 - 1])  # equal hashes of different strings change nothing
def test_shard_against_brute_force(bits, monkeypatch):
    real = suffix._grams
    monkeypatch.setattr(suffix, "_grams", lambda c, k: real(c, k) & np.uint64(bits))
    rnd = random.Random(bits % 11)
    letters = lambda n: bytes(rnd.choice(b"\0\1\xff") for _ in range(n))
    for _ in range(100):
        length, base = rnd.choice([3, 5, 48]), letters(90)
        segments = [letters(rnd.randrange(12)) + base[rnd.randrange(60) : rnd.randrange(91)] + letters(rnd.randrange(12)) for _ in range(rnd.randrange(1, 9))]
        copied = [rnd.random() < 0.3 for _ in segments]
        seen = Counter(x[i : i + length] for x in segments for i in range(len(x) - length + 1))
        want = {(j, i) for j, x in enumerate(segments) if not copied[j] for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1}
        assert runs_of(segments, copied, length) == want


def test_repeats_of_copied_and_single_segments(spark, monkeypatch):
    """One passage whole, in part and beside other bytes: copies and single strings of one group."""
    rnd = random.Random(8)
    noise = lambda n: "".join(chr(rnd.randrange(33, 127)) for _ in range(n))
    passage = noise(700)
    texts = [passage, passage, passage[100:400], noise(80) + passage[150:500] + noise(80), noise(300), passage[:199], noise(250) * 2]
    for shard in (1 << 20, 500):
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts, 200)


def test_hot_pieces_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 100, raising=False)
    rows = spark.range(4000).selectExpr("if(id < 3900, 1L, id) as _key", "1L as _seg", "id as _node", "id % 7 as _at").union(spark.sql("select 4000L, 1L, 1L, 1L"))
    rows = rows.unionByName(rows.where("_key = 3999"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix._shared(rows)
        assert sorted({r._key for r in got.collect()}) == [1, 3999] and got.count() == 3902
        tasks = [r["count"] for r in got.where("_key = 1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 3900 and max(tasks) < 2000


def test_repeats_with_hot_pieces(spark, monkeypatch):
    texts = repeated_corpus(random.Random(6))
    want = brute_removed(texts, 200)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for crowded, hot, listed in ((2000, 1, 10**6), (2, 3, 10**6), (2000, 1, 20)):  # the last one lists few keys
        for name, value in (("CROWDED", crowded), ("HOT", hot), ("LISTED", listed)):
            monkeypatch.setattr(suffix, name, value, raising=False)
        got = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


# --- scores ----------------------------------------------------------------------


@pytest.mark.parametrize("what, label, at, least, sf", [(quality, "quality", 0.5, 0.95, "sf0.01"), (toxicity, "toxic", 0.7, 0.97, "sf0.1")])
def test_held_out_accuracy(spark, what, label, at, least, sf):
    d, labels = (table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "labels"))
    model = what.fit(d, labels)
    got = what.score(d, model).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(held_out)).all() and ((got.score >= at) == (got.predicted == 1)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[label]).mean() >= least
    again = what.score(d, what.fit(d, labels)).select("doc_id", "score").toPandas()
    assert norm(again) == norm(got[["doc_id", "score"]])


@pytest.mark.parametrize("what", [quality, toxicity])
def test_score_edges(spark, edge, none, labels, what):
    few = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels.where("false"), few):
        got = what.score(edge, what.fit(edge, lab)).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
        assert not next(r for r in got if r.doc_id is None).held_out
    assert what.score(none, what.fit(none, labels)).count() == 0


def test_segments_are_all_maximal():
    """Every maximal segment, by trying them all: no prefix or suffix of it has a sum of
    zero or less, and none that holds it has that property."""
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.randrange(1, 14)
        score = [rnd.choice([1.5, 0.7, -0.5, -0.5]) for _ in range(n)]
        hits = [(i, s) for i, s in enumerate(score) if s > 0]
        run = np.concatenate([[0], np.cumsum(score)])
        ok = [(a, b) for a in range(n) for b in range(a, n) if all(run[a] < run[c] for c in range(a + 1, b + 2)) and all(run[b + 1] > run[c] for c in range(a, b + 1))]
        want = sorted(x for x in ok if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in ok))
        got = toxicity.segments(hits, 0.5)
        assert [(a, b) for a, b, _ in got] == want
        assert all(abs(s - (run[b + 1] - run[a])) < 1e-9 for a, b, s in got)


def test_keep_good(spark, edge, labels):
    model = quality.QualityModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros(quality.WIDTH), 0.0, 1.0)
    assert quality.keep_good(edge, model).count() == 9 and quality.keep_good(edge, model).columns == edge.columns


# --- byte pairs ------------------------------------------------------------------


ODD = ["", "  ", "a²b ½ x", "Σίσυφος ΟΔΟΣ", "<|endoftext|>Hi<|startoftext|> x", "a\x1cb c", "it's we'll 'DON'T' a_b __x", "İstanbul ǅ ﬁ", "日本語 テキスト 123４５", "🙂🙂 x", "x" * 500 + " " + "ab" * 300, "!!!???...,,,", "Ⅷ ⅷ ①", "a　b\x85c"]


def test_encoder_is_exact(docs, vocabulary):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path())
    want.no_truncation()
    want.no_padding()
    texts = ODD + [r.text for r in docs.select("text").collect()]
    for t, (ids, shown) in zip(texts, bpe.Encoder(vocabulary).encode(texts), strict=True):
        e = want.encode(t, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(e)}I", *e) and shown == want.decode(e, skip_special_tokens=False)


def test_merging_orders_agree(vocabulary):
    enc = bpe.Encoder(vocabulary)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 17, 40):
        sym = rng.integers(320, 346, (50, n))
        out = bpe.merge_many(sym.copy(), enc.table)
        for row, got in zip(sym.tolist(), out.tolist(), strict=True):
            plain = list(row)
            while True:
                ranked = [(enc.pairs[p][0], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in enc.pairs]
                if not ranked:
                    break
                i = min(ranked)[1]
                plain[i : i + 2] = [enc.pairs[(plain[i], plain[i + 1])][1]]
            assert [x for x in got if x >= 0] == plain == bpe.merge_all(row, enc.pairs)


def test_encode_edges(edge, none, vocabulary):
    got = bpe.encode(edge, vocabulary).collect()
    assert len(got) == 9 and bpe.encode(none, vocabulary).count() == 0
    assert all(bytes(r.ids) == b"" and r.decoded == "" for r in got if r.doc_id in (0, 1, 2))


# --- lines -----------------------------------------------------------------------


def brute_lines(rows):
    first, by = {}, defaultdict(list)
    for d, t in sorted((d, t) for d, t in rows if t is not None):
        for i, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (d, i))
    for line in first:
        by[len(line)].append(line)
    near = {x for x in first if any(first[o] < first[x] and min(len(o), len(x)) >= lines.SHORT and lines.within_one(o, x) for n in (-1, 0, 1) for o in by[len(x) + n] if o != x)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or first[x] == (d, i) and x not in near) for d, t in rows}


def test_lines_against_brute_force(spark, docs):
    rnd = random.Random(5)
    rows = [(d, "\n".join("".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 9]))) for _ in range(rnd.randrange(5))) if d % 17 else None) for d in range(120)]
    for d in range(120, 200):
        out = []
        for _ in range(4):
            b = list("The quick brown fox %d jumps over" % rnd.randrange(40) + rnd.choice(["", "é", "ü x"]))
            p = rnd.randrange(len(b))
            b[p : p + rnd.randrange(2)] = rnd.choice(["Z", "", "QQ"])
            out.append("".join(b))
        rows.append((d, "\n".join(out)))
    rows += [(1000 + r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows)
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == want


def test_short_lines_must_be_equal(spark):
    rows = [(0, "1.\n{\nStep one\nStep 10"), (1, "2.\n}\nStep two\nStep 11\n1."), (2, "Step one.\nStep onx")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == {0: rows[0][1], 1: "2.\n}\nStep two\nStep 11", 2: ""}


def test_within_one():
    rnd = random.Random(2)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(6))) for _ in "ab")
        assert lines.within_one(a, b) == (far(a, b) <= 1)


def test_lines_edges(edge, none):
    got = lines.dedup_lines(edge)
    rows = got.collect()
    assert got.columns == edge.columns and len(rows) == 9 and lines.dedup_lines(none).count() == 0
    assert [r.text for r in rows if r.doc_id == 3] == ["one two three four five six"] * 2
    assert [r.text for r in rows if r.doc_id == 0] == [None] and next(r for r in rows if r.doc_id == 2).text == " \n\t"
    assert next(r for r in rows if r.doc_id == 9).text == "long line of words \n"


# --- mixing ----------------------------------------------------------------------


def share_out(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
        left -= sum(out[s] for s in over)
    return out


def test_mix_targets_and_sums(spark, docs, edge):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(40), rnd.choice(["big"] * 20 + ["b", "c", None, "tiny", "z", "y", "x"])) for i in range(1500)] + [(5000, "", "void")]
    for d in (docs, edge, frame(spark, rows)):
        got = mix.mix(d).toPandas()
        src = d.select(F.col("doc_id"), F.col("source")).toPandas()
        sizes = d.groupBy("source").agg(F.sum(mix.words()).alias("n")).collect()
        want = share_out({r.source: r.n for r in sizes})
        assert len(got) == len(src) and (got.taken <= 3 * got["size"]).all()
        for r in sizes:
            part = got[np.isclose(got.target, want[r.source]) & (got.source_size == r.n)]
            assert len(part)
        assert got.target.mul(got["size"].where(got.source_size > 0, 0)).div(got.source_size.where(got.source_size > 0, 1)).sum() == pytest.approx(sum(r.n for r in sizes), rel=1e-9, abs=1e-9)
    by = got.merge(src, on="doc_id", how="left").groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
    assert (abs(by.taken - by.target) <= 40).all()


def test_mix_is_its_sql_and_applies(spark, docs, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = mix.mix(docs).toPandas()
    assert norm(got) == norm(con.execute(mix.SQL).df()) and norm(got) == norm(mix.mix(docs).toPandas())
    out = mix.apply_mix(docs)
    want = Counter({r.doc_id: r.copies for r in got.itertuples() if r.copies})
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.select("doc_id").collect()) == want
    assert mix.mix(none).count() == 0 and mix.apply_mix(none).count() == 0


# --- pages -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a&amp;b <b>x</b>y<script>if(a<b){'</p>'}</script><div class='ad'>ad</div><li>1<li>2", "a&b xy 1 2"),
        ("<table><tr><td>q<td>r</table> <a href=\"x>y\">z</a> 5 < 6 & 7 > 3 <!-- c --> t", "q r z 5 < 6 & 7 > 3 t"),
        ("<body><nav>n</nav><article><h1>T</h1><p>One&nbsp;two<br>three<p>Four<div class=\"comments\"><p>no</div></article><footer>f</footer>", "T One two three Four"),
        ("<title>t</title><main><form>f</form><p>x <em>y</em>z</p></main> out <aside>s</aside>", "x yz"),
        ("<article><p>1</p><div id='cookie-notice'>c</div><article class='comment'>no</article></article>", "1"),
        ("<div role=navigation>n</div>text<style>p{}</style><div hidden>h</div>", "text"),
        ("", ""),
        ("<", "<"),
        ("<article><p>open <b>never closed", "open never closed"),
        ("<article><h2 id='search'>S</h2><p class='share-price'>up</p><section id='related-work'><p>R</p></section><ul><li class='menu'>soup</ul></article>", "S up R soup"),
        ("<article><p>x</p><section id='comments'>c</section><section class='related'>r</section><div class='share-links'><p>s</p></div></article>", "x"),
        ("<div><h2 id='search'>S</h2><p>x</p><p class='copyright'>c</p></div>", "S x"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_templates_go_and_quotes_stay(spark):
    """A box on most pages of a host is template; a paragraph in articles is not."""
    rows = [(i, f"http://a.example/{i}", f"<div><b>Our site</b> since 1999</div><div><p>Story {i}</p><p>shared quote</p></div>" if i % 2 else f"<article><p>Story {i}</p><p>shared quote</p></article>") for i in range(20)]
    rows += [(100, "http://b.example/", "<div><b>Our site</b> since 1999</div><p>alone</p>"), (101, None, "<p>no host</p>"), (102, "http://[bad", None), (103, "http://a.example/1", rows[1][2])]
    pages = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, _host int, _html string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[2].text == "Story 2 shared quote" and "Our site" not in got[3].text and "Story 3" in got[3].text
    assert got[100].text == "Our site since 1999 alone" and got[101].text == "no host" and got[102].text == "" and got[102].n_chars == 0
    assert html.extract(pages.where("false")).count() == 0


def test_templates_of_mixed_hosts(spark):
    """A menu on all of the few pages without an article, and the boxes of four designs
    with a quarter of a host's pages each, inside articles and on pages without."""
    menu, design = "<div>Home Contact</div>", [f"<div>Look {k} <i>of ours</i></div>" for k in range(4)]
    rows = [(i, f"http://mixed.example/{i}", f"<article><p>Story {i}</p></article>" if i % 5 else f"{menu}<p>Story {i}</p>") for i in range(60)]
    rows += [(1000 + i, f"http://plain.example/{i}", f"{design[i % 4]}<div><p>Story {i}</p><p>quote {i % 4}</p></div>") for i in range(4 * html.ENOUGH)]
    rows += [(2000 + i, f"http://inside.example/{i}", f"<article><p>Story {i}</p>{design[i % 4]}<p>quote {i % 4}</p></article>") for i in range(4 * html.ENOUGH)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i % 1000}" + (f" quote {i % 4}" if i >= 1000 else "") for i, _, _ in rows}


def test_main_text_of_the_pages(spark):
    import re
    from html import unescape

    got = {r.page_id: r.text for r in html.extract(table(spark, DIR, "pages")).collect()}
    inline = lambda m: "" if m[2] in ("b", "i", "em", "a", "span", "strong") else " "
    for r in table(spark, DIR, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<(/?)(\w+)[^>]*>", inline, body)).split())


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Two rows of one label among many of the other stand in every slice, and no row is left out of the fit."""
    seen = []
    plain = quality.sums

    def watched(rows, of, width):
        got = plain(rows, of, width)
        seen.append(got[:2])
        return got

    monkeypatch.setattr(quality, "sums", watched, raising=False)
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 10000 = 3, '|| ## 00 |', 'plain words and more of them') as text")
    labels = spark.range(n).selectExpr("id as doc_id", "if(id % 10000 = 3, 0, 1) as quality")
    model = quality.fit(docs, labels)
    learnt = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    assert tuple(seen[0]) == (learnt.count(), learnt.where("quality = 1").count())
    s = {r.bad: r.p for r in quality.score(docs, model).selectExpr("doc_id % 10000 = 3 as bad", "predicted as p").distinct().collect()}
    assert s == {True: 0, False: 1}
