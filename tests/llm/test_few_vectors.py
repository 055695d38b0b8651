"""Small tables and shared ids in the search for nearest vectors."""

import numpy as np
import pytest

from geolake.llm import ann


def found(spark, rows, asked, k=20, **kw):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest(df, df.where(asked), k=k, **kw).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def expected(rows, queries, k=20):
    out = {}
    for q, v in rows:
        if q in queries:
            best = {}
            for i, w in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(w, v, strict=True):
                        s += a * b
                    best[i] = max(best.get(i, -np.inf), s)
            out[q] = [(n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("n", [15, 21, 40])
def test_all_candidates_of_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    assert found(spark, rows, "vec_id % 7 = 0") == expected(rows, set(range(0, n, 7)))


@pytest.mark.parametrize("few", [100, 0])
def test_one_id_held_by_many_vectors(spark, monkeypatch, few):
    """The best vectors all belong to one id: the others still come."""
    monkeypatch.setattr(ann, "FEW", few)
    rng = np.random.default_rng(1)
    rows = [(0, [1.0] * 8)] + [(1, (np.ones(8) * 5 + rng.normal(size=8) * 0.1).tolist()) for _ in range(40)] + [(i, rng.normal(size=8).tolist()) for i in range(2, 40)]
    assert found(spark, rows, "vec_id = 0", share=100.0) == expected(rows, {0})
