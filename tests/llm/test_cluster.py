"""Filtered clustering against all distances."""

import hashlib

import numpy as np
import pytest

from geolake.llm import cluster

SCHEMA = "vec_id long, embedding array<float>, cluster int, _v string, _id int, distance string"


def frame(spark, rows):
    """Vectors with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 9, "x", 5, "y") for i, v in rows], SCHEMA)


def expected(rows, k=8, rounds=10, dims=64):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(float(np.float32(x))) * 1024 < cluster.WIDEST for x in v)]
    x = np.array([[int(np.floor(float(np.float32(c)) * 1024)) for c in v] for _, v in rows], dtype=object).reshape(-1, dims)
    key = lambda r: hashlib.sha256(f"3:{'' if rows[r][0] is None else rows[r][0]}".encode()).hexdigest()
    z = [list(x[r]) for r in sorted(range(len(rows)), key=lambda r: (key(r), list(x[r])))[:k]]

    def nearest():
        got = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in z]
            got.append((d.index(min(d)), min(d)))
        return got

    for _ in range(rounds):
        at = nearest()
        for c in range(len(z)):
            own = [x[r] for r in range(len(rows)) if at[r][0] == c]
            if own:
                z[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = nearest()
    per = {c: sum(d for a, d in at if a == c) for c in range(len(z))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for (i, _), (c, d) in zip(rows, at, strict=True)), key=str)


def found(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_distances(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(5, 64))
    rows = [(i, middle[i % 5] + rng.normal(size=64) * 0.4) for i in range(400)]
    assert found(cluster.kmeans(frame(spark, rows).repartition(3))) == expected(rows)


@pytest.mark.parametrize("shift", [0, 1e5])
def test_ties_and_repeats(spark, shift):
    """A coarse grid far from zero: many equal distances, one row very often."""
    rng = np.random.default_rng(2)
    rows = [(i % 37, rng.integers(0, 2, 64) + shift) for i in range(120)] + [(5, np.full(64, shift))] * 150
    assert found(cluster.kmeans(frame(spark, rows))) == expected(rows)


def test_edges(spark):
    assert found(cluster.kmeans(frame(spark, []))) == []
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [float("nan")] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (7, [1e30] + [0.0] * 63)]
    assert found(cluster.kmeans(frame(spark, bad))) == []
    few = [(10, [0.5] * 64), (None, [-0.0001] * 64), (11, [0.0] * 64)]
    assert found(cluster.kmeans(frame(spark, bad + few))) == expected(bad + few)


def test_filter_saves_distances():
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(8, 64)), 50, 0) * 1024 + rng.normal(size=(400, 64)) * 100).astype(np.int64)
    z = x[::50].copy()
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    lead, rest = cluster.turned(x.astype(float), x.mean(0), basis, 16)
    got, best, looked = cluster.assign(x, lead, rest, z, x.mean(0), basis)
    full = ((x[:, None] - z[None]) ** 2).sum(2)
    assert (got == full.argmin(1)).all() and (best == full.min(1)).all() and looked < 1.2 * len(x)
