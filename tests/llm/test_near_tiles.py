"""The links of a tile against all pairs, and near-duplicate classes of groups over several tiles."""

import numpy as np
import pytest
from geolake.llm import neardup


def sketches(seed: int, n: int):
    """Rows around a few centres: alike at 0.65 to 1 inside, not across."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 256, (4, neardup.COMPONENTS), dtype=np.uint8)
    sig = centre[rng.integers(0, 4, n)]
    redo = rng.random(sig.shape) < rng.random((n, 1)) * 0.2
    sig[redo] = rng.integers(0, 256, int(redo.sum()), dtype=np.uint8)
    keys = rng.integers(0, 3, (n, neardup.BANDS)).astype(np.int64)
    keys[:, 5] = 7
    return sig, keys


def classes_of(n: int, start: np.ndarray, links) -> list[int]:
    up = {int(c): int(c) for c in start}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(int(start[a]))] = top(int(start[b]))
    return [top(int(c)) for c in start]


def partition(labels) -> set:
    groups: dict = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_agreeing_counts_equal_bytes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (2, 50, neardup.COMPONENTS), dtype=np.uint8)
    b[0] = a[0]
    b[1] = a[1] + 1
    assert neardup._agreeing(a, b).tolist() == (a == b).sum(1).tolist()


@pytest.mark.parametrize("sides", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_tile_leaves_no_pair_unchecked(seed, sides):
    n, band = 60, 5
    sig, keys = sketches(seed, n)
    truth = np.random.default_rng(seed + 9).random((n, n)) < 0.3
    truth |= truth.T
    start = np.arange(n) // 2 * 2
    rows, cols = (np.arange(0, n, 2), np.arange(1, n, 2)) if sides else (np.arange(n),) * 2
    asked = []

    def close(a, b):
        asked.append((min(a, b), max(a, b)))
        return bool(truth[a, b])

    links = neardup._joined(sig, keys, band, start, rows, cols, close, 0.8)
    agree = (sig[:, None] == sig[None]).sum(2)
    first = (keys[:, None] == keys[None]).argmax(2)
    left = set(rows.tolist())
    every = [(a, b) for a in range(n) for b in range(a + 1, n) if agree[a, b] >= neardup._least(0.8, 5) and first[a, b] == band and truth[a, b]]
    if sides:
        every = [(a, b) for a, b in every if (a in left) != (b in left)]
    assert any(agree[a, b] < neardup._least(0.8) for a, b in every)
    assert partition(classes_of(n, start, links)) == partition(classes_of(n, start, every))
    assert len(asked) == len(set(asked)) and all(truth[a, b] for a, b in links)
    # each link joins two classes
    assert len(links) == len(set(start.tolist())) - len(partition([x for x in classes_of(n, start, links)]))


@pytest.mark.parametrize("small", ["TILE", "TILE_BYTES"])
def test_chain_of_copies_over_tiles(spark, monkeypatch, small):
    """A text that changes word by word: near neighbours are alike, the ends are not."""
    monkeypatch.setattr(neardup, small, 4 if small == "TILE" else 600)
    words = [f"w{i}" for i in range(160)]
    texts = []
    for k in range(40):
        texts.append(" ".join(words))
        words[4 * k : 4 * k + 2] = [f"x{k}", f"y{k}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, texts[7]), (103, "alone " * 9)]
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hashes = [neardup.shingles(t, neardup.WordHash()) for _, t in rows[:40]]
    truth = list(range(40))
    for a in range(40):
        for b in range(a):
            if neardup.likeness(hashes[a], hashes[b]) >= 0.8:
                truth = [truth[b] if x == truth[a] else x for x in truth]
    assert partition(got[i].class_id for i in range(40)) == partition(truth)
    assert got[102].class_id == got[7].class_id and got[100].class_id == got[101].class_id == 100 and got[103].class_size == 1
