"""Nearest neighbours by inner product with a forest of random-projection trees.

Inner products become angles by one more coordinate that brings every candidate to
the same length. The trees are grown on a bounded sample; every row is then put
into a leaf of each tree. A query walks all trees with one priority queue, always
opening the branch whose splits it missed by the least, until the leaves hold a set
share of the sample; the rows of those leaves are scored exactly. The share, not the
number of leaves, is set, so recall does not fall as a table grows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches

TREES, LEAVES, SHARE = 12, 128, 1.2
FIT_ROWS = 20_000
PART = 4000
#: A table of so few distinct vectors for each answer asked for is searched whole.
FEW = 100


@dataclass(frozen=True)
class Forest:
    """Per tree: split normals, offsets and children; child ``-1 - k`` is leaf ``k``."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]
    sizes: list[np.ndarray]  # sample rows of each leaf
    scale: float

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (w, o, ch) in enumerate(zip(self.normals, self.offsets, self.children, strict=True)):
            at = np.zeros(len(x), np.int64)
            live = np.arange(len(x)) if len(w) else np.empty(0, np.int64)
            while len(live):
                node = at[live]
                side = np.einsum("ij,ij->i", x[live], w[node]) > o[node]
                at[live] = ch[node, side.astype(int)]
                live = live[at[live] >= 0]
            out[:, t] = -1 - at if len(w) else 0
        return out

    def search(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs with the smallest misses, found best first, until
        their leaves, those that overlap included, hold ``share`` of the sample."""
        left = share * self.sizes[0].sum()
        heap = [(-np.inf, t, 0) for t in range(len(self.normals))]
        heapq.heapify(heap)
        found = []
        while heap and left > 0:
            miss, t, node = heapq.heappop(heap)
            if not len(self.normals[t]):
                node = -1
            while node >= 0:
                m = float(self.normals[t][node] @ q - self.offsets[t][node])
                near, far = self.children[t][node][[int(m > 0), int(m <= 0)]]
                heapq.heappush(heap, (max(miss, abs(m)), t, int(far)))
                node = int(near)
            found.append((t, -1 - node))
            left -= self.sizes[t][-1 - node]
        return found


def lifted(x: np.ndarray, scale: float, query: bool) -> np.ndarray:
    """``x`` as rows of one length: candidates get the missing length as one more
    coordinate, queries zero, so that angles order as inner products do."""
    n = np.sqrt((x * x).sum(1))
    if query:
        return np.concatenate([x / np.maximum(n, 1e-300)[:, None], np.zeros((len(x), 1))], 1)
    return np.concatenate([x / scale, np.sqrt(np.maximum(0.0, 1 - (n / scale) ** 2))[:, None]], 1)


def grow(x: np.ndarray, scale: float, trees: int = TREES, leaves: int = LEAVES, seed: int = 17) -> Forest:
    """Trees over the sample ``x`` (already lifted). A split is the plane between two
    random points; if it leaves nearly all on one side, a random direction at the
    median; rows that no direction can part stay together."""
    rng = np.random.default_rng(seed)
    leaf = max(12, len(x) // leaves)
    forest = Forest([], [], [], [], scale)
    for _ in range(trees):
        w, o, ch, sizes = [], [], [], []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = None
            if len(rows) > leaf:
                for kind in range(4):
                    if kind < 3:
                        i, j = rng.choice(rows, 2, replace=False)
                        d = x[i] - x[j]
                        off = float((x[i] + x[j]) @ d / 2)
                    else:
                        d = rng.normal(size=x.shape[1])
                        off = float(np.median(x[rows] @ d))
                    right = x[rows] @ d > off
                    if 0.1 * len(rows) <= right.sum() <= 0.9 * len(rows) or (kind == 3 and 0 < right.sum() < len(rows)):
                        n = np.sqrt(d @ d)
                        split = (d / n, off / n, right)
                        break
            if split is None:
                me = -1 - len(sizes)
                sizes.append(len(rows))
            else:
                me = len(w)
                w.append(split[0])
                o.append(split[1])
                ch.append([0, 0])
                todo += [(rows[~split[2]], me, 0), (rows[split[2]], me, 1)]
            if parent >= 0:
                ch[parent][side] = me
        forest.sizes.append(np.array(sizes, np.int64))
        forest.normals.append(np.array(w).reshape(-1, x.shape[1]))
        forest.offsets.append(np.array(o))
        forest.children.append(np.array(ch, np.int64).reshape(-1, 2))
    return forest


def _sound(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """_id, _v of the rows that take part, as doubles."""
    v = F.col(embedding).cast("array<double>")
    own = rows.select(F.col(vec_id).cast("long").alias("_id"), v.alias("_v")).where("_id is not null and _v is not null and size(_v) > 0")
    ok = F.forall("_v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return own.where(ok & F.exists("_v", lambda e: e != 0))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, leaves: int = LEAVES, share: float = SHARE, fit_rows: int = FIT_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found with the largest inner
    product with each row of ``queries``, its own id left out; ties to smaller ids.

    A table of at most ``FEW * (k + 1)`` distinct vectors is searched whole, so each
    query has all candidates there are. The forest is grown on the ``fit_rows`` distinct vectors with the smallest hash;
    all rows are indexed. Rows with one vector are indexed once, with the ``k + 1``
    smallest of their ids (more can't be in any answer). Vectors that are null, empty,
    zero or not finite take no part, nor do those of another length than the commonest
    (of equally common ones the largest); a query that takes no part has no rows.
    Repeated rows count once; vectors under one id are candidates each, and their id
    is named once, with its best score.
    """
    own, asked = _sound(rows, vec_id, embedding), _sound(queries, vec_id, embedding)
    width = own.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    own, asked = (x.where(F.size("_v") == (width["n"] if width else 0)) for x in (own, asked))
    few = Window.partitionBy("_v").orderBy("_id")
    ids = own.dropDuplicates(["_v", "_id"]).withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1)
    one = cut(ids.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    scale = one.agg(F.max(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, e: s + e * e)))).first()[0]
    if scale is None:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = one.select("_v").orderBy(F.xxhash64("_v"), "_v").limit(fit_rows).toPandas()["_v"]
    if len(sample) < fit_rows and len(sample) <= FEW * (k + 1):
        trees, share = 1, np.inf  # every leaf of one tree: leaves that overlap would use up a share
    forest = grow(lifted(np.array(sample.tolist(), float), scale, False), scale, trees, leaves)
    shared = own.sparkSession.sparkContext.broadcast(forest)

    def place():
        f = shared.value

        def step(b):
            at = f.leaves(lifted(np.array(b["_v"], float), f.scale, False))
            return {"_v": b["_v"], "_ids": b["_ids"], "_leaves": at.tolist()}

        return step

    def ask():
        f = shared.value

        def step(b):
            q = lifted(np.array(b["_v"], float), f.scale, True)
            return {"_id": b["_id"], "_v": b["_v"], "_asked": [[{"_tree": t, "_leaf": n} for t, n in f.search(row, share)] for row in q]}

        return step

    placed = cut(map_batches(one, "_v array<double>, _ids array<long>, _leaves array<long>", place))
    seeking = cut(map_batches(asked.dropDuplicates(["_v", "_id"]), "_id long, _v array<double>, _asked array<struct<_tree:int,_leaf:long>>", ask))
    # a leaf with many rows is met in parts, so that no task has more than a bounded number
    spread = placed.select("_v", "_ids", F.posexplode("_leaves").alias("_tree", "_leaf"))
    parts = spread.groupBy("_tree", "_leaf").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    left = spread.join(parts, ["_tree", "_leaf"]).withColumn("_part", F.pmod(F.xxhash64("_ids"), F.col("_parts")))
    right = seeking.select("_id", "_v", F.explode("_asked").alias("_a")).select("_id", "_v", "_a.*")
    right = right.join(parts, ["_tree", "_leaf"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    right = right.select("_id", "_v", *[F.col(c).alias(f"{c}_asked") for c in ("_tree", "_leaf", "_part")])

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x = np.array(a["_v"].tolist(), float)
        ids = a["_ids"].tolist()
        out_q, out_v, out_s = [], [], []
        for qid, qv in zip(b["_id"], b["_v"], strict=True):
            s = _inner(x, np.asarray(qv, float))
            # the best vectors, with what ties with the last, until they hold k ids
            take = k + 1
            while True:
                edge = np.partition(s, len(s) - take)[len(s) - take] if len(s) > take else -np.inf
                best = np.flatnonzero(s >= edge)
                if len(best) == len(s) or len({i for r in best for i in ids[r]} - {qid}) >= k:
                    break
                take *= 4
            for r in best:
                own_ids = [i for i in ids[r] if i != qid][:k]
                out_q += [qid] * len(own_ids)
                out_v += own_ids
                out_s += [s[r]] * len(own_ids)
        got = pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return got.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    found = left.groupBy("_tree", "_leaf", "_part").cogroup(right.groupBy("_tree_asked", "_leaf_asked", "_part_asked")).applyInPandas(score, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, the same on every machine."""
    return np.add.accumulate(x * q, axis=1)[:, -1]
