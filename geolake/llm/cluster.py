"""Lloyd clustering in exact integers, with a filter on PCA-rotated coordinates.

The vectors are turned into the axes of their covariance, which is summed in Spark.
Of each turned vector the leading coordinates and the length of the rest are stored.
For a vector v and a centroid z, |v - z|² is at least the squared distance of the
leading coordinates plus the squared difference of the two lengths. A vector first
meets the centroid with the smallest bound; only centroids whose bound does not pass
that distance are looked at again. Distances that decide are taken in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .common import typed

SCALE = 1024
#: Components beyond this leave no room for a squared distance in 63 bits.
WIDEST = 1 << 27
LEADING = 16
CHUNK = 16_384


def whole(embedding: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


def sound(rows: DataFrame, dims: int, embedding: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector has ``dims`` components, all of them finite and, times
    ``scale``, within ``WIDEST``."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(WIDEST / scale)), F.lit(False)))
    return rows.where((F.size(v) == dims) & ok)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``CHUNK`` rows and their vectors, column ``_v``, as int64."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            flat = part.column(part.schema.get_field_index("_v")).flatten()
            yield part, flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _arrow(df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    arrow = to_arrow_schema(typed(schema))
    return df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict(d, schema=arrow) for d in run(batches)), schema)


def axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, leading first) of ``_v``. Every task adds up
    its own moments; their cells are summed in Spark."""

    def moments(batches):
        sums = np.zeros((dims + 1, dims + 1))
        for _, x in _blocks(batches, dims):
            one = np.concatenate([x.astype(float), np.ones((len(x), 1))], 1)
            sums += one.T @ one
        yield {"cell": np.arange(sums.size), "v": sums.ravel()}

    cells = _arrow(vectors.select("_v"), "cell int, v double", moments).groupBy("cell").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((dims + 1) ** 2)
    for c in cells:  # (dims + 1)² numbers, however many rows there are
        sums[c["cell"]] = c["v"]
    sums = sums.reshape(dims + 1, dims + 1)
    mean = sums[dims, :dims] / max(sums[dims, dims], 1)
    cov = sums[:dims, :dims] / max(sums[dims, dims], 1) - np.outer(mean, mean)
    return mean, np.linalg.eigh(cov)[1][:, ::-1]


def turned(x: np.ndarray, mean: np.ndarray, basis: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates and the length of the others."""
    y = (x - mean) @ basis
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))


def assign(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row, and
    how many distances were taken in full."""
    zl, zr = turned(centroids.astype(float), mean, basis, lead.shape[1])
    low = np.stack([((lead - p) ** 2).sum(1) + (rest - r) ** 2 for p, r in zip(zl, zr, strict=True)], 1)
    # what rounding can add to a bound of numbers of this size
    size = float((x.astype(float) ** 2).sum(1).max() + (centroids.astype(float) ** 2).sum(1).max() + (mean**2).sum())
    low -= 1e-9 * (1 + size)
    cluster = low.argmin(1)
    best = ((x - centroids[cluster]) ** 2).sum(1)
    looked = len(x)
    first = cluster.copy()
    for k in range(len(centroids)):
        todo = np.flatnonzero((low[:, k] <= best) & (first != k))
        looked += len(todo)
        d = ((x[todo] - centroids[k]) ** 2).sum(1)
        nearer = (d < best[todo]) | ((d == best[todo]) & (k < cluster[todo]))
        cluster[todo[nearer]], best[todo[nearer]] = k, d[nearer]
    return cluster, best, looked


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:id`` (ties: smaller vector)."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    got = vectors.select(h.alias("_h"), "_v").orderBy("_h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in got], np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def kmeans(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, leading: int = LEADING, salt: str = "3", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row
    for each vector that takes part, repeated rows and ids included.

    Vectors with another number of components than ``dims``, with a null or
    non-finite one, or with one of 2^27 or more after scaling (its squared distance
    may not fit a long) take no part. A null id counts as empty text in the choice
    of the first centroids. With fewer than ``k`` vectors each is a first centroid;
    equal first centroids keep their numbers, and the later ones stay empty. Nothing
    is returned for an empty table. A sum of distances beyond a long is null.
    """
    own = sound(rows, dims, embedding).select(F.col(vec_id).cast("long").alias("_id"), whole(F.col(embedding)).alias("_v"))
    z = seeds(own, k, salt)
    if not len(z):
        return own.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    mean, basis = axes(own, dims)

    def store(batches):
        for part, x in _blocks(batches, dims):
            lead, rest = turned(x.astype(float), mean, basis, leading)
            yield {"_id": part.column(0), "_v": list(x.astype(np.int32)), "_lead": list(lead), "_rest": rest}

    kept = cut(_arrow(own.select("_id", "_v"), "_id long, _v array<int>, _lead array<double>, _rest double", store))

    def met(batches, z):
        for part, x in _blocks(batches, dims):
            lead = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            yield part, x, *assign(x, lead, part.column(3).to_numpy(zero_copy_only=False), z, mean, basis)

    for _ in range(rounds):

        def sums(batches, z=z):
            total, n = np.zeros(z.shape, object), np.zeros(len(z), np.int64)
            for _, x, cluster, _, _ in met(batches, z):
                for c in np.unique(cluster):
                    at = cluster == c
                    total[c] += x[at].sum(0).astype(object)
                    n[c] += at.sum()
            yield {"_c": np.arange(len(z)), "_n": n, "_s": [[str(int(v)) for v in t] for t in total]}

        part = _arrow(kept, "_c int, _n long, _s array<string>", sums)
        each = [F.sum(F.col("_s")[i].cast("decimal(38,0)")).alias(f"_s{i}") for i in range(dims)]
        # k rows come back, one a centroid
        for r in part.groupBy("_c").agg(F.sum("_n").alias("_n"), *each).collect():
            if r["_n"]:
                z[r["_c"]] = [int(r[f"_s{i}"]) // r["_n"] for i in range(dims)]

    def last(batches, z=z):
        for part, _, cluster, best, _ in met(batches, z):
            yield {"vec_id": part.column(0), "cluster": cluster.astype(np.int32), "distance": best}

    out = cut(_arrow(kept, "vec_id long, cluster int, distance long", last))
    total = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def of_cluster(what: list, kind: str) -> Column:
        return reduce(lambda e, c: e.when(F.col("cluster") == c, F.lit(what[c]).cast(kind)), range(1, len(z)), F.when(F.col("cluster") == 0, F.lit(what[0]).cast(kind)))

    def long_or_null(x: int) -> int | None:
        return x if x < 1 << 63 else None

    own_sums = [long_or_null(int(total.get(c, 0))) for c in range(len(z))]
    whole_sum = F.lit(long_or_null(sum(int(s) for s in total.values()))).cast("long")
    return out.withColumns({"cluster_inertia": of_cluster(own_sums, "long"), "inertia": whole_sum, "centroid_sha256": of_cluster([digest(c) for c in z], "string")})
