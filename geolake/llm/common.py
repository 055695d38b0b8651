"""Shared pieces: table access, bounded Arrow batches, word hashes, label folds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_BYTES = 4 << 20
WORDS_KEPT = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``_row``, beside columns of one's own: no
    name of theirs can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in own.items()])


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a ``_row`` again; ``new`` ones replace those of their name."""
    return df.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in columns])


def typed(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def map_batches(df: DataFrame, schema: str, setup: Callable[[], Callable[[dict], dict]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``setup`` runs once a task and returns a function from columns (Python
    lists) to columns. It sees at most about ``chunk_bytes`` at a time, or one row."""
    arrow = to_arrow_schema(typed(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = setup()
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, int(batch.num_rows * chunk_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, size):
                out = step(batch.slice(at, size).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def pack_text(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 1)


def unpack_text(packed: bytes) -> str:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass")


class WordHash(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: WordHash, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles and their counts. Words
    are split at white space; fewer than ``k`` words make one shingle, none make none."""
    w = (text or "").split()
    if not w:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    width = min(k, len(w))
    n = len(w) - width + 1
    s = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s, return_counts=True)


def held_out(doc_id: int | None) -> bool:
    """The fold that is never learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_col(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _label_ids(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    ids = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    return ids.where(~held_out_col("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, text) of all labelled rows outside the held-out fold. Null ids and
    labels take no part; a doc_id labelled twice counts with its larger label; of texts
    under one id each counts. Any number of labels: joined by a shuffle."""
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.where(~held_out_col("_id")).join(_label_ids(labels, label, doc_id).hint("merge"), "_id")


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`labelled` rows of at most ``rows`` ids: those with the smallest hash. At
    most ``rows`` ids are broadcast."""
    ids = _label_ids(labels, label, doc_id).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.join(F.broadcast(ids), "_id")


def sums(df: DataFrame, of: Callable[[dict], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of the vectors that ``of`` makes of batches of columns: added up
    in each task, then in 16 groups; the driver gets 16 vectors."""
    arrow = to_arrow_schema(typed("k int, part int, v binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.to_pydict())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"k": [part % 16], "part": [part], "v": [total.tobytes()]}, schema=arrow)

    def add(key, group):
        v = sum(np.frombuffer(x, float) for x in group.sort_by("part").column("v").to_pylist())
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    got = df.mapInArrow(run, "k int, part int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").collect()
    return sum((np.frombuffer(bytes(r["v"]), float) for r in sorted(got, key=lambda r: r["k"])), np.zeros(width))


def logistic(x: np.ndarray, ridge: float, rounds: int = 30, y: np.ndarray | None = None) -> np.ndarray:
    """Weights of the logistic loss by Newton steps. Without ``y`` every row is a
    difference that should be positive."""
    y = np.ones(len(x)) if y is None else y
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
