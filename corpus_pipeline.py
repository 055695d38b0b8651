"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.llm import bpe, lines, mix, neardup, quality
from geolake.llm.common import table
from geolake.llm.queries import tokenizer_path
from geolake.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranking model, learnt from the labels, rejects."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated and nearly repeated lines; n_chars follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks."""
    return mix.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents, and the text they decode to."""
    return bpe.encode(docs, bpe.Vocabulary.read(tokenizer_path()))


STAGES = [
    ("quality ranking", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("source mix", mix_stage),
    ("bpe encoding", encode_stage),
]

#: The model, the edit distance and the merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
