"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, cluster, dialogue, fingerprint, html, lines, mix, neardup, ngram, quality, suffix, toxicity
from .common import table

Run = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary file that op6 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited forms."""
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without 200-byte strings that start twice."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]).cast("long"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of all documents."""
    out = bpe.encode(table(spark, sf_dir, "documents"), bpe.Vocabulary.read(tokenizer_path()))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with the passages found."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and nearly repeated lines."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix.mix(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits and digests of all conversations, damaged and repaired."""
    return dialogue.check(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all vectors after ten rounds."""
    return cluster.kmeans(table(spark, sf_dir, "embeddings"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the model of the training folds."""
    return ngram.train_and_score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Run] = {
    f.__name__: f
    for f in (
        op1_piecewise_fingerprints,
        op2_near_duplicates,
        op3_nearest_vectors,
        op4_repeated_bytes,
        op5_quality_ranking,
        op6_bpe_round_trip,
        op7_toxic_passages,
        op8_line_dedup,
        op9_source_mix,
        op10_main_text,
        op11_conversation_repair,
        op12_centroids,
        op13_language_model,
    )
}
SQL: dict[str, str] = {"op9_source_mix": mix.SQL}
