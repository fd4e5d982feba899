"""Cleaning pipeline over ``documents``: five stages, each on all rows that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents: a stage that changes texts brings
n_chars up to date. Rows with null doc_id are passed on by every stage that works by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import bytebpe, decontaminate, lines, neardup, quality
from changelake.llm.store import materialise, only_ids, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of docs from ``changed``, with the given text column in place of text."""
    frame = changed.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        frame = frame.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return frame


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    small_batches(spark)
    return quality.train(docs).keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat in windows of three."""
    small_batches(spark)
    return _with_text(docs, lines.dedup_lines(docs), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id."""
    small_batches(spark)
    judged = neardup.near_duplicates(docs)
    gone = materialise(judged.where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return only_ids(docs, "doc_id", gone, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark phrases out of the texts."""
    small_batches(spark)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(docs, found, "cleaned")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    small_batches(spark)
    import public_tokenizers as tokenizers
    ranks = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bytebpe.encode(docs, ranks, tokenizers.PATTERN)
    return bytebpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# The classifier's scores, the approximate candidates and the token ids have no SQL form; the pipeline is
# tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
