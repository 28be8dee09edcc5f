"""From raw documents to token ids: rejects poor texts, near copies and benchmark leaks, masks secrets, encodes.

Each stage works on all rows that its predecessor kept, and every stage but the last returns the columns of
``documents``.  ``run`` writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.llm import bpe, dartminhash, decontaminate, quality, secrets
from hostpulse.llm.common import staged, table, unused
from hostpulse.llm.queries import TOKENIZER, training_row


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without any labelled row, all of them.

    It is fitted on the training rows of ``labels`` among the documents.  A null or empty text gets the score of the
    classifier's bias; rows that repeat are judged alike, and null ids like any other.  Texts are read whole, however long.
    """
    labels = table(spark, sf_dir, "labels")
    usable = training_row() & F.col("quality").isin(0, 1)
    if labels.where(usable).isEmpty():
        return docs
    model = quality.fit_quality(docs, labels, usable=training_row())
    score = unused(docs, "quality_score")
    scored = quality.score_quality(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Null and empty texts are classes of their own; of rows that repeat an id and its text one stays, as of a class without any id.
    """
    return dartminhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts stay; rows that repeat an id and its text stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text where it changed.

    Null and empty texts, and those without secrets, stay as they are; rows that repeat are masked alike.
    """
    before = unused(docs, "length_before")
    masked = secrets.mask_secrets(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        changed = ~F.length("text").eqNullSafe(F.col(before))
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of the text that they decode to; null texts count as empty."""
    # the texts themselves end here; ids are written and read again, so that a task has one worker at a time and not two
    encoded = staged(bpe.encode_bpe(docs.select("doc_id", "text"), TOKENIZER).select("doc_id", "ids"), "encoded")
    coded = bpe.decode_bpe(encoded, TOKENIZER)
    return coded.select(
        "doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("BPE encoding and decoding", encode),
]

#: A fitted classifier, signatures and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
