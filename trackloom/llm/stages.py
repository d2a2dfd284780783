"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm import decontaminate, pieces, quality, secrets, setsketch
from trackloom.llm.common import table, without
from trackloom.llm.queries import QUALITY_CUT

#: Rows of an Arrow batch between the JVM and Python in all stages; whole texts make large rows.
BATCH_ROWS = 1_000


def _bounded_batches(spark: SparkSession) -> None:
    """Stages share one session and its workers, so none may leave large buffers behind."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; the columns stay."""
    _bounded_batches(spark)
    model = quality.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model, "_quality").where(F.col("_quality") >= QUALITY_CUT).select(docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group of near copies (five words, similarity 0.8).

    Rows that repeat an id and its text are one document.
    """
    _bounded_batches(spark)
    found = setsketch.near_duplicates(docs, 0.8)
    out = without(docs, found.where(~F.col("kept")), "doc_id")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not again.limit(1).count():
        return out
    return without(out, again, "doc_id").union(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs."""
    _bounded_batches(spark)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    key = docs.withColumn("_text_hash", F.xxhash64("text"))
    return without(key, found.select("doc_id", F.col("text_hash").alias("_text_hash")), "doc_id", "_text_hash").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a placeholder; all documents stay, and n_chars follows the text."""
    _bounded_batches(spark)
    model = secrets.fit_formats(docs)
    out = docs.withColumn("text", secrets.redacted(model, "text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of the best segmentation, its score, and the next best as edits of it."""
    _bounded_batches(spark)
    return pieces.encode(docs, "text", prefix="piece_").drop("piece_round_trip")
