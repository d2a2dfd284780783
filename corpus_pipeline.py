"""Documents to training data: the stages of the corpus pipeline, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import stages
from trackloom.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", stages.keep_good),
    ("MinHash near-dedup", stages.keep_first_copies),
    ("benchmark decontamination", stages.keep_clean),
    ("secret scans", stages.redact_secrets),
    ("SentencePiece encoding and decoding", stages.encode_pieces),
]

#: The trained stages cannot be written in SQL; tests hold the rows against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
