"""Manifest lines, JSON documents, artifact listings and report trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom.functions.checks import relative_path
from trackloom.functions.ordered import index_within


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with their file order.

    Columns: ``ordinal`` (zero-based line position), ``source``, ``raw`` and the
    parsed ``rec`` VARIANT, NULL where the line is not JSON.  Blank lines are
    dropped after numbering, so ``ordinal + 1`` is the line number to report.
    Lines are numbered per input split; only split counts meet in one task.
    """
    lines = spark.read.text(path).select(
        F.trim(F.col("value")).alias("raw"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    numbered = index_within(
        lines,
        [],
        ["source", "_start", "_mid"],
        F.struct("source", "_start"),
        "ordinal",
    )
    return numbered.filter(F.length("raw") > 0).select(
        "ordinal", "source", "raw", F.try_parse_json("raw").alias("rec")
    )


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One or more whole JSON documents: header fields and positioned records.

    The header keeps ``record_count`` next to the counted ``records_found`` and tells by
    ``count_ok`` whether they agree.  A document that cannot be parsed (no JSON, or above
    the VARIANT size limit) keeps its header row with ``readable`` false, so its records
    do not vanish unseen.  Values stay VARIANT.
    """
    docs = (
        spark.read.text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("value").alias("raw"),
            F.try_parse_json("value").alias("doc"),
        )
    )
    items = F.try_variant_get("doc", "$.records", "array<variant>")
    header = docs.select(
        "source",
        "raw",
        "doc",
        F.try_variant_get("doc", "$.schema", "string").alias("schema"),
        F.try_variant_get("doc", "$.record_count", "long").alias("record_count"),
        F.size(items).cast("long").alias("records_found"),
        F.col("doc").isNotNull().alias("readable"),
        F.coalesce(F.try_variant_get("doc", "$.record_count", "long") == F.size(items), F.lit(False)).alias("count_ok"),
    )
    records = docs.select("source", F.posexplode(items).alias("ordinal", "rec")).select(
        "source",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.try_variant_get("rec", "$.sample_id", "string").alias("sample_id"),
        "rec",
    )
    return header, records


def scan_artifacts(
    spark: SparkSession, root: str, glob: str | None = None, with_hash: bool = True
) -> DataFrame:
    """Files below ``root`` as (path relative to root, bytes, sha256).

    Without the hash the content column is pruned and only file status is read.
    Spark's file sources skip empty files and hold a whole file per row; use
    ``stat_artifacts`` where either matters.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    bare = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.substr(bare, F.lit(len(root.rstrip("/")) + 2))
    columns: list[Column] = [rel.alias("path"), F.col("length").alias("bytes")]
    if with_hash:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return files.select(*columns)


def stat_artifacts(paths: DataFrame, root: str, block: int = 8 * 1024 * 1024) -> DataFrame:
    """(path, bytes, sha256) of the listed relative paths that exist below ``root``.

    Tasks open their own share of the paths and hash block by block, so files of any
    size work, empty ones included.  ``root`` is a local or cluster file-system URI.
    """
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            found = []
            for path in batch["path"]:
                info = store.get_file_info(f"{base.rstrip('/')}/{path}")
                if info.type == pafs.FileType.File:
                    digest = hashlib.sha256()
                    with store.open_input_stream(info.path) as stream:
                        while chunk := stream.read(block):
                            digest.update(chunk)
                    found.append((path, info.size, digest.hexdigest()))
            yield pd.DataFrame(found, columns=["path", "bytes", "sha256"])

    inside = paths.select("path").filter(relative_path(F.col("path"))).distinct()
    return inside.mapInPandas(visit, "path string, bytes long, sha256 string")


def read_reports(spark: SparkSession, root: str, suffix: str = ".mp4") -> DataFrame:
    """Report documents in a tree, each flagged with whether its video sits next to it."""
    reports = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("stem"),
            F.try_parse_json("value").alias("report"),
        )
    )
    videos = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select(
            F.regexp_replace(F.col("_metadata.file_path"), suffix.replace(".", r"\.") + "$", "").alias("stem"),
            F.lit(True).alias("has_video"),
        )
    )
    return reports.join(videos, "stem", "left").select(
        F.concat("stem", F.lit(".json")).alias("path"),
        F.try_variant_get("report", "$.sample_id", "string").alias("sample_id"),
        F.coalesce("has_video", F.lit(False)).alias("has_video"),
        "report",
    )


def first_seen_ids(reports: DataFrame) -> DataFrame:
    """Distinct sample ids ordered by the first path that names them."""
    return (
        reports.filter(F.length("sample_id") > 0)
        .groupBy("sample_id")
        .agg(F.min("path").alias("first_path"))
        .orderBy("first_path")
    )
