"""Writers.  Spark's committer makes each write all-or-nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.functions.checks import relative_path
from trackloom.session import cut_lineage


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_track_cells(cells: DataFrame, path: str, buckets: int = 64) -> None:
    """Sparse cells in sample buckets, each file sorted by sample and frame."""
    bucket = F.pmod(F.hash("sample_id"), F.lit(buckets)).alias("bucket")
    (
        cells.select("*", bucket)
        .repartition("bucket", "sample_id")
        .sortWithinPartitions("bucket", "sample_id", "frame", "slot", "cy", "cx")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def shard_name(shard: int, shards: int) -> str:
    return f"manifest.shard-{shard:05d}-of-{shards:05d}.json"


def write_cache_manifest(records: DataFrame, header: DataFrame, path: str, shards: int) -> None:
    """Records by shard in source order, with the shard's file label, next to one header table.

    ``records`` needs ``shard`` and ``ordinal``.
    """
    label = F.format_string("manifest.shard-%05d-of-%05d", F.col("shard").cast("int"), F.lit(shards))
    (
        records.withColumn("shard_file", label)
        .repartition("shard_file")
        .sortWithinPartitions("shard_file", "ordinal")
        .write.mode("overwrite")
        .partitionBy("shard_file")
        .json(f"{path}/records")
    )
    header.write.mode("overwrite").json(f"{path}/header")


def write_manifest_shards(records: DataFrame, header: str, path: str, shards: int) -> DataFrame:
    """One JSON document per shard under its contract name; gives (shard, file, records).

    ``records(shard, ordinal, record)`` holds records as JSON text, ``header`` the JSON object of what all
    documents state; ``records`` and ``record_count`` are added. A shard is streamed by one task in source
    order, under a temporary name until it is whole, so a task that runs twice leaves one set of files.
    """
    head = json.loads(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        store.create_dir(base, recursive=True)
        at, stream, count, partial, done = None, None, 0, "", []

        def close() -> None:
            stream.write(f'], "record_count": {count}}}'.encode())
            stream.close()
            store.move(partial, f"{base.rstrip('/')}/{shard_name(at, shards)}")
            done.append((at, shard_name(at, shards), count))

        for b in batches:
            for shard, record in zip(b["shard"].to_pylist(), b["record"].to_pylist()):
                if shard != at:
                    if stream:
                        close()
                    at, count = shard, 0
                    partial = f"{base.rstrip('/')}/{shard_name(at, shards)}.{uuid.uuid4().hex}.partial"
                    stream = store.open_output_stream(partial)
                    start = json.dumps(head)[:-1]
                    stream.write(f'{start}{", " if head else ""}"records": ['.encode())
                stream.write(((", " if count else "") + record).encode())
                count += 1
        if stream:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["shard", "file", "records"])

    rows = records.select(F.col("shard").cast("int").alias("shard"), "ordinal", "record")
    return cut_lineage(rows.repartition("shard").sortWithinPartitions("shard", "ordinal").select("shard", "record").mapInArrow(run, "shard int, file string, records long"))


def write_cloud(cloud: DataFrame, path: str) -> None:
    cloud.repartition("scene", "source").write.mode("overwrite").partitionBy("scene", "source").parquet(path)


def read_cache_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/header"), spark.read.json(f"{path}/records")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) rows as files below ``folder``; gives (path, bytes) of what was written.

    Tasks write under a temporary name and rename, so a file is there whole or not at all, and a task that
    runs twice leaves one file. ``folder`` is a plain path or a URI that Arrow's file systems know.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
        store, base = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                final = f"{base.rstrip('/')}/{path}"
                partial = f"{final}.{uuid.uuid4().hex}.partial"
                store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(partial) as stream:
                    stream.write(content)
                store.move(partial, final)
            yield pa.RecordBatch.from_arrays([b["path"], pc.binary_length(b["content"]).cast(pa.int64())], ["path", "bytes"])

    return cut_lineage(files.filter(relative_path(F.col("path"))).select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, bytes long"))
