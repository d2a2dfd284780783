"""Sources and sinks: tables are written to the shared folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.plans.spec import query
from trackloom.plans.tables import load
from trackloom.session import shared_folder
from trackloom.sources import manifest, sinks
from trackloom.streaming import live


@query("sample_id:i readable:b", "SELECT o_orderkey AS sample_id, o_orderkey % 10 <> 3 AS readable FROM orders")
def manifest_lines(spark, folder):
    """JSON Lines written and read; a tenth of the lines is broken and stays visible."""
    path = shared_folder(spark, "lines")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("sample_id")))
    broken = F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit("x"), line)).otherwise(line)
    load(spark, folder, "orders").select(broken.alias("value")).write.text(path)
    found = manifest.read_manifest(spark, path)
    return found.select(F.regexp_extract("raw", r"(\d+)", 1).alias("sample_id"), F.col("rec").isNotNull().alias("readable"))


@query("lines:i first:i last:i numbers:i", "SELECT count(*) AS lines, 0 AS first, count(*) - 1 AS last, count(*) AS numbers FROM orders")
def manifest_numbering(spark, folder):
    """Line numbers of a manifest of several files run from zero without gap or repeat."""
    path = shared_folder(spark, "numbers")
    load(spark, folder, "orders").repartition(3, "o_custkey").select(F.to_json(F.struct("o_orderkey")).alias("value")).write.text(path)
    o = F.col("ordinal")
    return manifest.read_manifest(spark, path).agg(F.count(o).alias("lines"), F.min(o).alias("first"), F.max(o).alias("last"), F.count_distinct(o).alias("numbers"))


@query(
    "mode:s metric:f6 steps:i non_finite:i last_step:i",
    """SELECT l_returnflag AS mode, avg(l_quantity) FILTER (l_linenumber <> 2) AS metric, count(*) AS steps,
       count(*) FILTER (l_linenumber = 2) AS non_finite, max(l_orderkey) AS last_step FROM lineitem GROUP BY l_returnflag""",
)
def progress_log(spark, folder):
    """A metrics log written as JSON and summed up as the live metrics are."""
    path = shared_folder(spark, "progress")
    total = F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("double"))
    load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_returnflag").alias("mode"), F.lit("a").alias("axis"), total.alias("total")).write.json(path)
    return live.live_metrics(live.read_progress(spark, path))


@query(
    "sample_id:i shard_file:s",
    "SELECT o_orderkey AS sample_id, 'manifest.shard-' || lpad(CAST(o_custkey % 4 AS VARCHAR), 5, '0') || '-of-00004' AS shard_file FROM orders",
)
def cache_manifest(spark, folder):
    """Records written by shard and read back with the label of their file."""
    path = shared_folder(spark, "cache")
    records = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.pmod("o_custkey", F.lit(4)).alias("shard"), F.col("o_orderkey").alias("ordinal")
    )
    sinks.write_cache_manifest(records, spark.range(1).select(F.lit("v1").alias("schema")), path, 4)
    return sinks.read_cache_manifest(spark, path)[1].select("sample_id", "shard_file")


@query(
    "shard:i file:s stated:i found:i agrees:b first_id:i last_id:i",
    """SELECT o_custkey % 4 AS shard, 'manifest.shard-' || lpad(CAST(o_custkey % 4 AS VARCHAR), 5, '0') || '-of-00004.json' AS file, count(*) AS stated, count(*) AS found, true AS agrees,
      min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY o_custkey % 4""",
)
def cache_shard_files(spark, folder):
    """Shards written under their contract names, twice, and read back as documents."""
    path = shared_folder(spark, "shards")
    key = F.col("o_orderkey")
    records = load(spark, folder, "orders").select(
        F.pmod("o_custkey", F.lit(4)).alias("shard"), key.alias("ordinal"), F.to_json(F.struct(key.cast("string").alias("sample_id"))).alias("record")
    )
    for _ in range(2):  # a second attempt replaces the files of the first
        sinks.write_manifest_shards(records, '{"schema": "v1"}', path, 4)
    header, items = manifest.read_document(spark, path)
    ends = items.groupBy("source").agg(F.min_by("sample_id", "ordinal").alias("first_id"), F.max_by("sample_id", "ordinal").alias("last_id"))
    file = F.substring_index("source", "/", -1)
    return header.join(ends, "source").select(
        F.regexp_extract(file, r"shard-(\d+)", 1).cast("int").alias("shard"), file.alias("file"), F.col("record_count").alias("stated"), F.col("records_found").alias("found"), F.col("count_ok").alias("agrees"), "first_id", "last_id"
    )


@query("scene:i source:i vec_id:i x:f6", "SELECT label AS scene, vec_id % 3 AS source, vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings")
def cloud_files(spark, folder):
    """A cloud written by scene and source, read back whole."""
    path = shared_folder(spark, "cloud")
    points = load(spark, folder, "embeddings").select(
        F.col("label").alias("scene"), (F.col("vec_id") % 3).alias("source"), "vec_id", F.col("embedding")[0].cast("double").alias("x")
    )
    sinks.write_cloud(points, path)
    return spark.read.parquet(path)


@query(
    "nation:i bytes:i same:b",
    "SELECT s_nationkey AS nation, sum(octet_length(encode(s_name)) + 1) AS bytes, true AS same FROM supplier GROUP BY s_nationkey",
)
def artifact_listing(spark, folder):
    """Files of one nation each: sizes and hashes of the listing against those of the block-wise reader."""
    path = shared_folder(spark, "artifacts")
    lines = load(spark, folder, "supplier").select(F.col("s_name").alias("value"), F.col("s_nationkey").alias("nation"))
    lines.repartition("nation").write.partitionBy("nation").text(path)
    root = path.replace("file:", "", 1) if path.startswith("file:") else path
    listed = manifest.scan_artifacts(spark, root, "part-*")
    again = manifest.stat_artifacts(listed.select("path"), path if "://" in path else f"file://{root}")
    both = listed.join(again.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h")), "path", "left")
    same = F.coalesce((F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_h")), F.lit(False))
    return both.groupBy(F.regexp_extract("path", r"nation=(\d+)", 1).alias("nation")).agg(F.sum("bytes").alias("bytes"), F.bool_and(same).alias("same"))
