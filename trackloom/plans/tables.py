"""The shared test tables and the views the queries read them through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.functions.ordered import index_within, micros


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sweep_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sweep samples: scene = customer, axis = status, level = priority."""
    return load(spark, folder, "orders").select(
        F.col("o_custkey").alias("scene"),
        F.col("o_orderstatus").alias("axis"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"),
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_totalprice").alias("price"),
    )


SWEEP_SQL = """
levels AS (
  SELECT o_custkey AS scene, o_orderstatus AS axis,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS level,
         o_orderkey AS sample_id, o_totalprice AS price
  FROM orders),
complete AS (
  SELECT scene, axis FROM levels GROUP BY scene, axis
  HAVING count(*) = 5 AND count(DISTINCT level) = 5 AND min(level) = 0 AND max(level) = 4)
"""


def user_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events as frames: video = user, frame = position in time.

    Positions are taken per (user, day), so a user with most of the events still
    spreads over all days.
    """
    events = load(spark, folder, "events").select(
        F.col("user_id").alias("video"), micros("ts").alias("t"), "event_id", "event_type", "value"
    )
    day = F.floor(F.col("t") / F.lit(86_400_000_000))
    return index_within(events, ["video"], ["t", "event_id"], day, "frame")


FRAMES_SQL = """
frames AS (
  SELECT user_id AS video, epoch_us(ts) AS t, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events)
"""

SIDE = 32


def grid_points(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as pixels of a 32 x 32 image: frame = label, depth = third value."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]

    def pixel(c):
        return F.least(F.floor((c + 1.0) * 16.0), F.lit(SIDE - 1)).cast("int")

    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("label").alias("frame"),
        pixel(e[0]).alias("x"),
        pixel(e[1]).alias("y"),
        e[0].alias("e1"),
        e[1].alias("e2"),
        e[2].alias("e3"),
    )


GRID_SQL = """
grid AS (
  SELECT vec_id AS point_id, label AS frame,
         least(CAST(floor((CAST(embedding[1] AS DOUBLE) + 1.0) * 16.0) AS INTEGER), 31) AS x,
         least(CAST(floor((CAST(embedding[2] AS DOUBLE) + 1.0) * 16.0) AS INTEGER), 31) AS y,
         CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2,
         CAST(embedding[3] AS DOUBLE) AS e3
  FROM embeddings)
"""

BLOCK = 64
FRAMES = 4


def track_points(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as point tracks: 64 consecutive vectors make a sample, three values a frame.

    The camera looks along z from two units away with focal length 20.
    """
    frame = F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame")
    base = load(spark, folder, "embeddings").select("vec_id", "label", "embedding", frame)

    def value(i: int):
        return F.get("embedding", F.col("frame") * 3 + i).cast("double")

    z = value(2) + 2.0
    u = (20.0 * value(0) + 20.0 * z) / z
    v = (-20.0 * value(1) + 15.0 * z) / z
    return base.select(
        F.floor(F.col("vec_id") / BLOCK).cast("string").alias("sample_id"),
        "frame",
        (F.col("label") % 3).cast("int").alias("slot"),
        (F.col("vec_id") % BLOCK).cast("int").alias("point_id"),
        value(0).alias("cx"),
        value(1).alias("cy"),
        z.alias("cz"),
        u.alias("u"),
        v.alias("v"),
        z.alias("depth"),
        ((u >= 0) & (u < 40) & (v >= 0) & (v < 30)).alias("valid"),
    )


def track_meta(points: DataFrame) -> DataFrame:
    return points.select("sample_id").distinct().select(
        "sample_id", F.lit(FRAMES).alias("frames"), F.lit(40).alias("width"), F.lit(30).alias("height")
    )


def track_initial(points: DataFrame) -> DataFrame:
    return points.filter("frame = 0").select(
        "sample_id", "slot", "point_id", F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("cz").alias("iz")
    )


TRACK_SQL = """
raw AS (
  SELECT CAST(vec_id // 64 AS VARCHAR) AS sample_id, f AS frame, label % 3 AS slot, vec_id % 64 AS point_id,
         CAST(embedding[f * 3 + 1] AS DOUBLE) AS cx, CAST(embedding[f * 3 + 2] AS DOUBLE) AS cy,
         CAST(embedding[f * 3 + 3] AS DOUBLE) + 2.0 AS cz
  FROM embeddings, range(4) AS steps(f)),
projected AS (
  SELECT *, cz AS depth, (20.0 * cx + 20.0 * cz) / cz AS u, (-20.0 * cy + 15.0 * cz) / cz AS v FROM raw),
points AS (
  SELECT *, u >= 0 AND u < 40 AND v >= 0 AND v < 30 AS valid FROM projected)
"""
