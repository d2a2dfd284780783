"""Mask images as pixel tables, through Spark's image source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mask pixels (source, y, x), status per image).

    The alpha channel is used when there is one, a single channel otherwise; an RGB
    image without alpha and a constant mask are rejected (``problem`` is set).  An image
    becomes one row per image row before pixels are exploded.
    """
    images = spark.read.format("image").load(path).select(
        F.col("image.origin").alias("source"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    stride = F.col("width") * F.col("channels")
    rows = images.filter(F.col("channels").isin(1, 4)).select(
        "source", "height", "width", "channels", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "data"
    ).withColumn("_row", F.hex(F.substr("data", F.col("y") * stride + 1, stride)))
    # Two hex digits per byte; the last byte of each pixel is the alpha (or the only one).
    digits = F.substr("_row", (F.col("x") * F.col("channels") + F.col("channels") - 1) * 2 + 1, F.lit(2))
    pixels = rows.drop("data").select(
        "source", "height", "width", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "channels", "_row"
    ).select("source", "y", "x", (digits != "00").alias("on"), digits.alias("_v"))
    span = pixels.groupBy("source").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    status = images.drop("data").join(span, "source", "left").select(
        "source", "height", "width", "channels",
        F.when(~F.col("channels").isin(1, 4), F.lit("colour image without alpha"))
        .when(F.col("_lo") == F.col("_hi"), F.lit("constant mask")).alias("problem"),
    )
    return pixels.filter("on").select("source", "y", "x"), status


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame_pixels(video, frame, y, x, r, g, b) from ``<video>/frame_NNNN.png`` files."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    origin = F.col("image.origin")
    rows = images.select(
        F.regexp_extract(origin, r"([^/]+)/[^/]+$", 1).alias("video"),
        (F.regexp_extract(origin, r"(\d+)\.[a-z]+$", 1).cast("int") - 1).alias("frame"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.explode(F.sequence(F.lit(0), F.col("image.height") - 1)).alias("y"),
        F.col("image.data").alias("data"),
    )
    stride = F.col("width") * F.col("channels")
    lines = rows.withColumn("_row", F.hex(F.substr("data", F.col("y") * stride + 1, stride))).drop("data")

    def channel(i: int) -> Column:
        start = (F.col("x") * F.col("channels") + F.least(F.lit(i), F.col("channels") - 1)) * 2 + 1
        return F.conv(F.substr("_row", start, F.lit(2)), 16, 10).cast("short")

    spread = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    # The decoder stores blue, green, red.
    return spread.select("video", "frame", "y", "x", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))
