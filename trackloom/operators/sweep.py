"""One-factor sweeps: complete levels, level pairs, response and schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C
from trackloom.functions.ordered import DEFAULT_BLOCK, top_k, with_adjacent
from trackloom.functions.quantiles import percentiles
from trackloom.functions.geometry import norm


def sweep_levels(samples: DataFrame, axes: Sequence[str] = C.SWEEP_AXES) -> DataFrame:
    """(scene, axis, level) rows; a base row fills its own level on every axis."""
    base = (
        samples.filter(F.col("mode") == "base")
        .withColumn("axis", F.explode(F.array(*[F.lit(a) for a in axes])))
        .select(
            "base_scene_id",
            "axis",
            F.element_at("base_level_indices", F.col("axis")).alias("level"),
            "sample_id",
            "ordinal",
            F.lit(True).alias("is_base"),
        )
    )
    factor = samples.filter((F.col("mode") != "base") & F.col("axis").isin(*axes)).select(
        "base_scene_id",
        "axis",
        F.col("level_index").alias("level"),
        "sample_id",
        "ordinal",
        F.lit(False).alias("is_base"),
    )
    return base.unionByName(factor)


def level_status(levels: DataFrame, keys: Sequence[str], level: str, count: int = C.LEVEL_COUNT) -> DataFrame:
    """Per sweep: rows, distinct levels inside the range, and whether it is complete.

    Fixed-width counters per level merge map-side; nothing is collected.
    """
    per_level = [F.count_if(F.col(level) == i).alias(f"_n{i}") for i in range(count)]
    counted = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *per_level)
    distinct = sum(((F.col(f"_n{i}") > 0).cast("int") for i in range(count)), F.lit(0))
    single = F.lit(True)
    for i in range(count):
        single = single & (F.col(f"_n{i}") == 1)
    return counted.select(
        *keys,
        "rows",
        distinct.alias("levels_present"),
        (F.col("rows") - distinct).alias("surplus_rows"),
        (single & (F.col("rows") == count)).alias("complete"),
    )


def complete_levels(levels: DataFrame, keys: Sequence[str], level: str, count: int = C.LEVEL_COUNT) -> DataFrame:
    """Rows of complete sweeps only.  Complete sweeps hold exactly ``count`` rows each."""
    good = level_status(levels, keys, level, count).filter("complete").select(*keys)
    return levels.join(good, list(keys), "left_semi")


def sweep_pairs(levels: DataFrame, keys: Sequence[str], level: str, carry: Sequence[str], endpoints_only: bool = False) -> DataFrame:
    """Adjacent level pairs plus the outer pair (``kind``) of complete sweeps.

    Expects complete sweeps, so a group is ``LEVEL_COUNT`` rows: one pivoting
    aggregation gives all pairs without a self join.
    """
    keys = list(keys)
    cells = F.struct(F.col(level).alias("level"), *[F.col(c).alias(c) for c in carry])
    grouped = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(cells)).alias("_l"))
    last = F.size("_l") - 1

    def pair(low: Column, high: Column, kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))

    outer = F.array(pair(F.element_at("_l", 1), F.element_at("_l", -1), "endpoint"))
    adjacent = F.transform(
        F.sequence(F.lit(0), last - 1), lambda i: pair(F.get("_l", i), F.get("_l", i + 1), "adjacent")
    )
    pairs = outer if endpoints_only else F.concat(adjacent, outer)
    exploded = grouped.filter(F.size("_l") > 1).select(*keys, F.explode(pairs).alias("_p"))
    names = ["level", *carry]
    return exploded.select(
        *keys,
        F.col("_p.kind").alias("kind"),
        *[F.col(f"_p.low.{c}").alias(f"low_{c}") for c in names],
        *[F.col(f"_p.high.{c}").alias(f"high_{c}") for c in names],
    )


def path_length(
    poses: DataFrame, keys: Sequence[str], frame: str, axes: Sequence[str], block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Sum of step lengths in frame order per key."""
    stepped = with_adjacent(poses.select(*keys, frame, *axes), keys, frame, axes, block=block)
    step = norm(*[F.col(a) - F.col(f"prev_{a}") for a in axes])
    return stepped.groupBy(*keys).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("path_length"))


def sweep_response(pairs: DataFrame, poses: DataFrame, extents: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Separation of the low and high trajectory of each endpoint pair.

    ``poses(sample_id, frame, px, py, pz)``; ``extents(sample_id, extent)``.  Both
    sides are keyed by (sample, frame), so the join cannot skew on a scene.
    """
    axes = ("px", "py", "pz")
    lengths = path_length(poses, ["sample_id"], "frame", axes)
    frames = poses.groupBy("sample_id").agg(F.count(F.lit(1)).alias("frames"))
    info = lengths.join(frames, "sample_id").join(extents, "sample_id")

    def side(name: str) -> DataFrame:
        return info.select(
            F.col("sample_id").alias(f"{name}_sample_id"),
            F.col("path_length").alias(f"{name}_path"),
            F.col("frames").alias(f"{name}_frames"),
            F.col("extent").alias(f"{name}_extent"),
        )

    def track(name: str) -> DataFrame:
        return poses.select(
            F.col("sample_id").alias(f"{name}_sample_id"),
            "frame",
            *[F.col(a).alias(f"{name}_{a}") for a in axes],
        )

    bound = pairs.join(side("low"), "low_sample_id").join(side("high"), "high_sample_id")
    keys = bound.columns
    frames_joined = bound.join(track("low"), "low_sample_id").join(track("high"), ["high_sample_id", "frame"])
    separation = norm(*[F.col(f"low_{a}") - F.col(f"high_{a}") for a in axes])
    measured = frames_joined.withColumn("_s", separation).groupBy(*keys).agg(
        F.max(F.when(F.col("frame") == 0, F.col("_s"))).alias("initial_separation"),
        F.max(F.when(F.col("frame") == F.col("low_frames") - 1, F.col("_s"))).alias("final_separation"),
        F.avg("_s").alias("mean_separation"),
        F.max("_s").alias("max_separation"),
    )
    extent = F.greatest("low_extent", "high_extent")
    return (
        measured.withColumn("extent", extent)
        .withColumn("max_extents", F.col("max_separation") / F.col("extent"))
        .withColumn("path_delta", F.abs(F.col("low_path") - F.col("high_path")))
        .withColumn("same_frames", F.col("low_frames") == F.col("high_frames"))
        .withColumn("active", F.col("max_extents") >= threshold)
        .withColumn("initial_invariant", F.col("initial_separation") <= 1e-5)
        .drop("low_path", "high_path", "low_extent", "high_extent")
    )


def axis_summary(
    pairs: DataFrame, axis: str, response: str, active: str, axes: Sequence[str] | None = None
) -> DataFrame:
    """Per axis: groups, active count and fraction, median and maximum response.

    With ``axes`` the result is zero-filled for axes that have no pair.
    """
    counted = pairs.groupBy(axis).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(F.col(active)).alias("active_count"),
        F.max(response).alias("max_response"),
    )
    medians = percentiles(pairs, [axis], response, [0.5], ["median_response"])
    out = counted.join(medians, axis, "left")
    if axes is not None:
        domain = pairs.sparkSession.createDataFrame([(a,) for a in axes], f"{axis} string")
        out = domain.join(out, axis, "left").na.fill(
            {"group_count": 0, "active_count": 0, "max_response": 0.0, "median_response": 0.0}
        )
    return out.withColumn(
        "active_fraction",
        F.when(F.col("group_count") > 0, F.col("active_count") / F.col("group_count")).otherwise(0.0),
    )


def top_groups(pairs: DataFrame, axis: str, response: str, ordinal: str, k: int) -> DataFrame:
    """Top ``k`` rows per axis by response; ties keep source order."""
    return top_k(pairs, [axis], [F.col(response).desc(), ordinal], k)


def training_schedule(
    spark, steps: int, ranks: int, accumulation: int, axes: Sequence[str] = C.RESPONSE_AXIS_CYCLE
) -> DataFrame:
    """Draw indices of every (step, rank, microbatch): two response steps in five.

    Ordinary microbatches take two records, response microbatches one low/high pair.
    """
    total = steps * ranks * accumulation
    plan = spark.range(total).select(
        F.floor(F.col("id") / (ranks * accumulation)).cast("long").alias("step"),
        (F.floor(F.col("id") / accumulation) % ranks).cast("long").alias("rank"),
        (F.col("id") % accumulation).cast("long").alias("micro"),
    )
    response = F.col("step") % 5 < 2
    periods = F.floor(F.col("step") / 5)
    response_before = periods * 2 + F.least(F.col("step") % 5, F.lit(2))
    index = F.when(response, periods * 2 + F.col("step") % 5).otherwise(F.col("step") - response_before)
    micro_index = index * accumulation + F.col("micro")
    cycle = F.array(*[F.lit(a) for a in axes])
    axis = F.get(cycle, (micro_index % len(axes)).cast("int"))
    return plan.select(
        "step",
        "rank",
        "micro",
        F.when(response, F.lit("response")).otherwise(F.lit("ordinary")).alias("mode"),
        F.when(response, axis).alias("axis"),
        F.when(response, micro_index * ranks + F.col("rank"))
        .otherwise((micro_index * ranks + F.col("rank")) * 2)
        .cast("long")
        .alias("draw_index"),
    )
