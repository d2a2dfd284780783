"""Reconstruction quality gates and batch roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C
from trackloom.functions.ordered import top_k

# measurement, comparison that fails the gate, reason
GATES = (
    ("aligned_mask_iou", "below", "mesh-mask"),
    ("relative_depth_error", "above", "depth"),
    ("environment_completion_fraction", "below", "environment-hole"),
    ("environment_surface_coverage", "below", "environment-coverage"),
    ("positive_completion_fraction", "below", "depthlab-missing"),
    ("known_depth_error", "above", "depthlab-scale"),
    ("seam_p90_error", "above", "environment-seam"),
)


def failure_reasons(scenes: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Ordered array ``reasons`` of failed gates; an unknown depth error fails."""
    limits = thresholds or C.GATE_THRESHOLDS
    tests: list[Column] = []
    for name, side, reason in GATES:
        value, limit = F.col(name), F.lit(limits[name])
        failed = value < limit if side == "below" else value > limit
        if name == "relative_depth_error":
            failed = value.isNull() | failed
        tests.append(F.when(failed, F.lit(reason)))
    tests.append(F.when(~F.col("physical_proxy_verified"), F.lit("support")))
    return scenes.withColumn("reasons", F.array_compact(F.array(*tests)))


def quality_gate(scenes: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``passed`` only when all eight conditions hold; NULL measurements do not pass."""
    limits = thresholds or C.GATE_THRESHOLDS
    ok = F.col("physical_proxy_verified")
    for name, side, _ in GATES:
        value = F.col(name)
        ok = ok & (value >= limits[name] if side == "below" else value <= limits[name])
    return scenes.withColumn("passed", F.coalesce(ok, F.lit(False)))


def failure_counts(scenes: DataFrame) -> DataFrame:
    """Count per reason over the fixed reason list, zero-filled."""
    domain = scenes.sparkSession.createDataFrame(
        [(i, r) for i, r in enumerate(C.GATE_REASONS)], "position int, reason string"
    )
    hits = scenes.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(hits, "reason", "left").select("position", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def pass_counts(scenes: DataFrame) -> DataFrame:
    """Scenes, scenes without any failure, scenes without an environment failure."""
    environment = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in C.ENVIRONMENT_REASONS]))
    return scenes.agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.count_if(F.size("reasons") == 0).alias("quality_pass_count"),
        F.count_if(~environment).alias("environment_quality_pass_count"),
    )


def completion_stats(pixels: DataFrame, key: str = "scene") -> DataFrame:
    """Completion fractions and pixel counts per scene; denominators are at least 1.

    ``pixels(scene, object, content, observed, reliable, completed)``.
    """
    def count(cond: Column) -> Column:
        return F.count_if(cond)

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.greatest(bottom, F.lit(1))

    o, c, s, r, m = (F.col(x) for x in ("object", "content", "observed", "reliable", "completed"))
    return pixels.groupBy(key).agg(
        ratio(count(m & o), count(o)).alias("object_mask_completion_fraction"),
        ratio(count(m), count(c & ~s)).alias("missing_environment_completion_fraction"),
        ratio(count(s | m), count(c)).alias("content_surface_coverage"),
        count(s).alias("observed_pixel_count"),
        count(r).alias("reliable_observed_pixel_count"),
        count(m).alias("completed_pixel_count"),
        count(c).alias("content_pixel_count"),
    )


def candidate_score(df: DataFrame) -> DataFrame:
    """Segmentation candidate score.

    Columns: predicted_iou, stability_score, area_fraction, box_x, box_y, box_width,
    box_height, width, height, border_fraction, scene_median, scene_scale,
    object_median and object_scale (NULL when the mask has no valid depth).
    """
    area = F.col("area_fraction")
    box = F.col("box_width") * F.col("box_height") / (F.col("width") * F.col("height"))
    compact = area / F.greatest(box, F.lit(1e-6))
    one = F.lit(1.0)
    aspect = F.greatest(
        F.col("box_width") / F.greatest(F.col("box_height"), one),
        F.col("box_height") / F.greatest(F.col("box_width"), one),
    )
    aspect_penalty = F.greatest(F.log(F.greatest(aspect, one) / 2.0), F.lit(0.0))
    off_x = (F.col("box_x") + F.col("box_width") * 0.5) / F.col("width") - 0.5
    off_y = (F.col("box_y") + F.col("box_height") * 0.5) / F.col("height") - 0.5
    centre = F.sqrt(off_x * off_x + off_y * off_y) / F.sqrt(F.lit(0.5))
    known = F.col("object_median").isNotNull()
    nearer = F.tanh(F.greatest((F.col("scene_median") - F.col("object_median")) / F.col("scene_scale"), F.lit(-2.0)))
    foreground = F.when(known, nearer).otherwise(F.lit(-1.0))
    tight = F.exp(-F.col("object_scale") / F.greatest(F.abs("object_median"), F.lit(1e-6)))
    depth_compact = F.when(known, tight).otherwise(F.lit(0.0))
    area_score = F.when(~area.between(0.001, 0.22), F.lit(-4.0)).otherwise(
        -F.abs(F.log(F.greatest(area, F.lit(1e-6)) / 0.025)) * 0.35
    )
    score = (
        1.6 * F.col("predicted_iou")
        + 1.2 * F.col("stability_score")
        + 0.6 * compact
        + 0.45 * foreground
        + 0.35 * depth_compact
        + area_score
        - 1.2 * centre
        - 0.55 * aspect_penalty
        - 2.0 * F.col("border_fraction")
    )
    return df.withColumn("score", score)


def rank_candidates(scored: DataFrame, group: str, order: str, keep: int = 20) -> DataFrame:
    """Best ``keep`` candidates per image; ties keep the earlier candidate first."""
    return top_k(scored, [group], [F.col("score").desc(), order], keep)


def best_solution(views: DataFrame, solutions: DataFrame, group: str, keep: int = 10) -> DataFrame:
    """Keep the ``keep`` views with most matches, then the solution with most inliers
    and least error.  ``views(group, view, matches, shape)``;
    ``solutions(group, view, inliers, error)``."""
    kept = top_k(views, [group], [F.col("matches").desc(), "shape", "view"], keep, "_rank")
    joined = solutions.join(kept.select(group, "view"), [group, "view"], "left_semi")
    row = F.struct("inliers", (-F.col("error")).alias("_e"), "view", "error")
    return joined.groupBy(group).agg(F.max(row).alias("_b")).select(
        group, "_b.view", "_b.inliers", "_b.error"
    )
