"""Audit of structured scene packages: artifacts, archives, masks and quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C
from trackloom.functions import checks as K
from trackloom.operators.masks import mask_algebra

#: Counts of ``mask_algebra`` that make a scene fail; the rule id is ``mask.<count>``.
MASK_RULES = (
    "completion_replaces_observed", "completed_depth_not_positive", "completion_outside_hole", "dense_is_not_union", "dense_outside_content",
    "depth_outside_completion", "hole_outside_content", "raw_depth_in_padding", "raw_depth_not_positive", "reliable_not_observed",
)


def artifact_errors(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(scene, error) for declared artifacts that escape, are missing or differ."""
    declared = F.try_variant_get("manifest", "$.artifacts", "map<string,struct<bytes:bigint,sha256:string>>")
    listed = packages.select("scene", F.explode(declared).alias("name", "want")).withColumn(
        "path", F.concat_ws("/", "scene", "name")
    )
    disk = files.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    joined = listed.join(disk, "path", "left")
    outside = F.contains("name", F.lit("/")) | (F.col("name") == "..")
    rule = (
        F.when(outside, F.array(F.lit("artifact.outside")))
        .when(F.col("_h").isNull(), F.array(F.lit("artifact.absent")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(~F.col("_b").eqNullSafe(F.col("want.bytes")), F.lit("artifact.bytes")),
                    F.when(~F.col("_h").eqNullSafe(F.col("want.sha256")), F.lit("artifact.sha256")),
                )
            )
        )
    )
    notes = F.transform(rule, lambda r: F.concat(r, F.lit(": "), F.col("name")))
    return joined.select("scene", F.explode(notes).alias("error"))


def audit_packages(
    scenes: DataFrame,
    packages: DataFrame,
    files: DataFrame,
    documents: DataFrame,
    headers: DataFrame,
    cloud: DataFrame,
    pixels: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(errors per scene, verdict per scene); an error is a rule id, with its subject after a colon.

    ``scenes(scene)`` lists directories; ``packages(scene, manifest)``; ``files(path,
    bytes, sha256)`` with paths below the root; ``documents(path, doc)`` are the parsed
    reports and physics files; ``headers(scene, fields, problems)``; ``cloud`` and
    ``pixels`` as in ``mask_algebra``.
    """
    def text(path: str) -> Column:
        return F.try_variant_get("manifest", path, "string")

    # Presence of an optional-name document next to the manifest, by one join each.
    def bound(name: Column, label: str) -> DataFrame:
        wanted = packages.select("scene", F.concat_ws("/", F.col("scene"), name).alias("path"))
        found = wanted.join(files.select("path", F.lit(True).alias("_f")), "path", "left").join(documents, "path", "left")
        return found.select("scene", F.col("_f").isNotNull().alias(label), F.col("doc").alias(f"{label}_doc"))

    table = (
        scenes.join(packages, "scene", "left")
        .join(bound(F.coalesce(text("$.quality_report"), F.lit("report.json")), "report"), "scene", "left")
        .join(bound(F.lit("physics.json"), "physics"), "scene", "left")
        .join(bound(F.lit(C.COLLISION_PROXY), "proxy").drop("proxy_doc"), "scene", "left")
        .join(bound(F.coalesce(text("$.scene_archive"), F.lit("scene.npz")), "archive").drop("archive_doc"), "scene", "left")
        .join(headers, "scene", "left")
    )
    present = F.col("manifest").isNotNull()
    named = F.try_variant_get("physics_doc", "$.collision_proxy", "string") == C.COLLISION_PROXY
    absent = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in C.SCENE_ARRAYS]), F.col("fields")))
    checks = F.array_compact(
        F.array(
            F.when(~present, F.lit("manifest.absent")),
            F.when(present & ~F.coalesce(text("$.schema").rlike(C.PACKAGE_SCHEMA_PATTERN), F.lit(False)), F.lit("manifest.schema")),
            F.when(present & ~F.col("report"), F.lit("report.absent")),
            F.when(present & ~F.col("physics"), F.lit("physics.absent")),
            F.when(
                present & F.col("physics") & ~(F.coalesce(named, F.lit(False)) & F.col("proxy")),
                F.lit("physics.proxy"),
            ),
            F.when(present & ~F.col("archive"), F.lit("archive.absent")),
            F.when(F.size(absent) > 0, F.concat(F.lit("archive.fields: "), F.array_join(absent, ", "))),
        )
    )
    structural = table.select("scene", F.explode(F.concat(checks, F.coalesce("problems", F.array().cast("array<string>")))).alias("error"))
    points = cloud.groupBy("scene").agg(
        F.bool_and(K.finite(F.col("x")) & K.finite(F.col("y")) & K.finite(F.col("z"))).alias("_finite"),
        F.bool_and(F.col("source").isin(0, 1, 2)).alias("_known"),
    )
    cloud_errors = points.select(
        "scene",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("_finite"), F.lit("cloud.finite")),
                    F.when(~F.col("_known"), F.lit("cloud.source")),
                )
            )
        ).alias("error"),
    )
    counts = mask_algebra(pixels)
    mask_errors = counts.select(
        "scene", F.explode(F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(f"mask.{n}")) for n in MASK_RULES]))).alias("error")
    )
    errors = structural.unionByName(artifact_errors(packages, files)).unionByName(cloud_errors).unionByName(mask_errors)
    failed = errors.groupBy("scene").agg(F.count(F.lit(1)).alias("errors"))
    gate = F.coalesce(F.try_variant_get("report_doc", "$.quality_gate.passed", "boolean"), F.lit(False))
    verdict = (
        table.select("scene", gate.alias("quality_gate_passed"))
        .join(failed, "scene", "left")
        .select(
            "scene",
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.col("errors").isNull().alias("integrity_passed"),
            "quality_gate_passed",
            (F.col("errors").isNull() & F.col("quality_gate_passed")).alias("passed"),
        )
    )
    return errors, verdict
