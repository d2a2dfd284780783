"""Wall time of the named queries; prints one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (comma separated) a subset.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trackloom.plans.catalogue import catalogue
from trackloom.session import build_session

HEADLINE = (
    "sweep_axis_summary", "sweep_level_pairs", "top_groups", "manifest_summary", "duplicate_artifacts", "split_leakage",
    "record_violations", "exact_keys", "forbidden_text", "forbidden_keys", "select_records", "round_robin", "even_groups",
    "frame_resample", "merge_shards", "changed_records", "build_plan", "nominal_lookup", "contact_coverage", "coverage_report",
    "artifact_status", "contract_diff", "training_schedule", "path_length", "second_difference", "adjacent_stats", "frame_stats",
    "frame_median", "finite_runs", "running_best", "temporal_pool4", "track_candidates", "identity_tracks", "identity_tracks_sql",
    "identity_tracks_static", "dense_tracks", "object_cells", "validate_tracks", "zbuffer", "occupancy_iou", "cover_crop",
    "dilate", "erode", "expand_hole", "neighbour_min", "mask_algebra", "split_scene", "quality_gate", "candidate_ranking",
    "robust_scale", "trimmed_median", "nearest_neighbour", "support_relation", "plane_fit", "components", "weighted_metrics",
    "masked_mse", "balanced_weights", "js_divergence", "best_cosine", "motion_errors", "validate_records", "sweep_response",
    "foreground_mask", "package_errors", "audit_cache", "live_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.driver.host": "localhost"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue()
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the JVM before timing
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").count()  # and the Python workers
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name].spark_frame(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
