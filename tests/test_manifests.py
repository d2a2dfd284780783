import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from scripts.compare import compare
from trackloom.operators import gates, manifests
from trackloom.plans import manifest_queries


def test_build_plan_truth_table(spark):
    def expected(exists, current, reusable, overwrite):
        return overwrite or (not current and (exists or not reusable))

    cases = list(itertools.product([False, True], repeat=4))
    df = spark.createDataFrame(cases, "e boolean, c boolean, r boolean, o boolean")
    got = df.select("*", manifests.must_build(*[F.col(c) for c in "ecro"]).alias("b")).collect()
    assert all(r.b == expected(r.e, r.c, r.r, r.o) for r in got)


def test_build_plan_joins(spark, rows):
    samples = spark.createDataFrame([(s, f"l/{s}") for s in "abcd"], "sample_id string, path string")
    files = spark.createDataFrame([("l/a", "h1"), ("l/b", "h2"), ("old/c", "h3"), ("old/b", "h4")], "path string, sha256 string")
    current = spark.createDataFrame([("a", "l/a", "h1"), ("b", "l/b", "other")], "sample_id string, path string, sha256 string")
    reuse = spark.createDataFrame([("b", "old/b", "h4"), ("c", "old/c", "h3"), ("d", "old/d", "h5")], "sample_id string, path string, sha256 string")
    plan = manifests.build_plan(samples, current, reuse, files)
    # a is current; b exists without a verified binding; c can be reused; d has nothing.
    assert rows(plan, "sample_id", "build") == [("a", False), ("b", True), ("c", False), ("d", True)]


HEADER = "id int, schema string, dataset_root string, source_manifest string, source_manifest_sha256 string, source_dataset_summary string, source_dataset_summary_sha256 string, source_point_trajectory_manifest string, source_point_trajectory_manifest_sha256 string"


def test_contract_status(spark, rows):
    base = ["x.wan_ti2v_cache.v4", "/d", "m", "hm", "s", "hs", "t", "ht"]

    def changed(i, value):
        out = list(base)
        out[i] = value
        return out

    cases = [base, changed(0, "x.wan_ti2v_cache.v9"), changed(1, None), changed(2, "../outside"), changed(3, "zz"), changed(4, None),
             changed(5, "zz"), changed(6, "gone"), changed(7, "zz")]
    headers = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], HEADER)
    files = spark.createDataFrame([("m", "hm"), ("s", "hs"), ("t", "ht")], "path string, sha256 string")
    summaries = spark.createDataFrame([("s", "root", "m", "hm")], "path string, path_base string, manifest string, manifest_sha256 string")
    got = rows(manifests.contract_status(headers, files, summaries, "root"), "id", "status")
    assert got == [
        (0, "ok"), (1, "unsupported schema"), (2, "missing dataset root"), (3, "source_manifest must be relative"), (4, "source_manifest changed"),
        (5, "source_dataset_summary contract is missing"), (6, "source_dataset_summary changed"),
        (7, "source_point_trajectory_manifest file is missing"), (8, "source_point_trajectory_manifest changed"),
    ]
    other = rows(manifests.contract_status(headers, files, summaries, "elsewhere").filter("id = 0"), "status")
    assert other == [("summary has an unsupported path base",)]


def test_merge_shards_and_invariants(spark, rows):
    records = spark.createDataFrame([("a", 0, True), ("b", 0, True), ("b", 1, True), ("c", 1, False), ("z", 1, True)], "sample_id string, shard int, complete boolean")
    source = spark.createDataFrame([("c", 0), ("b", 1), ("a", 2)], "sample_id string, ordinal int")
    merged = manifests.merge_shards(records, source)
    assert rows(merged, "sample_id", "status") == [("a", "ok"), ("b", "duplicate"), ("b", "duplicate"), ("c", "incomplete"), ("z", "unknown")]
    headers = spark.createDataFrame([(0, {"schema": "v4", "checkpoint": "x"}), (1, {"schema": "v4"}), (2, {"schema": "v3", "checkpoint": "x"})], "shard int, fields map<string,string>")
    assert rows(manifests.shard_invariants(headers), "shard", "key") == [(1, "checkpoint"), (2, "schema")]


def test_bind_tracks_keeps_object_order(spark, rows):
    samples = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x"])], "sample_id string, object_ids array<string>")
    tracks = spark.createDataFrame([("a", ["y", "x"]), ("b", ["x"])], "sample_id string, object_ids array<string>")
    assert rows(manifests.bind_tracks(samples, tracks)) == [("a", "object_ids_differ"), ("c", "missing")]


def test_contact_coverage(spark, rows):
    contacts = spark.createDataFrame(
        [("s", "sc", c) for c in ("floor", "ramp", "support", "environment_mesh_7", "wall")], "sample_id string, scene string, collider_id string"
    )
    colliders = manifests.collider_catalogue(
        spark.createDataFrame([("s", "ramp", False), ("s", "floor", False)], "sample_id string, collider_id string, solid_wedge boolean"),
        spark.createDataFrame([("s", "ramp", True)], "sample_id string, collider_id string, solid_wedge boolean"),
    )
    scenes = spark.createDataFrame([("sc", '{"floor": 3, "solid_ramp_wedge": 1, "support_visual_mesh": 2, "scene_mesh_7": 9, "wall": 0}')], "scene string, counts_json string")
    coverage = manifests.contact_coverage(contacts, colliders, manifests.represented_parts(scenes))
    assert rows(coverage, "collider_id", "status", "reason") == [
        ("environment_mesh_7", "visual_alias", "reviewed_environment_mesh_replacement"),
        ("floor", "direct", None),
        ("ramp", "visual_alias", "solid_wedge_visual_replacement"),
        ("support", "visual_alias", "reviewed_support_mesh_replacement"),
        ("wall", "not_represented_at_t0", None),
    ]
    report = dict(((a, b), n) for a, b, n in rows(manifests.coverage_report(coverage), "section", "name", "n"))
    assert report[("status", "visual_alias")] == 3 and report[("missing", "wall")] == 1
    samples = spark.createDataFrame([("s", 4)], "sample_id string, ordinal int")
    assert rows(manifests.affected_examples(coverage, samples)) == [("s", 4)]


def test_coverage_report_names_affected_scenes_and_samples(spark, rows):
    bad, good, alias = ("not_represented_at_t0", None), ("direct", None), ("visual_alias", "r")
    contacts = [(1, "a", "x", *bad), (1, "a", "y", *bad), (1, "b", "z", *alias), (2, "a", "x", *bad), (3, "b", "x", *good), (None, "c", None, *bad), (4, None, "z", *good)]
    coverage = spark.createDataFrame(contacts, "sample_id long, scene string, collider_id string, status string, reason string")
    counts = [("alias", "r", 1), ("missing", "-", 1), ("missing", "x", 2), ("missing", "y", 1), ("status", "direct", 2), ("status", bad[0], 4), ("status", "visual_alias", 1)]
    found = [("affected_sample", "-", 1), ("affected_sample", "1", 2), ("affected_sample", "2", 1), ("affected_scene", "a", 3), ("affected_scene", "c", 1)]
    hit = [("total", "affected_samples", 3), ("total", "affected_scenes", 2)]
    got = rows(manifests.coverage_report(coverage).fillna("-"))
    assert got == sorted([*counts, *found, *hit, ("total", "samples", 5), ("total", "scenes", 4)])
    samples = spark.createDataFrame([(1,), (1,), (8,), (9,)], "sample_id long")
    scenes = spark.createDataFrame([("a",), ("d",), ("d",)], "scene string")
    got = rows(manifests.coverage_report(coverage, samples, scenes, 50).fillna("-"))
    assert got == sorted([*counts, *found, *hit, ("total", "samples", 7), ("total", "scenes", 5)])
    none = [("total", n, 0) for n in ("affected_samples", "affected_scenes", "samples", "scenes")]
    assert rows(manifests.coverage_report(coverage.limit(0), samples.limit(0), scenes.limit(0))) == none
    assert rows(manifests.coverage_report(coverage.limit(0), samples).filter("n > 0")) == [("total", "samples", 3)]


@pytest.mark.parametrize("contacts", [0, 40])
def test_coverage_report_of_odd_tables_matches_the_sql(spark, tmp_path, contacts):
    items = [(None if i == 7 else i // 3, None if i == 8 else i % 6, "ARN"[i % 3]) for i in range(contacts)]
    parts = [(i, f"Brand#{i % 4}" if i else None, f"T{i % 2}" if i != 1 else None, 45 + i) for i in range(5)]
    tables = {
        "lineitem": spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_returnflag string"),
        "part": spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int"),
        "orders": spark.createDataFrame([(0,), (1,), (77,), (None,)], "o_orderkey long"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ok, text = compare(spark, con, str(tmp_path), "coverage_report")
    assert ok, text


def test_coverage_report_matches_its_contacts_once(spark):
    report = manifest_queries.coverage_report(spark, "/root/testdata/sf0.001")
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin [l_partkey") == 1 and plan.count("FileScan parquet [l_orderkey") == 1
    assert sum("HashAggregate(keys=[sample_id" in line and "collider_id" in line for line in plan.splitlines()) <= 2


def test_audit_cache_reports_every_defect(spark, rows):
    names = ("sample_id", "base_scene_id", "record_json", "object_ids", "latent_path", "latent_sha256", "text_path", "text_sha256", "track_path", "track_sha256",
             "track_object_ids", "track_object_count", "source_point_trajectory", "source_point_trajectory_sha256", "first_frame", "first_frame_sha256", "scene",
             "scene_sha256", "video", "video_sha256")
    schema = ", ".join(f"{n} {'array<string>' if 'object_ids' in n else 'int' if n.endswith('count') else 'string'}" for n in names)
    good = ["a", "sc", "{}", ["o"], "la", "1", "t", "2", "ka", "3", ["o"], 1, "pa", "4", "f", "5", "s", "6", "v", "7"]
    bad = ["b", "sc", "{1}", ["o"], "la", "1", "t", "2", "kb", "3", ["p"], 2, "pb", "4", "f", "9", "s", "6", "v", "7"]
    records = spark.createDataFrame([good, bad], schema)
    source = spark.createDataFrame([("a", "{}"), ("b", "{}")], "sample_id string, record_json string")
    tracks = spark.createDataFrame([("a", "pa", "4", ["o"], 1), ("b", "px", "4", ["o"], 1)], "sample_id string, path string, sha256 string, object_ids array<string>, object_count int")
    files = spark.createDataFrame([("la", 1, "1"), ("t", 1, "2"), ("ka", 1, "3"), ("pa", 1, "4"), ("f", 1, "5"), ("s", 1, "6"), ("v", 1, "7"), ("pb", 1, "4")], "path string, bytes long, sha256 string")
    found = rows(manifests.audit_cache(records, source, tracks, files), "sample_id", "message")
    assert found == sorted(
        [("a", "latent.shared: la"), ("b", "latent.shared: la"), ("b", "record.changed"), ("b", "artifact: first_frame"),
         ("b", "artifact: track"), ("b", "track.objects"), ("b", "track.count"),
         ("b", "trajectory.path")]
    )


def gate_row(**changes):
    row = dict(scene="s", aligned_mask_iou=0.65, relative_depth_error=0.03, environment_completion_fraction=0.8, environment_surface_coverage=0.95,
               positive_completion_fraction=0.99, known_depth_error=0.08, seam_p90_error=0.1, physical_proxy_verified=True)
    row.update(changes)
    return row


@pytest.mark.parametrize("field,value,reason", [
    ("aligned_mask_iou", 0.64, "mesh-mask"), ("relative_depth_error", None, "depth"), ("relative_depth_error", 0.031, "depth"),
    ("environment_completion_fraction", 0.79, "environment-hole"), ("environment_surface_coverage", 0.9, "environment-coverage"),
    ("positive_completion_fraction", 0.98, "depthlab-missing"), ("known_depth_error", 0.09, "depthlab-scale"),
    ("seam_p90_error", 0.11, "environment-seam"), ("physical_proxy_verified", False, "support"), ("scene", "t", None),
])
def test_gate(spark, field, value, reason):
    names = list(gate_row())
    schema = ", ".join(f"{n} {'string' if n == 'scene' else 'boolean' if n.startswith('phys') else 'double'}" for n in names)
    row = gate_row(**{field: value})
    df = spark.createDataFrame([tuple(row[n] for n in names)], schema)
    out = gates.quality_gate(gates.failure_reasons(df)).first()
    assert out.reasons == ([reason] if reason else []) and out.passed is (reason is None)
