"""JSON by path, cache headers, and archives that are damaged."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import audit, documents, headers, manifests
from trackloom.sources import archives, manifest, sinks


def test_json_differences_name_their_paths(spark, rows):
    left = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": {}}'), (2, "[]"), (3, "{no"), (4, None), (5, '{"x": 1.0}')], "id int, raw string")
    right = spark.createDataFrame([(1, '{"a": [1, {"b": 2}, 3], "c": {}}'), (2, "[]"), (3, "{no"), (4, "1"), (5, '{"x": 1.0, "y": "é"}')], "id int, raw string")
    got = sorted(map(tuple, headers.json_diff(left, right, "id").collect()))
    assert got == [(1, "$.a[1].b", "null", "2"), (1, "$.a[2]", None, "3"), (4, "$", None, "1"), (5, "$.y", None, '"\\u00e9"')]
    deep = "[" * 900 + "1" + "]" * 900
    assert headers.json_leaves(spark.createDataFrame([("d", deep)], "k string, raw string"), "k", "raw").first().value == "1"


def _tracks(points=3, **change):
    world = np.arange(2 * points * 3, dtype="float32").reshape(2, 1, points, 3)
    arrays = {
        "time_s": np.arange(2.0), "object_ids": np.array(["o"]), "points_world_m": world, "points_camera_m": world, "tracks_xy_px": world[..., :2], "depth_m": world[..., 2],
        "valid": np.ones((2, 1, points), "uint8"), "initial_points_camera_m": world[0], "camera_from_world": np.eye(4), "camera_intrinsics": np.eye(3), "image_size_px": np.array([4, 3]), "metadata_json": np.array("{}"),
    }
    return {k: v for k, v in {**arrays, **change}.items() if v is not None}


def test_every_damage_is_a_problem_row_and_stops_nothing(spark, tmp_path, rows):
    made = {
        "ok": archives.pack_npz(_tracks()), "lacking": archives.pack_npz(_tracks(depth_m=None, camera_intrinsics=None)), "shape": archives.pack_npz(_tracks(valid=np.ones((2, 3)))),
        "words": archives.pack_npz(_tracks(valid=np.full((2, 1, 3), "x"))), "cut": archives.pack_npz(_tracks())[:-300], "other": b"plain text", "one": b"\x93NUMPY", "odd": archives.pack_npz(_tracks(image_size_px=np.array(["a", "b"]))),
    }
    for name, content in made.items():
        (tmp_path / f"{name}.npz").write_bytes(content)
    got = archives.read_tracks(archives.binary_files(spark, str(tmp_path)))
    found = sorted((r.sample_id, r.array or "", r.problem) for r in got["problems"].collect())
    named = [("lacking", "camera_intrinsics", "missing"), ("lacking", "depth_m", "missing"), ("shape", "valid", "shape"), ("words", "valid", "type"), ("odd", "meta", "malformed")]
    assert found == sorted(named + [(n, "", "unreadable") for n in ("cut", "other", "one")])
    counts = {r.sample_id: r.n for r in got["points"].groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"ok": 6, "odd": 6}
    assert {r.sample_id for r in got["cameras"].collect()} == {"ok", "shape", "words", "odd"}
    assert {r.sample_id for r in got["meta"].collect()} == {"ok", "lacking", "shape", "words"}


def test_flags_that_are_no_flags(spark, tmp_path, rows):
    valid = np.array([[[0, 1, 2]], [[1, -1, 0]]], "int8")
    (tmp_path / "s.npz").write_bytes(archives.pack_npz(_tracks(valid=valid)))
    points = archives.read_track_points(archives.binary_files(spark, str(tmp_path)))
    assert rows(points, "frame", "point_id", "valid", "valid_binary") == [
        (0, 0, False, True), (0, 1, True, True), (0, 2, True, False), (1, 0, True, True), (1, 1, True, False), (1, 2, False, True),
    ]


def test_safetensors_round_trip_and_cut_files(spark, tmp_path, rows):
    tensor = np.zeros((12, 2, 2, 2), "float32")
    tensor[3, 1, 0, 1] = 1
    whole = archives.pack_safetensors({"point_track_map": tensor})
    for name, content in (("ok", whole), ("cut", whole[:-8]), ("head", whole[:20]), ("none", b"")):
        (tmp_path / f"{name}.safetensors").write_bytes(content)
    got = archives.read_cell_tables(archives.binary_files(spark, str(tmp_path), "*.safetensors"))
    assert rows(got["cells"], "sample_id", "slot", "frame", "cy", "cx", "visible") == [("ok", 0, 1, 0, 1, 1.0)]
    assert rows(got["header"], "sample_id", "ok") == [("ok", True)]
    assert {r.sample_id for r in got["problems"].collect()} >= {"cut", "head"}


def test_files_appear_whole_and_inside_the_folder(spark, tmp_path):
    files = spark.createDataFrame([("a/b.bin", bytearray(b"xy")), ("../out.bin", bytearray(b"z")), ("c.bin", bytearray(b""))], "path string, content binary")
    for _ in range(2):
        written = {r.path: r.bytes for r in sinks.write_files(files, str(tmp_path / "f")).collect()}
    assert written == {"a/b.bin": 2, "c.bin": 0}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["f/a/b.bin", "f/c.bin"]


def test_shard_documents_have_their_contract_names(spark, tmp_path):
    records = spark.createDataFrame([(s, i, json.dumps({"sample_id": f"{s}-{i}"})) for s in (0, 2) for i in range(5)], "shard int, ordinal int, record string").repartition(3)
    for _ in range(2):
        sinks.write_manifest_shards(records, '{"schema": "v"}', str(tmp_path / "m"), 3)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["manifest.shard-00000-of-00003.json", "manifest.shard-00002-of-00003.json"]
    doc = json.loads((tmp_path / "m" / "manifest.shard-00002-of-00003.json").read_text())
    assert doc == {"schema": "v", "records": [{"sample_id": f"2-{i}"} for i in range(5)], "record_count": 5}
    assert manifest.read_document(spark, str(tmp_path / "m"))[0].where("count_ok and schema = 'v'").count() == 2


def test_clock_and_window_errors(spark, rows):
    meta = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [0.0, 0.5]), ("c", [0.0, float("nan")])], "sample_id string, time_s array<double>")
    clock = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.25), ("b", 0, 0.0), ("c", 0, 0.0), ("c", 1, 0.5)], "sample_id string, frame int, t double")
    assert rows(audit.clock_error(meta, clock)) == [("a", 0.25), ("b", float("inf")), ("c", float("inf"))]
    cells = spark.createDataFrame([("a", 0, f, 0, 0, 1.0, 0.0, 0.0, 1.0) for f in (0, 1, 2, 5)], "sample_id string, slot int, frame int, cy int, cx int, r double, g double, b double, visible double")
    pooled = lambda r: spark.createDataFrame([("a", 0, 0, 0, 0, 1.0, 0.0, 0.0, 1.0), ("a", 0, 1, 0, 0, r, 0.0, 0.0, 0.5), ("a", 0, 2, 0, 0, 0.25, 0.0, 0.0, 0.25)], "sample_id string, slot int, latent int, cy int, cx int, r double, g double, b double, visible double")
    assert rows(audit.window_error(cells, pooled(0.5))) == [("a", 0.0)]
    assert rows(audit.window_error(cells, pooled(0.75))) == [("a", 0.25)]


def test_several_base_rows_of_a_scene_fail(spark):
    records = spark.createDataFrame([("s1", "x", "base"), ("s2", "x", "base"), ("s3", "y", "base"), ("s4", "y", "factor")], "sample_id string, base_scene_id string, mode string")
    fine = manifests.trajectory_inputs(records.where("base_scene_id = 'y'"), records, "nominal_base")
    assert {(r.sample_id, r.trajectory_id) for r in fine.collect()} == {("s3", "s3"), ("s4", "s3")}
    with pytest.raises(Exception, match="several base records of scene x"):
        manifests.trajectory_inputs(records, records, "nominal_base").collect()


def test_keys_inside_strings_are_no_keys(spark, rows):
    raw = [
        json.dumps({"text": '"seed": 1, {"seed": 2}', "ok": ["seed", {"deep": [{"seed" if i == 3 else "x": i} for i in range(5)]}]}), json.dumps({"a": "seed"}),
        '{"a\\\\": {"seed"\n :1}}', json.dumps({"é\\": "x" * 100_000 + '\\"', "seed": '\\\\"'}), '{"seed" 1}', "",
    ]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id int, raw string")
    assert sorted(map(str, rows(documents.forbidden_keys(docs, ["seed"])))) == ["(0, 'seed')", "(2, 'seed')", "(3, 'seed')", "(4, None)", "(5, None)"]
