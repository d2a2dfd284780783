import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from tests.samples import png, safetensors, save_npz, track_payload
from trackloom import contracts as C
from trackloom.operators import packages
from trackloom.sources import archives, images, manifest, sinks


def test_manifest_keeps_file_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    for part in range(3):
        lines = [json.dumps({"n": part * 100 + i}) if i % 10 else "" for i in range(50)]
        (folder / f"part-{part}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        m = manifest.read_manifest(spark, str(folder))
        got = [r.n for r in m.orderBy("ordinal").select(F.try_variant_get("rec", "$.n", "int").alias("n")).collect()]
        last = m.agg(F.max("ordinal")).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [p * 100 + i for p in range(3) for i in range(50) if i % 10]
    assert last == 149


def test_documents_count_their_records(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schema": "x", "record_count": 3, "records": [{"sample_id": "a"}, {"sample_id": "b"}]}, indent=1))
    header, records = manifest.read_document(spark, str(tmp_path / "d.json"))
    h = header.first()
    assert (h.record_count, h.records_found) == (3, 2)
    assert [(r.ordinal, r.sample_id) for r in records.orderBy("ordinal").collect()] == [(0, "a"), (1, "b")]


def test_artifacts(spark, tmp_path, rows):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"")
    full = ("sub/a.bin", 5, hashlib.sha256(b"hello").hexdigest())
    assert rows(manifest.scan_artifacts(spark, str(tmp_path)), "path", "bytes", "sha256") == [full]
    wanted = spark.createDataFrame([("b.bin",), ("sub/a.bin",), ("gone",), ("../x",), ("sub",)], "path string")
    assert rows(manifest.stat_artifacts(wanted, str(tmp_path), block=2)) == [("b.bin", 0, hashlib.sha256(b"").hexdigest()), full]
    cheap = manifest.scan_artifacts(spark, str(tmp_path), with_hash=False)
    assert "content" not in cheap._jdf.queryExecution().executedPlan().toString()


def test_reports(spark, tmp_path, rows):
    for name, sample in (("b/r1", "s2"), ("a/r2", "s1"), ("a/r3", "s2")):
        p = tmp_path / f"{name}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps({"sample_id": sample}))
    (tmp_path / "a" / "r2.mp4").write_bytes(b"x")
    reports = manifest.read_reports(spark, str(tmp_path))
    assert rows(reports.filter("has_video"), "sample_id") == [("s1",)]
    assert [r.sample_id for r in manifest.first_seen_ids(reports).collect()] == ["s1", "s2"]


def test_npz_archives(spark, tmp_path, rows):
    save_npz(tmp_path / "t" / "s0.npz", track_payload(frames=3, slots=2))
    files = archives.binary_files(spark, str(tmp_path / "t"))
    assert archives.read_track_points(files).count() == 3 * 2 * 2048
    meta = archives.read_track_meta(files).first()
    assert (meta.sample_id, meta.frames, meta.object_ids, meta.width) == ("s0", 3, ["o0", "o1"], 8.0)
    save_npz(
        tmp_path / "r" / "s0.npz",
        {"time_s": np.arange(4.0), "box__position_m": np.ones((4, 3)), "box__quaternion_wxyz": np.tile([1.0, 0, 0, 0], (4, 1)),
         "box__collider_contact_count__floor": np.array([0, 1, 0, 0]), "box__collider_contact_count__wall": np.zeros(4)},
    )
    raw = archives.binary_files(spark, str(tmp_path / "r"))
    assert rows(archives.read_contacts(raw)) == [("s0", "box", "floor")]
    assert archives.read_poses(raw).filter("qw = 1 and px = 1").count() == 4


def test_scene_points(spark, tmp_path, rows):
    n = np.tile([0.0, 0.0, 1.0], (4, 1)).astype(np.float32)
    save_npz(
        tmp_path / "sc.npz",
        {"object_xyz_camera_m": np.zeros((4, 3), np.float32), "object_normal_camera": n, "environment_xyz_camera_m": np.ones((4, 3), np.float32),
         "environment_normal_camera": n, "environment_friction": np.full((4, 1), 0.5, np.float32), "environment_restitution": np.full((4, 1), 0.25, np.float32),
         "camera_intrinsics_normalized": np.array([1, 1, 0.5, 0.5], np.float32)},
    )
    points, cameras = archives.read_scene_points(archives.binary_files(spark, str(tmp_path)))
    assert rows(points.groupBy("body", "slot").agg(F.count(F.lit(1)), F.max("friction"))) == [(0, -1, 4, 0.5), (1, 0, 4, None)]
    assert cameras.first().intrinsics == [1, 1, 0.5, 0.5]


def test_masks(spark, tmp_path, rows):
    grey = np.zeros((3, 4), np.uint8)
    grey[1, 2] = 255
    rgba = np.zeros((3, 4, 4), np.uint8)
    rgba[..., :3] = 200
    rgba[2, 0, 3] = 9
    for name, a in (("grey", grey), ("rgba", rgba), ("rgb", rgba[..., :3]), ("flat", np.full((3, 4), 7, np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    pixels, status = images.read_masks(spark, str(tmp_path))
    short = F.regexp_extract("source", r"([a-z]+)\.png$", 1).alias("n")
    assert rows(status.select(short, "problem")) == [("flat", "constant mask"), ("grey", None), ("rgb", "colour image without alpha"), ("rgba", None)]
    assert rows(pixels.select(short, "y", "x").filter("n in ('grey', 'rgba')")) == [("grey", 1, 2), ("rgba", 2, 0)]


def test_frames(spark, tmp_path, rows):
    a = np.zeros((2, 2, 3), np.uint8)
    a[0, 1] = (10, 20, 30)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "frame_0003.png").write_bytes(png(a))
    got = rows(images.read_frames(spark, str(tmp_path)).filter("r > 0"))
    assert got == [("v", 2, 0, 1, 10, 20, 30)]


def test_sinks_round_trip(spark, tmp_path, rows):
    records = spark.createDataFrame([(f"s{i}", i, i % 2) for i in range(6)], "sample_id string, ordinal int, shard int")
    header = spark.createDataFrame([("v4", 6)], "schema string, record_count int")
    sinks.write_cache_manifest(records, header, str(tmp_path / "c"), 2)
    h, r = sinks.read_cache_manifest(spark, str(tmp_path / "c"))
    assert h.first().record_count == 6 and r.count() == 6
    assert sorted(p.name for p in (tmp_path / "c" / "records").iterdir() if p.is_dir()) == ["shard_file=manifest.shard-00000-of-00002", "shard_file=manifest.shard-00001-of-00002"]
    cells = spark.createDataFrame([("a", 0, f, 1, 1, 0.5) for f in (2, 0, 1)], "sample_id string, slot int, frame int, cy int, cx int, r double")
    sinks.write_track_cells(cells, str(tmp_path / "cells"), 4)
    assert [x.frame for x in spark.read.parquet(str(tmp_path / "cells")).collect()] == [0, 1, 2]
    cloud = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "scene string, source int, x double")
    sinks.write_cloud(cloud, str(tmp_path / "cloud"))
    assert rows(spark.read.parquet(str(tmp_path / "cloud")), "scene", "source", "x") == [("a", 0, 1.0), ("b", 1, 2.0)]
    sinks.write_report(header, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    assert sinks.shard_name(1, 4) == "manifest.shard-00001-of-00004.json"


def scene_arrays(height=6, width=8):
    """A consistent scene archive: left half observed, one completed column."""
    a = {n: np.zeros((height, width), bool) for n in C.SCENE_MAP_ARRAYS}
    a["content_mask"][:] = True
    a["environment_mask"][:, :4] = True
    a["environment_completion_mask"][:, 4] = True
    a["environment_depthlab_mask"][:, 4:] = True
    a["environment_dense_mask"] = a["environment_mask"] | a["environment_completion_mask"]
    a["environment_completion_depth"] = np.where(a["environment_completion_mask"], 2.0, 0.0)
    a["environment_depthlab_raw_depth"] = np.where(a["environment_depthlab_mask"], 2.0, 0.0)
    a.update(
        xyz=np.zeros((5, 3)), rgb=np.zeros((5, 3), np.uint8), source=np.array([0, 0, 1, 2, 2]), body_id=np.array([0, 0, 0, 1, 1]), intrinsic=np.eye(3),
        extrinsic=np.eye(4)[:3], point_map_world=np.zeros((height, width, 3)), depth=np.ones((height, width)), confidence=np.ones((height, width)),
        object_transform_world=np.eye(4), object_transform_camera=np.eye(4), collision_proxy_vertices=np.zeros((3, 3)), collision_proxy_faces=np.array([[0, 1, 2]]),
        support_plane_valid=np.array(True), support_plane_index=np.array(0), support_plane_equation_world=np.array([0, 0, 1.0, 0]),
        support_plane_distance_threshold=np.array(0.1), source_labels=np.array(["a"]), body_labels=np.array(["b"]),
    )
    return a


def test_scene_packages_from_files(spark, tmp_path, rows):
    bad = scene_arrays()
    bad["environment_dense_mask"] = np.zeros_like(bad["environment_dense_mask"])
    bad["collision_proxy_faces"] = np.array([[0, 1, 9]])
    for name, arrays in (("01_good", scene_arrays()), ("02_bad", bad), ("03_empty", None)):
        folder = tmp_path / name
        folder.mkdir()
        if arrays is None:
            continue
        save_npz(folder / "scene.npz", arrays)
        (folder / C.COLLISION_PROXY).write_text("o")
        (folder / "physics.json").write_text(json.dumps({"collision_proxy": C.COLLISION_PROXY}))
        (folder / "report.json").write_text(json.dumps({"quality_gate": {"passed": True}}))
        data = (folder / "scene.npz").read_bytes()
        entry = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        (folder / "scene_manifest.json").write_text(json.dumps({"schema": "acme.structured_scene_package.v1", "artifacts": {"scene.npz": entry}}))
    root = str(tmp_path)
    bundles, cloud, pixels = archives.read_scene_packages(spark, root)
    named = pixels.withColumnsRenamed(
        {"environment_mask": "observed", "environment_completion_mask": "completed", "environment_dense_mask": "dense", "environment_depthlab_mask": "hole",
         "content_mask": "content", "reliable_environment_mask": "reliable"}
    ).drop("depth").withColumnsRenamed({"environment_completion_depth": "depth", "environment_depthlab_raw_depth": "raw_depth"})
    scenes = spark.createDataFrame([("01_good",), ("02_bad",), ("03_empty",)], "scene string")
    names = [(f"{s}/{f}",) for s in ("01_good", "02_bad", "03_empty") for f in ("scene.npz", "report.json", "physics.json", C.COLLISION_PROXY)]
    files = manifest.stat_artifacts(spark.createDataFrame(names, "path string"), root)
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    documents = texts.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("path"), F.try_parse_json("value").alias("doc")
    )
    errors, verdict = packages.audit_packages(scenes, bundles, files, documents, archives.read_scene_headers(spark, root), cloud, named)
    assert rows(errors) == [
        ("02_bad", "mask.dense_is_not_union"),
        ("02_bad", "range: collision_proxy_faces"),
        ("03_empty", "manifest.absent"),
    ]
    assert rows(verdict, "scene", "passed") == [("01_good", True), ("02_bad", False), ("03_empty", False)]
    assert cloud.filter("scene = '01_good'").count() == 5


def test_tensor_stats_and_dense_cells(spark, rows):
    dense = np.zeros((18, 2, 3, 4), np.float32)
    dense[6:12, 1, 0, 2] = (1, 1, 0.5, -0.5, 0.25, 1)
    latent = safetensors({"latent": np.array([[1.0, np.inf]], np.float32)})
    half = b"".join(x.tobytes() for x in (np.array([0x3F80, 0x4000], "<u2"),))
    text = json.dumps({"latent": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    bf16 = len(text).to_bytes(8, "little") + text + half
    files = spark.createDataFrame([("a", bytearray(latent)), ("b", bytearray(bf16)), ("c", bytearray(safetensors({"x": dense})))], "sample_id string, content binary")
    stats = {r.sample_id: (r.shape, r.dtype, r.finite) for r in archives.read_tensor_stats(files, "latent").collect()}
    assert stats == {"a": ([1, 2], "float32", False), "b": ([2], "bfloat16", True), "c": (None, None, False)}
    maps = spark.createDataFrame([("d", bytearray(safetensors({"point_track_map": dense})))], "sample_id string, content binary")
    assert rows(archives.read_dense_cells(maps), "slot", "frame", "cy", "cx", "dx", "dy") == [(1, 1, 0, 2, 0.5, -0.5)]
