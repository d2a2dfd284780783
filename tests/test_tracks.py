import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.samples import npz_bytes, safetensors, track_payload
from trackloom.functions import geometry as G
from trackloom.operators import audit, raster
from trackloom.sources import archives


def tables(spark, payloads):
    files = spark.createDataFrame([(name, bytearray(npz_bytes(p))) for name, p in payloads.items()], "sample_id string, content binary")
    return (
        archives.read_track_points(files), archives.read_track_cameras(files), archives.read_track_meta(files), archives.read_initial_points(files)
    )


def edit(**changes):
    out = track_payload()
    out.update(changes)
    return out


def described(**changes):
    p = track_payload()
    meta = json.loads(str(p["metadata_json"]))
    meta.update(changes)
    p["metadata_json"] = np.array(json.dumps(meta))
    return p


def test_each_corruption_is_reported(spark, rows):
    p = track_payload()

    def shifted(name, index, value):
        a = p[name].copy()
        a[index] = value
        return edit(**{name: a})

    payloads = {
        "valid": p,
        "undeclared": edit(metadata_json=np.array("{}")),
        "world": shifted("points_world_m", (1, 0, 5, 0), 0.5),
        "depth": shifted("depth_m", (0, 0, 0), 2.0),
        "track": shifted("tracks_xy_px", (1, 0, 9, 0), 5.0),
        "flag": shifted("valid", (1, 0, 3), 0),
        "start": shifted("initial_points_camera_m", (0, 7, 2), 3.0),
        "time": edit(time_s=np.array([0.0, 0.0])),
        "handed": edit(camera_from_world=np.eye(4)),
        "skewed": edit(camera_from_world=np.diag([1.0, -2.0, 1.0, 1.0])),
        "focal": edit(camera_intrinsics=np.array([[-1.0, 0, 4], [0, 1, 4], [0, 0, 1]])),
        "count": described(point_count=7),
        "clip": described(clip_start_m=5.0, clip_end_m=2.0),
        "size": edit(image_size_px=np.array([8.5, 8])),
    }
    found = {}
    for sample, rule in rows(raster.validate_tracks(*tables(spark, payloads)), "sample_id", "rule_id"):
        found.setdefault(sample, []).append(rule)
    assert "valid" not in found and "undeclared" not in found
    assert found["world"] == ["T16"]
    assert found["depth"] == ["T04"]
    assert found["track"] == ["T17"]
    assert found["flag"] == ["T19"]
    assert found["start"] == ["T09"]
    assert found["time"] == ["T08"]
    assert found["handed"] == ["T15"]
    assert "T11" in found["skewed"] and "T12" in found["focal"]
    assert found["count"] == ["T14"]
    assert "T18" in found["clip"]
    assert found["size"] == ["T13"]


@pytest.mark.parametrize("u,source,target,want", [(0.0, (4, 4), (8, 8), 0.5), (3.0, (4, 4), (8, 8), 6.5)])
def test_half_pixel_resize(spark, u, source, target, want):
    x, y = G.cover_crop(F.lit(u), F.lit(u), (F.lit(source[0]), F.lit(source[1])), target)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (row.x, row.y) == (want, want)


def test_projection_round_trip(spark):
    k = F.expr("array(array(50D, 1D, 20D), array(0D, 40D, 10D), array(0D, 0D, 1D))")
    rng = np.random.default_rng(0)
    pts = [(float(a), float(b), float(c)) for a, b, c in rng.uniform(0.5, 3, (20, 3))]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    u, v, _ = G.project(k, (F.col("x"), F.col("y"), F.col("z")))
    back = G.unproject(u, v, F.col("z"), k)
    worst = df.select(F.max(G.norm(*[b.cast("double") - F.col(n) for b, n in zip(back, "xyz")])).alias("e")).first().e
    assert worst < 1e-6


def small(points):
    """points: (frame, slot, id, u, v, depth)."""
    return [("s", f, s, i, 0.0, 0.0, d, float(u), float(v), float(d), True) for f, s, i, u, v, d in points]


POINTS = "sample_id string, frame int, slot int, point_id int, cx double, cy double, cz double, u double, v double, depth double, valid boolean"


def render(spark, points, initial, static=None, method="arrow", radius=0, grid=(8, 8), size=(8, 8)):
    pts = spark.createDataFrame(small(points), POINTS)
    init = spark.createDataFrame([("s", s, i, float(x), float(y), float(z)) for s, i, x, y, z in initial], "sample_id string, slot int, point_id int, ix double, iy double, iz double")
    meta = spark.createDataFrame([("s", 2, 8, 8)], "sample_id string, frames int, width int, height int")
    st = None
    if static is not None:
        st = spark.createDataFrame([("s", f, i, float(u), float(v), float(d), True) for f, i, u, v, d in static], "sample_id string, frame int, point_id int, u double, v double, depth double, valid boolean")
    return raster.identity_tracks(pts, init, meta, grid, size, st, radius, method=method)


INITIAL = [(0, 0, 0, 0, 1), (1, 0, 1, 1, 2)]


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_nearest_object_wins(spark, rows, method):
    points = [(0, 0, 0, 3, 3, 2.0), (0, 1, 0, 3, 3, 1.0)]
    assert rows(render(spark, points, INITIAL, method=method), "slot", "cy", "cx") == [(1, 3, 3)]


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_static_point_occludes_and_wins_ties(spark, rows, method):
    points = [(0, 0, 0, 3, 3, 2.0), (0, 1, 0, 5, 5, 2.0)]
    static = [(0, 0, 3, 3, 2.0), (0, 1, 5, 5, 2.5)]
    assert rows(render(spark, points, INITIAL, static, method), "slot", "cy", "cx") == [(1, 5, 5)]


def test_visibility_is_resolved_before_reduction(spark, rows):
    points = [(0, 0, 0, 2, 2, 2.0), (0, 1, 0, 3, 3, 1.0)]
    assert rows(render(spark, points, INITIAL, grid=(4, 4)), "slot", "cy", "cx") == [(0, 1, 1), (1, 1, 1)]


def test_point_entering_later_keeps_its_colour(spark):
    points = [(1, 0, 0, 3, 3, 2.0)]
    row = render(spark, points, [(0, 0, -9, 0, 1), (0, 1, 1, 1, 2)]).first()
    assert (row.frame, row.r, row.visible) == (1, 0.0, 1.0)


def test_random_scenes_agree_on_both_paths(spark, rows):
    rng = np.random.default_rng(5)
    points = [(int(f), int(s), i, *rng.uniform(0, 8, 2), float(rng.integers(1, 4))) for i in range(60) for f in (0, 1) for s in (0, 1)]
    initial = [(s, i, *rng.uniform(-1, 1, 2), float(rng.uniform(1, 3))) for i in range(60) for s in (0, 1)]
    static = [(int(f), i, *rng.uniform(0, 8, 2), float(rng.integers(1, 4))) for i in range(20) for f in (0, 1)]
    cols = ["slot", "frame", "cy", "cx", *[F.round(c, 5) for c in "rgb"]]
    a = rows(render(spark, points, initial, static, "arrow", 1, (4, 4)), *cols)
    b = rows(render(spark, points, initial, static, "sql", 1, (4, 4)), *cols)
    assert a == b and len(a) > 20


def test_static_projection_follows_the_camera(spark):
    eye = np.eye(4).tolist()
    moved = [[1.0, 0.0, 0.0, 0.5], *eye[1:]]
    k = [[10.0, 0.0, 4.0], [0.0, 10.0, 4.0], [0.0, 0.0, 1.0]]
    cams = spark.createDataFrame([("s", 0, eye, k), ("s", 1, moved, k)], "sample_id string, frame int, m array<array<double>>, k array<array<double>>")
    meta = spark.createDataFrame([("s", 2, '{"clip_end_m": 3.0}')], "sample_id string, frames int, j string").withColumn("metadata", F.parse_json("j"))
    static = spark.createDataFrame([("s", 0, 0.0, 0.0, 2.0), ("s", 1, 0.0, 0.0, 5.0)], "sample_id string, point_id int, x double, y double, z double")
    got = {(r.frame, r.point_id): r for r in raster.project_static(static, cams, meta).collect()}
    assert (got[0, 0].u, got[1, 0].u) == (4.0, 6.5) and got[0, 0].valid and not got[0, 1].valid


def test_dense_channels(spark):
    points = [(0, 0, 0, 1, 1, 2.0), (1, 0, 0, 3, 1, 2.0)]
    pts = spark.createDataFrame(small(points), POINTS)
    meta = spark.createDataFrame([("s", 2, 8, 8)], "sample_id string, frames int, width int, height int")
    got = {(r.frame, r.cy, r.cx): r for r in raster.dense_tracks(pts, meta, (8, 8), (8, 8)).collect()}
    assert set(got) == {(0, 1, 1), (1, 1, 1), (1, 1, 3)}
    assert (got[1, 1, 1].source, got[1, 1, 1].current, got[1, 1, 1].dx) == (1.0, 0.0, 0.25)
    assert (got[1, 1, 3].source, got[1, 1, 3].current, got[1, 1, 3].valid) == (0.0, 1.0, 1.0)


CELLS = "sample_id string, slot int, frame int, cy int, cx int, r float, g float, b float, visible float"


def test_cell_rules(spark, rows):
    cells = spark.createDataFrame(
        [("ok", 0, 0, 0, 0, 0.5, 0.5, 0.5, 1.0), ("half", 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.5), ("back", 0, 0, 0, 0, 0.2, 0.0, 0.0, 0.0),
         ("slot", 1, 0, 0, 0, 0.5, 0.5, 0.5, 1.0), ("range", 0, 0, 0, 0, 1.5, 0.0, 0.0, 1.0), ("nan", 0, 0, 0, 0, float("nan"), 0.0, 0.0, 1.0)], CELLS)
    counts = cells.select("sample_id").distinct().withColumn("object_count", F.lit(1))
    got = rows(raster.validate_track_cells(cells, counts), "sample_id", "rule_id")
    assert got == [("back", "C04"), ("half", "C03"), ("nan", "C01"), ("nan", "C02"), ("range", "C02"), ("slot", "C05")]


def test_envelope_and_empty_slot(spark, rows):
    cells = spark.createDataFrame([("s", 0, 0, 1, 1, 1.0, 1.0, 1.0, 1.0), ("s", 0, 3, 2, 2, 1.0, 1.0, 1.0, 1.0)], CELLS)
    meta = spark.createDataFrame([("s", 5)], "sample_id string, frames int")
    assert rows(raster.motion_envelope(cells, meta), "frame", "cy", "cx") == [(0, 1, 1), (1, 1, 1), (1, 2, 2)]
    slots = spark.createDataFrame([("s", i, 5, 12) for i in range(2)], "sample_id string, slot int, frames int, cells_total int")
    got = {r.slot: r for r in raster.object_cells(cells, slots).collect()}
    assert not got[1].slot_active and got[1].target_iou_mean == 1.0 and got[1].target_flip_rate_mean == 0.0
    assert got[0].active_cells_mean == pytest.approx(0.4) and got[0].active_cells_min == 0 and got[0].active_cells_max == 1
    # Frames 1..4: one cell vanishes, none, one appears, one vanishes.
    assert got[0].target_iou_mean == pytest.approx(0.25) and got[0].target_flip_rate_max == pytest.approx(1 / 12)


def test_rigid_drift_and_quaternion(spark):
    half = np.pi / 4
    poses = spark.createDataFrame([("s", 0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("s", 0, 1, 2.0, 0.0, 0.0, float(np.cos(half)), 0.0, 0.0, float(np.sin(half)))],
                                  "sample_id string, slot int, frame int, px double, py double, pz double, qw double, qx double, qy double, qz double")
    pts = spark.createDataFrame([("s", 0, 0, 0, 1.0, 0.0, 0.0), ("s", 1, 0, 0, 2.0, 1.0, 0.0)], "sample_id string, frame int, slot int, point_id int, wx double, wy double, wz double")
    row = audit.rigid_drift(pts, poses).first()
    assert row.rigid_drift < 1e-12 and row.quaternion_norm_error < 1e-12


def test_track_cell_files(spark, rows):
    tensor = np.zeros((12, 2, 3, 4), np.float32)
    tensor[4:8, 1, 2, 3] = (0.1, 0.2, 0.3, 1.0)
    good = safetensors({"point_track_map": tensor})
    extra = safetensors({"point_track_map": tensor, "mask": tensor})
    files = spark.createDataFrame([("good", bytearray(good)), ("extra", bytearray(extra))], "sample_id string, content binary")
    cells, info = archives.read_track_cells(files)
    assert rows(info, "sample_id", "ok") == [("extra", False), ("good", True)]
    assert rows(cells.filter("sample_id = 'good'"), "slot", "frame", "cy", "cx", "visible") == [(1, 1, 2, 3, 1.0)]
