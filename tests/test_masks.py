import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import masks


def frame(spark, grid, name="m"):
    ys, xs = np.nonzero(grid)
    return spark.createDataFrame([(name, int(y), int(x)) for y, x in zip(ys, xs)], "scene string, y int, x int")


def dense(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        assert not out[r.y, r.x], "pixel listed twice"
        out[r.y, r.x] = True
    return out


def shifted_any(grid, offsets):
    out = np.zeros_like(grid)
    h, w = grid.shape
    for y, x in zip(*np.nonzero(grid)):
        for dy, dx in offsets:
            if 0 <= y + dy < h and 0 <= x + dx < w:
                out[y + dy, x + dx] = True
    return out


@pytest.mark.parametrize("seed,share", [(0, 0.05), (1, 0.4), (2, 0.9)])
def test_dilate_and_erode_match_brute_force(spark, seed, share):
    grid = np.random.default_rng(seed).random((13, 17)) < share
    offsets = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]
    got = dense(masks.dilate(frame(spark, grid), ["scene"], masks.square_spans(2), 17, 13), grid.shape)
    assert (got == shifted_any(grid, offsets)).all()
    ring = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9]
    disc = dense(masks.dilate(frame(spark, grid), ["scene"], masks.disc_spans(3), 17, 13), grid.shape)
    assert (disc == shifted_any(grid, ring)).all()
    # Outside the image counts as set: erosion is the complement of dilating the complement.
    worn = dense(masks.erode(frame(spark, grid), ["scene"], 1, 17, 13), grid.shape)
    near = [(dy, dx) for dy in range(-1, 2) for dx in range(-1, 2)]
    assert (worn == ~shifted_any(~grid, near)).all()


def test_hole_expansion_is_five_pixels(spark):
    grid = np.zeros((80, 96), bool)
    grid[24:58, 40:72] = True
    content = frame(spark, np.ones_like(grid))
    got = dense(masks.expand_hole(frame(spark, grid), content, ["scene"], 96, 80), grid.shape)
    rows, cols = np.nonzero(got)
    assert (rows.min(), rows.max(), cols.min(), cols.max()) == (19, 62, 35, 76)
    assert got[24:58, 40:72].all() and not got[19, 35]


def brute_neighbours(depth, completed, reference, observed, radius):
    out = {}
    h, w = depth.shape
    for y, x in zip(*np.nonzero(completed)):
        best = np.inf
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                yy, xx = y + dy, x + dx
                if (dy or dx) and 0 <= yy < h and 0 <= xx < w and observed[yy, xx]:
                    best = min(best, abs(depth[y, x] - reference[yy, xx]) / max(reference[yy, xx], np.float32(1e-8)))
        if np.isfinite(best):
            out[int(y), int(x)] = best
    return out


@pytest.mark.parametrize("tile,radius", [(5, 3), (16, 8), (128, 2)])
def test_neighbour_min_matches_brute_force(spark, tile, radius):
    rng = np.random.default_rng(tile)
    shape = (19, 23)
    depth = rng.uniform(1, 3, shape).astype(np.float32)
    state = rng.integers(0, 12, shape)
    completed, observed = state < 4, state == 11
    data = [("s", y, x, float(depth[y, x]), bool(completed[y, x]), float(depth[y, x]), bool(observed[y, x])) for y in range(shape[0]) for x in range(shape[1])]
    df = spark.createDataFrame(data, "scene string, y int, x int, depth float, completed boolean, reference float, observed boolean")
    got = {(r.y, r.x): r.relative_error for r in masks.neighbour_min(df, ["scene"], radius, tile).collect()}
    want = brute_neighbours(depth, completed, depth, observed, radius)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-5) for k in want)


def scene(spark, confidence=None, depth=None, padding=0):
    """Object rows 34..67 and columns 50..81 at depth 2.5 in a 96 x 128 image."""
    d = np.full((96, 128), 4.0)
    o = np.zeros((96, 128), bool)
    o[34:68, 50:82] = True
    d[o] = 2.5
    if depth is not None:
        depth(d)
    c = np.ones((96, 128))
    if confidence is not None:
        confidence(c, o)
    data = [
        ("s", y, x, float(d[y, x]), float(c[y, x]), 0.0, 0.0, float(d[y, x]), bool(o[y, x]), y >= padding)
        for y in range(96) for x in range(128)
    ]
    return spark.createDataFrame(data, "scene string, y int, x int, depth double, confidence double, px double, py double, pz double, object boolean, content boolean").repartition(4), o


def test_split_never_leaks_the_object(spark):
    def hole(d):
        d[20, 20] = np.nan

    pixels, o = scene(spark, depth=hole, padding=4)
    flags, report = masks.split_scene(pixels, 128, 96, 0.25)
    r = report.first()
    assert r.problem is None
    env = dense(flags.filter("environment").select("y", "x"), o.shape)
    core = dense(flags.filter("object_core").select("y", "x"), o.shape)
    assert not (env & shifted_any(o, [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)])).any()
    assert not env[:4].any() and not env[20, 20]
    assert core.sum() == 30 * 28 and (core & ~o).sum() == 0


def test_separate_confidence_cuts(spark):
    def low_object(c, o):
        c[o] = 0.01

    pixels, _ = scene(spark, confidence=low_object)
    r = masks.split_scene(pixels, 128, 96, 0.25)[1].first()
    assert r.confidence_threshold == 1.0 and r.object_confidence_threshold == pytest.approx(0.01)
    assert r.object_points == 30 * 28


def test_prepare_and_merge_keep_known_depth(spark):
    pixels, o = scene(spark, padding=4)
    ready = pixels.withColumn("requested", F.col("object"))
    cropped, report = masks.prepare_hole(ready)
    r = report.first()
    assert (r.y0, r.y1, r.x0, r.x1, r.hole_pixels, r.problem) == (4, 96, 0, 128, int(o.sum()), None)
    assert cropped.filter("hole and known_depth <> 0").count() == 0
    notch = ready.withColumn("content", F.col("content") & ~((F.col("y") == 50) & (F.col("x") == 3)))
    assert masks.prepare_hole(notch)[1].first().problem == "content is not one rectangle"
    predicted = ready.select("scene", "y", "x", F.when(F.col("y") == 40, F.lit(-1.0)).otherwise(F.lit(9.0)).alias("predicted"), F.col("object").alias("hole"))
    fused = masks.merge_known(pixels, predicted)
    assert fused.filter("filled and (not object or depth <> 9)").count() == 0
    assert fused.filter("not filled and depth not in (4.0, 2.5)").count() == 0
    assert fused.filter("filled").count() == int(o.sum()) - 32


def test_completion_never_replaces_observed(spark):
    pixels, o = scene(spark)
    ready = pixels.select(
        "scene", "y", "x", "object", "content", (~F.col("object")).alias("observed"), F.lit(True).alias("reliable"), F.lit(True).alias("hole"),
        F.lit(4.0).alias("predicted"),
    )
    camera = spark.range(1).select(
        F.lit("s").alias("scene"), F.expr("array(array(110D,0D,63.5D), array(0D,110D,47.5D), array(0D,0D,1D))").alias("k"),
        F.expr("array(array(1D,0D,0D,0D), array(0D,1D,0D,0D), array(0D,0D,1D,0D), array(0D,0D,0D,1D))").alias("extrinsic"),
    )
    out = masks.complete_environment(ready, camera).cache()
    assert out.filter("completed and observed").count() == 0
    assert out.filter("completed").count() == int(o.sum()) and out.filter("not dense").count() == 0
    p = out.filter("completed and y = 40 and x = 60").first()
    assert (p.wx, p.wy, p.wz) == pytest.approx((4 * (60 - 63.5) / 110, 4 * (40 - 47.5) / 110, 4.0), rel=1e-6)
    rules = masks.mask_algebra(out.withColumnRenamed("completed_depth", "depth").withColumn("raw_depth", F.col("predicted"))).first().asDict()
    assert {k: v for k, v in rules.items() if k != "scene" and v} == {}


def test_seam_ignores_a_nearer_foreground(spark):
    pixels, o = scene(spark, depth=lambda d: d.__setitem__((slice(None), slice(0, 10)), 1.0))
    seam = pixels.select("scene", "y", "x", F.lit(4.0).alias("depth"), F.col("object").alias("completed"), F.col("depth").alias("reference"), (~F.col("object")).alias("observed"))
    row = masks.seam_report(masks.neighbour_min(seam, ["scene"], 8, 32), ["scene"]).first()
    assert row.p90_relative_error < 0.01 and row.enough


def test_iou_and_boxes(spark):
    a = frame(spark, np.eye(6, dtype=bool))
    b = frame(spark, np.tri(6, dtype=bool))
    r = masks.mask_iou(a, b, ["scene"]).first()
    assert (r.intersection, r.union, r.iou) == (6, 21, 6 / 21)
    box = masks.padded_box(masks.mask_bounds(a, ["scene"]), 20, 9).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (0, 0, 14, 9)


def test_foreground_follows_a_moving_square(spark):
    rows = []
    for f in range(5):
        for y in range(24):
            for x in range(30):
                v = 200 if 8 <= y < 16 and 4 * f <= x < 4 * f + 8 else 10
                rows.append(("v", f, y, x, v, v, v))
    pixels = spark.createDataFrame(rows, "video string, frame int, y int, x int, r short, g short, b short")
    back = spark.createDataFrame([("v", y, x, 10, 10, 10) for y in range(24) for x in range(30)], "video string, y int, x int, r short, g short, b short")
    mask = masks.foreground_mask(pixels, back)
    clean = masks.opened_closed(mask, ["video", "frame"], 30, 24)
    box = clean.filter("frame = 2").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(box) == (7, 16, 7, 16)
    full = np.pad(np.where((np.indices((24, 30))[0] >= 8) & (np.indices((24, 30))[0] < 16) & (np.indices((24, 30))[1] < 8), 190.0, 0.0), 2, mode="reflect")
    taps = np.array([1, 4, 6, 4, 1]) / 16
    smooth = sum(taps[i] * full[:, i : i + 30] for i in range(5))
    smooth = sum(taps[i] * smooth[i : i + 24] for i in range(5))
    got = {(r.y, r.x) for r in mask.filter("frame = 0").collect()}
    assert got == {(int(y), int(x)) for y, x in zip(*np.nonzero(np.rint(smooth) > 18))}


def test_foreground_rounds_greys_exactly(spark):
    places = [(y, x) for y in range(3) for x in range(3)]
    # 0.587 * 170 + 0.114 * 15 is 101.5 and rounds to 102; summed in doubles it falls below the half.
    pixels = spark.createDataFrame([("v", 0, y, x, 0, 170, 15) for y, x in places], "video string, frame int, y int, x int, r int, g int, b int")
    back = spark.createDataFrame([("v", y, x, 93, 93, 93) for y, x in places], "video string, y int, x int, r int, g int, b int")
    assert masks.foreground_mask(pixels, back, 8.0).count() == 9


def test_hidden_object_has_no_cell_outside_its_mask(spark):
    points = spark.createDataFrame([("s", 0, 4.0, 4.0, True)], "sample_id string, frame int, u double, v double, valid boolean")
    mask = spark.createDataFrame([("s", 0, 4, 4)], "sample_id string, frame int, x int, y int")
    cells = spark.createDataFrame([], "sample_id string, frame int, cx int, cy int, visible double")
    r = masks.mask_consistency(points, cells, mask, (8, 8), (32, 32), (8, 8)).first()
    assert (r.containment_min, r.cell_precision_min, r.centroid_error_max_px) == (1.0, 1.0, 0.0)
