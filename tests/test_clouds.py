import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import clouds

P = "vid int, x double, y double, z double"


def cloud(spark, pts, name="vid"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], P.replace("vid", name))


@pytest.mark.parametrize("kind", ["uniform", "hot", "copies", "line", "far"])
def test_nearest_matches_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    pts = rng.uniform(-1, 1, (300, 3))
    if kind == "hot":  # most points inside one tiny cell
        pts[:220] = rng.normal(0, 1e-5, (220, 3))
    elif kind == "copies":
        pts[50:200] = pts[7]
    elif kind == "line":
        pts[:, 1:] = 0
    queries = rng.uniform(-1, 1, (80, 3)) + (40 if kind == "far" else 0)
    queries[:20] = pts[:20]
    got = {r.qid: (r.cid, r.distance) for r in clouds.nearest(cloud(spark, queries, "qid"), cloud(spark, pts, "cid"), "qid", "cid").collect()}
    assert len(got) == len(queries)
    for i, q in enumerate(queries):
        d = np.sqrt(((pts - q) ** 2).sum(axis=1))
        assert got[i][1] == pytest.approx(d.min(), abs=1e-12)
        assert d[got[i][0]] == pytest.approx(d.min(), abs=1e-12)
        if kind == "copies" and d.min() == d[7]:
            assert got[i][0] == 7


def label(grid):
    """Flood fill with the smallest (row, column) code per 8-connected blob."""
    out = {}
    for y, x in sorted(zip(*map(lambda a: a.tolist(), np.nonzero(grid)))):
        if (y, x) in out:
            continue
        stack, code = [(y, x)], (y << 32) | x
        out[y, x] = code
        while stack:
            a, b = stack.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    n = (a + i, b + j)
                    if n not in out and 0 <= n[0] < grid.shape[0] and 0 <= n[1] < grid.shape[1] and grid[n]:
                        out[n] = code
                        stack.append(n)
    return out


@pytest.mark.parametrize("kind", ["noise", "spiral", "full"])
def test_components_match_flood_fill(spark, kind):
    grid = np.random.default_rng(4).random((30, 34)) < 0.42
    if kind == "full":
        grid[:] = True
    if kind == "spiral":
        grid[:] = False
        y, x, dy, dx, steps = 0, 0, 0, 1, 33
        grid[0, 0] = True
        for length in [33, 29, 33, 27, 31, 25, 29, 23, 27, 21]:
            for _ in range(length):
                if 0 <= y + dy < 30 and 0 <= x + dx < 34:
                    y, x = y + dy, x + dx
                    grid[y, x] = True
            dy, dx = dx, -dy
    ys, xs = np.nonzero(grid)
    df = spark.createDataFrame([("m", int(a), int(b)) for a, b in zip(ys, xs)], "scene string, y int, x int")
    got = {(r.y, r.x): r.label for r in clouds.components(df, ["scene"], tile=7).collect()}
    assert got == label(grid)


def test_planes_are_recovered(spark):
    rng = np.random.default_rng(2)
    floor = np.c_[rng.uniform(-1, 1, (300, 2)), rng.normal(0, 1e-4, 300)]
    wall = np.c_[rng.normal(1, 1e-4, 200), rng.uniform(-1, 1, (200, 2))]
    noise = rng.uniform(-1, 1, (60, 3))
    pts = np.vstack([floor, wall, noise])
    df = cloud(spark, pts).withColumn("scene", F.lit("a")).unionByName(cloud(spark, pts[:100]).withColumn("scene", F.lit("few")))
    found = clouds.fit_planes(df, "scene", "vid", planes=3, seed=1).orderBy("plane").collect()
    assert [r.scene for r in found] == ["a", "a"]
    assert abs(found[0].c) == pytest.approx(1, abs=1e-2) and found[0].inliers >= 290
    assert abs(found[1].a) == pytest.approx(1, abs=1e-2) and found[1].inliers >= 190


def cube(low):
    axis = np.linspace(0, 1, 9)
    x, y, z = (g.ravel() for g in np.meshgrid(axis, axis, axis))
    return np.c_[x, y, z + low]


def planes(spark):
    return spark.createDataFrame([("a", 0, 0.0, 0.0, -2.0, 0.0)], "scene string, plane int, a double, b double, c double, d double")


def test_lifted_cube_is_clear_and_stays(spark):
    pts = cloud(spark, cube(0.45)).withColumn("scene", F.lit("a"))
    r = clouds.support_relation(pts, planes(spark), ["scene"])
    row = r.first()
    assert (row.status, row.resolved) == ("observed_clear", True) and row.lower == pytest.approx(0.45)
    shifted, report = clouds.shift_to_support(pts, r, ["scene"])
    rep = report.first()
    assert (rep.status, rep.safe, rep.translation) == ("unmodified_clear", True, 0.0)


def test_cut_cube_is_unresolved(spark):
    pts = cloud(spark, cube(-0.5)).withColumn("scene", F.lit("a"))
    assert clouds.support_relation(pts, planes(spark), ["scene"]).first().status == "support_plane_intersects_object_bulk"


def test_sunk_cube_moves_rigidly(spark):
    pts = cloud(spark, cube(-0.05)).withColumn("scene", F.lit("a"))
    r = clouds.support_relation(pts, planes(spark), ["scene"])
    assert r.first().status == "observed_depth_boundary_uncertain"
    shifted, report = clouds.shift_to_support(pts, r, ["scene"])
    rep = report.first()
    assert rep.safe and rep.status == "support_translated"
    assert rep.translation == pytest.approx(0.05 + np.sqrt(3) * 0.004, rel=1e-6)
    span = shifted.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    assert tuple(span) == pytest.approx((1.0, 1.0, 1.0))


def test_no_plane(spark):
    pts = cloud(spark, cube(0.0)).withColumn("scene", F.lit("other"))
    r = clouds.support_relation(pts, planes(spark), ["scene"])
    assert (r.first().status, r.first().resolved) == ("no_environment_plane", False)
    rep = clouds.shift_to_support(pts, r, ["scene"])[1].first()
    assert (rep.status, rep.safe) == ("unmodified_no_support_plane", False)


def test_local_band(spark):
    rows = [("s", y, x, 30 <= x < 34 and 30 <= y < 34, True) for y in range(64) for x in range(64)]
    px = spark.createDataFrame(rows, "scene string, y int, x int, object boolean, reliable boolean")
    band = {(r.y, r.x) for r in clouds.local_band(px, 64, 64).collect()}
    assert (30, 36) in band and (30, 35) not in band and (30, 51) in band and (30, 52) not in band and (31, 31) not in band
