import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import metrics


def grid(spark, arrays, sample="s"):
    """Rows (sample, frame, cell, named columns) from arrays of shape frames x cells."""
    names = list(arrays)
    f, c = arrays[names[0]].shape
    data = [(sample, t, i, *[float(arrays[n][t, i]) for n in names]) for t in range(f) for i in range(c)]
    return spark.createDataFrame(data, "sample string, frame int, cell int, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture()
def random_pair():
    rng = np.random.default_rng(3)
    return rng.normal(size=(5, 12)), rng.normal(size=(5, 12)), (rng.random((5, 12)) < 0.4).astype(float)


def test_masked_mse_and_weights(spark, random_pair):
    p, t, m = random_pair
    df = grid(spark, {"p": p, "t": t, "m": m})
    assert metrics.masked_mse(df, ["sample"], "p", "t", "m").first().masked_mse == pytest.approx(((p - t) ** 2 * m).sum() / m.sum())
    w = metrics.balanced_weights(df.withColumn("one", F.lit(1.0)), ["sample"], "one", "m", 0.7)
    sums = {r.m: r.s for r in w.groupBy("m").agg(F.sum("weight").alias("s")).collect()}
    assert sums[1.0] == pytest.approx(0.7 * 60) and sums[0.0] == pytest.approx(0.3 * 60)
    flat = metrics.balanced_weights(df.withColumn("one", F.lit(1.0)).withColumn("m", F.lit(1.0)), ["sample"], "one", "m", 0.7)
    assert flat.filter("weight <> 1").count() == 0


def test_smooth_l1_of_changes(spark, random_pair):
    p, t, _ = random_pair
    d = np.abs(np.diff(p, axis=0) - np.diff(t, axis=0))
    want = np.where(d < 0.05, 0.5 * d * d / 0.05, d - 0.025).mean()
    df = grid(spark, {"p": p, "t": t})
    assert metrics.smooth_l1_delta(df, ["sample"], ["cell"], "frame", "p", "t", block=2).first().smooth_l1 == pytest.approx(want)
    same = df.withColumn("t", F.col("p"))
    assert metrics.smooth_l1_delta(same, ["sample"], ["cell"], "frame", "p", "t").first().smooth_l1 == 0


def test_response_error(spark, random_pair):
    p, t, m = random_pair
    df = grid(spark, {"lp": p, "lt": t, "lm": m, "hp": p + 1, "ht": t + 2, "hm": np.ones_like(m)})
    got = metrics.response_error(df, ["sample"], ("lp", "lt", "lm"), ("hp", "ht", "hm")).first().response_error
    assert got == pytest.approx(1.0 / 4.0)
    same = metrics.response_error(df, ["sample"], ("lp", "lt", "lm"), ("lp", "lt", "hm")).first().response_error
    assert same == 0


def test_js(spark):
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    got = metrics.js_divergence(grid(spark, {"p": p, "q": q}), ["sample"], "frame", "p", "q").first().js
    assert got == pytest.approx(np.log(2) / 2, abs=1e-5)


def test_weighted_metrics_merge_workers(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 3.0), ("b", 0.5, 0.25)], "k string, n double, c double")
    assert {r.k: r.metric for r in metrics.weighted_metrics(df, ["k"], "n", "c").collect()} == {"a": 1.5, "b": 0.5}


def test_abs_diff_needs_equal_sizes(spark):
    a = grid(spark, {"v": np.zeros((2, 3))})
    b = grid(spark, {"v": np.ones((2, 3))})
    r = metrics.abs_diff_stats(a, b, ["sample"], ["frame", "cell"], "v").first()
    assert (r.comparable, r.mean_abs_difference, r.p95_abs_difference, r.max_abs_difference) == (True, 1, 1, 1)
    r = metrics.abs_diff_stats(a, b.filter("frame = 0"), ["sample"], ["frame", "cell"], "v").first()
    assert r.comparable is False and r.max_abs_difference is None


def test_matching_and_soft_centres(spark):
    rng = np.random.default_rng(9)
    frames, cells, size = 3, 12, 5
    pred, target = rng.normal(size=(frames, cells, size)), rng.normal(size=(frames, cells, size))
    mask = rng.random((frames, cells)) < 0.5
    mask[:, 0] = True

    def table(x):
        return spark.createDataFrame([(t, i, [float(v) for v in x[t, i]], bool(mask[t, i])) for t in range(frames) for i in range(cells)], "frame int, cell int, f array<double>, mask boolean")

    unit = [metrics.centred_unit(table(x), ["frame"], "f", size) for x in (pred, target)]
    got = {(r.frame, r.cell): r.score for r in metrics.best_match(unit[0], unit[1], ["frame"], "cell", "f", "mask").collect()}

    def normal(x):
        c = x - x.mean(axis=1, keepdims=True)
        return c / np.maximum(np.linalg.norm(c, axis=2, keepdims=True), 1e-6)

    a, b = normal(pred), normal(target)
    scores = np.array([(a[t] @ b[t][mask[t]].T).max(axis=1) for t in range(frames)])
    assert all(got[t, i] == pytest.approx(scores[t, i]) for t in range(frames) for i in range(cells))
    xs = np.linspace(-1, 1, cells)
    df = spark.createDataFrame([(t, i, float(scores[t, i]), float(xs[i]), 0.0, bool(mask[t, i])) for t in range(frames) for i in range(cells)], "frame int, cell int, score double, x double, y double, mask boolean")
    centres = {r.frame: r for r in metrics.soft_centre(df, ["frame"], "score", "x", "y", "mask").collect()}
    for t in range(frames):
        w = np.exp((scores[t] - scores[t].max()) / 0.07)
        assert centres[t].pred_x == pytest.approx((w * xs).sum() / w.sum()) and centres[t].target_x == pytest.approx(xs[mask[t]].mean())


def test_equal_motion_has_no_error(spark):
    centres = spark.createDataFrame([("s", t, 0.1 * t, 0.2, 0.1 * t, 0.2, t != 2) for t in range(5)], "sample_id string, frame int, pred_x double, pred_y double, target_x double, target_y double, valid boolean")
    mass = spark.createDataFrame([("s", t, 0.5, 0.5) for t in range(5) for _ in range(2)], "sample_id string, frame int, p double, q double")
    r = metrics.motion_errors(centres, mass).first()
    assert (r.center, r.velocity, r.distribution) == pytest.approx((0, 0, 0), abs=1e-12)
    moved = centres.withColumn("pred_x", F.when(F.col("frame") == 4, F.lit(5.0)).otherwise(F.col("pred_x")))
    r = metrics.motion_errors(moved, mass).first()
    # Valid frames are 1, 3, 4 (frame 0 never counts); only 3 -> 4 has both ends valid.
    assert r.center == pytest.approx((4.6 - 0.025) / 2 / 3) and r.velocity == pytest.approx((4.6 - 0.025) / 2)


def test_loss_history(spark):
    df = spark.createDataFrame([("a", "total", 3, [3.0, 9.0, 1.0]), ("a", "lpips", 4, [1.0])], "run string, component string, steps int, values array<double>")
    got = {r.component: (r.length_ok, r.final_value, r.max_value) for r in metrics.loss_history(df, ["run"]).collect()}
    assert got == {"total": (True, 1.0, 9.0), "lpips": (False, 1.0, 1.0)}
