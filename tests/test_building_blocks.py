"""Order and quantile blocks, including keys that hold most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import checks as K, ordered, quantiles


def skewed(spark, n=3000):
    """One key with about half of all rows, many small keys, repeated order values."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randrange(500), i, round(rng.gauss(0, 5), 1)) for i in range(n)]
    return data, spark.createDataFrame(data, "key string, t int, id int, v double").repartition(7)


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_index_within_matches_a_sort(spark):
    data, df = skewed(spark)
    got = {r.id: r.frame for r in ordered.index_within(df, ["key"], ["t", "id"], F.floor(F.col("t") / 50)).collect()}
    want = {row[2]: i for g in by_key(data).values() for i, row in enumerate(g)}
    assert got == want
    whole = {r.id: r.frame for r in ordered.index_within(df, [], ["t", "id"], F.floor(F.col("t") / 50)).collect()}
    assert whole == {row[2]: i for i, row in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_adjacent_and_running_min(spark, block):
    data, df = skewed(spark, 800)
    framed = ordered.index_within(df, ["key"], ["t", "id"], F.floor(F.col("t") / 50)).cache()
    near = ordered.with_adjacent(framed, ["key"], "frame", ["v"], 1, 1, block).collect()
    groups = {k: [r[3] for r in g] for k, g in by_key(data).items()}
    assert len(near) == len(data)
    for r in near:
        g = groups[r.key]
        assert r.prev_v == (g[r.frame - 1] if r.frame else None)
        assert r.next_v == (g[r.frame + 1] if r.frame + 1 < len(g) else None)
    for r in ordered.running_min_before(framed, ["key"], "frame", "v", block=block).collect():
        assert r.best_before == (min(groups[r.key][: r.frame]) if r.frame else None)


@pytest.mark.parametrize("n,k", [(97, 97), (97, 25), (193, 97), (26, 23), (5, 1), (2, 2)])
def test_even_positions(spark, n, k):
    got = spark.range(1).select(ordered.even_positions(F.lit(n), k).alias("p")).first().p
    assert got == np.rint(np.linspace(0, n - 1, k)).astype(int).tolist()


def test_even_positions_stride(spark):
    got = spark.range(1).select(ordered.even_positions(F.lit(193), 97).alias("p")).first().p
    assert [got[i] for i in (0, 24, 48, 72, 96)] == [0, 48, 96, 144, 192]


@pytest.mark.parametrize("sketch", [False, True])
def test_percentiles_are_exact(spark, monkeypatch, sketch):
    if sketch:  # force the bracket path on small data
        monkeypatch.setattr(quantiles, "ACCURACY", 100)
        monkeypatch.setattr(quantiles, "MARGIN", 0.03)
    data, df = skewed(spark)
    probs = [0.95, 0.0, 0.5, 0.005, 1.0, 0.15]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.key: [r[n] for n in names] for r in quantiles.percentiles(df, ["key"], "v", probs, names).collect()}
    for key, group in by_key(data).items():
        assert got[key] == pytest.approx(np.percentile([r[3] for r in group], [100 * p for p in probs]).tolist(), abs=1e-12)
    overall = quantiles.percentiles(df, [], "v", [0.5], ["m"]).first().m
    assert overall == pytest.approx(np.median([r[3] for r in data]))


def test_robust_scale_and_trimmed_median(spark):
    rows = [("a", 1.7 * (1 + 0.001 * i)) for i in (-1, 0, 1, 0)] + [("a", 40.0), ("a", 0.01), ("b", 1.0), ("b", -1.0)]
    df = spark.createDataFrame(rows, "key string, r double")
    out = {r.key: r for r in quantiles.trimmed_median(df, ["key"], "r").collect()}
    assert set(out) == {"a"} and out["a"].scale == pytest.approx(1.7, abs=1e-4) and out["a"].kept == 4
    values = np.array([r[1] for r in rows if r[0] == "a"])
    mid = np.median(values)
    scale = {r.key: r for r in quantiles.robust_scale(df, ["key"], "r").collect()}["a"]
    assert scale.median == pytest.approx(mid)
    assert scale.scale == pytest.approx(max(1.4826 * np.median(abs(values - mid)), abs(mid) * 1e-3))


def test_micros_ignores_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:07.179575' as ts")
    want = 1710037807179575
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(ordered.micros("ts").alias("t")).first().t == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_relative_paths(spark):
    df = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b/c",)], "p string")
    assert [r.ok for r in df.select(K.relative_path(F.col("p")).alias("ok")).collect()] == [True, False, False, True]


VECTORS = [
    ("[1, 2, 3]", True), ("[1, 2.5, 3e10]", True), ("[0, -9.81, 1e300]", True), ("[1, 2]", False), ("[1, 2, true]", False), ("[true, true, true]", False),
    ('[1, "2", 3]', False), ("[1, null, 3]", False), ("[1, [2], 3]", False), ("null", False), ("7", False), ("[]", False), ("[1e999, 0, 0]", False),
]


def test_json_vectors(spark):
    df = spark.createDataFrame([(t,) for t, _ in VECTORS], "t string").select("t", F.try_parse_json("t").alias("v"))
    got = {r.t: r.ok for r in df.select("t", K.vector_ok(F.col("v"), "$", 3).alias("ok")).collect()}
    assert got == dict(VECTORS)


def test_typed_matrices(spark):
    cases = {"[[1, 0, 0], [0, 2.5, 0], [0, 0, 1e3]]": True, "[[1, 0, 0], [0, 1, 0]]": False, "[[1, 0], [0, 1], [0, 0]]": False,
             "[[1, 0, 0], [0, true, 0], [0, 0, 1]]": False, "[[1, 0, 0], [0, 1, 0], null]": False, "[1, 2, 3]": False,
             '[[1, 0, 0], [0, "1", 0], [0, 0, 1]]': False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.from_json("t", "array<array<double>>").alias("m"))
    got = {r.t: r.ok for r in df.select("t", K.finite_matrix3(F.col("m")).isNotNull().alias("ok")).collect()}
    assert got == cases


def test_top_k_of_a_key_that_holds_most_rows(spark):
    from pyspark.sql import functions as F

    from trackloom.functions.ordered import top_k

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), (F.col("id") * 7919 % 10_007).alias("v"), "id")
    for k in (1, 3, 5_000):
        got = sorted(map(tuple, top_k(rows.repartition(9), ["key"], [F.desc("v"), "id"], k, rounds=2, fan=3).collect()))
        want, by = [], {}
        for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id)):
            by[r.key] = by.get(r.key, 0) + 1
            if by[r.key] <= k:
                want.append((r.key, r.v, r.id, by[r.key]))
        assert got == sorted(want)
