import numpy as np
import pytest

from trackloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, threshold=0.98):
    rows = [(i, None if e is None or any(x is None for x in e) else np.array(e, np.float64), lab) for i, e, lab in rows]
    good = [(i, e / np.linalg.norm(e), lab) for i, e, lab in rows if i is not None and lab is not None and e is not None and len(e) and np.isfinite(e).all() and np.any(e)]
    links, parent = {}, {i: i for i, _, _ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b >= threshold:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links.get(i, 0), find(i)) for i in parent}


def _rows(seed, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(8):
        base = rng.normal(size=dim)
        for _ in range(30):
            v = base + rng.normal(size=dim) * 0.13 * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0, 1.4)
            out.append((len(out), [float(np.float32(x)) for x in v], c % 3))
    out += [(len(out) + k, out[k * 7][1], out[k * 7][2]) for k in range(20)]  # exact copies
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = _rows(1)
    want = _brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_count_is_calibrated():
    c = vectors.least_collisions()
    rng = np.random.default_rng(0)
    half, _ = vectors.window_of(0.98)
    hits = (np.abs(rng.normal(0, 0.2, (200_000, vectors.COUNTED))) <= half).sum(1)
    assert (hits < c).mean() < 1e-4 and (hits <= c + 4).mean() > 1e-4


def test_odd_rows_and_empty_tables(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
        (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 2), (7, [1.0, 0.0], 1), (12, [1e-30, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("key", "cls", "unit", "u", "n")})
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    alone = {r for r in out if r[0] not in (7, 8, 12)}
    assert alone == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11, None)}
    assert sorted(r for r in out if r[0] in (7, 8, 12)) == [(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (12, 3, 7, False)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
