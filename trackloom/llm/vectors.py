"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many fixed random lines. Two vectors collide on a line if one lies within
the window centred on the other; a pair at the threshold does so on a share of the lines that the normal
law gives, and the least number of collisions that such a pair misses with probability 1e-6 at most is
the count a candidate must reach. Candidates are confirmed by their cosine in double precision.

To keep windows narrow on large tables the lines are also cut into cells, 8 lines to a key and 32 keys
to a vector: vectors meet where a key is equal (a pair at the threshold misses all 32 with probability
below 1e-5), and inside such a bucket each vector's window on a sorted line gives the pairs whose
collisions are counted. A pair is taken up only under its first common key, so it is confirmed once.
Large buckets are dealt in pairs of bounded blocks; a task returns each vector's number of links and a
spanning forest, never the pairs.

Vectors are compared if labels and lengths are equal. Equal vectors form one class that weighs as many
as its rows. Defined results: a null label, id or vector, a zero or empty vector, and one with a null or
non-finite component link with nothing, are their own component and are kept; repeated rows are vectors
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import Forest, block_pairs, components, in_groups
from trackloom.session import cut_lineage

KEYS, LINES = 32, 8
COUNTED = 64
BLOCK = 512
SEED = 11


@lru_cache(maxsize=16)
def _lines(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, KEYS * LINES)), rng.random(KEYS * LINES)


def window_of(threshold: float) -> tuple[float, float]:
    """Half width of the window (two standard deviations of a pair at the threshold) and the cell width."""
    distance = math.sqrt(max(2 - 2 * threshold, 1e-12))
    return 2 * distance, 6 * distance


def least_collisions(miss: float = 1e-6, lines: int = COUNTED) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(2 / math.sqrt(2))
    below = 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if below > miss:
            return c
    return lines


def _project(threshold: float):
    _, cell = window_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b["embedding"]
            n = len(rows)
            values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = rows.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(size)
            unit: list[bytes | None] = [None] * n
            keys: list[bytes | None] = [None] * n
            for dim in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == dim)
                x = values[(ends[own] - dim)[:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    big = np.abs(x).max(1)
                    fit = np.isfinite(x).all(1) & (big > 0)
                own, x = own[fit], x[fit] / big[fit, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                lines, shift = _lines(dim)
                cells = np.floor(x @ lines / cell + shift).astype(np.int64).astype(np.uint64).reshape(-1, KEYS, LINES)
                h = np.full(cells.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
                for k in range(LINES):
                    h = (h ^ cells[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                short = (h >> np.uint64(32)).astype(np.uint32)
                for at, v, s in zip(own.tolist(), x, short):
                    unit[at], keys[at] = v.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(unit, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "unit", "keys"])

    return run


def _keys(rows: pa.Array) -> pa.Array:
    x = np.frombuffer(b"".join(rows.to_pylist()), np.uint32).astype(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(x), KEYS).cast(pa.list_(pa.int64()))


def _count_links(threshold: float):
    half, _ = window_of(threshold)
    least = least_collisions()

    def run(p: dict[str, np.ndarray]) -> list[tuple]:
        key = int(p["slot"][0])
        cls, weight, block = p["cls"], p["weight"], p["block"]
        if len(cls) < 2:
            return []
        x = np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(cls), -1)
        keys = np.frombuffer(b"".join(p["keys"]), np.uint32).reshape(len(cls), KEYS)
        across = block.min() != block.max()
        h = x @ _lines(x.shape[1])[0][:, :COUNTED]
        order = np.argsort(h[:, 0], kind="stable")
        sorted_line = h[order, 0]
        # one line alone must not decide: its window is 6 standard deviations wide on either side
        stop = np.searchsorted(sorted_line, sorted_line + 3 * half, side="right")
        links = np.zeros(len(cls), np.int64)
        forest, edges = Forest(len(cls)), []
        for place, i in enumerate(order.tolist()):
            j = order[place + 1 : stop[place]]
            if across:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            for a in range(0, key, 4):  # only pairs whose first common key is this one
                j = j[(keys[j, a : min(a + 4, key)] != keys[i, a : min(a + 4, key)]).all(1)]
                if not len(j):
                    break
            if not len(j):
                continue
            j = j[(np.abs(h[j] - h[i]) <= half).sum(1) >= least]
            j = j[x[j] @ x[i] >= threshold] if len(j) else j
            if len(j):
                links[i] += weight[j].sum()
                links[j] += weight[i]
                edges += [(cls[i], cls[k], 0) for k in j.tolist() if forest.union(i, k)]
        got = np.flatnonzero(links)
        return [*edges, *zip(cls[got], [None] * len(got), links[got])]

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    sketched = rows.mapInArrow(_project(threshold), "vec_id long, label long, unit binary, keys binary")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sketched = cut_lineage(sketched.select("vec_id", "label", F.when(usable, F.col("unit")).alias("unit"), "keys").withColumn("digest", F.sha2("unit", 256)))
    classes = cut_lineage(
        sketched.where("unit is not null").groupBy("label", "digest")
        .agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    )
    met = classes.select("label", F.octet_length("unit").alias("dim"), "cls", F.posexplode(F.arrow_udf(_keys, "array<long>")("keys")).alias("slot", "key"))
    bucket = ["label", "dim", "slot", "key"]
    members = block_pairs(met, bucket, "cls", BLOCK).join(classes.select("cls", "weight", "unit", "keys"), "cls")
    found = cut_lineage(in_groups(members, [*bucket, "bi", "bj"], _count_links(threshold), "u long, v long, n long"))
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    comps = components(found.where("v is not null").select("u", "v"))
    named = (
        classes.select("label", "digest", "cls", "weight").join(links, F.col("cls") == links["u"], "left").join(comps, F.col("cls") == comps["node"], "left")
        .select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("_c"))
    )
    out = sketched.join(named, ["label", "digest"], "left")
    component = F.coalesce("_c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
