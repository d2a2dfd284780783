"""Near-duplicate documents by SetSketch registers.

A document's word shingles are sketched into registers: the least of exponentially distributed hash
values per register, on a truncated logarithmic scale of base ``BASE``. Registers of a union are the
maxima of the registers, and two sets agree in a register about as often as they overlap.

1. Documents of equal shingle sets collapse into one class (128-bit digest of the set).
2. Bands of register values bring classes together. Inside a band bucket, in blocks of bounded size, the
   joint likelihood of the register comparison (how many are greater, equal, smaller) estimates each
   pair's similarity, and a spanning forest of the pairs that may qualify ties the bucket's classes to a
   group; the forest of a bucket has the components of all its qualifying pairs, and is linear in its size.
3. The texts of a group meet block by block, and pairs are confirmed on their full shingle sets in order
   of estimated similarity, unless they are connected already. Groups above one block first confirm
   inside blocks and against one block; only pairs of blocks that then still hold several components
   meet as well. So every pair that shares a bucket and may qualify is confirmed or already connected.

22 bands of 6 registers miss a pair of similarity 0.85 with probability below 4e-5; below a threshold
of 0.84, 26 bands of 5 are used, which do as well at 0.8.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer than
five words are one shingle; texts are read whole; rows of equal texts fall into one class whatever their
ids; a null id stays alone; the component is the least id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import BLOCK, Forest, block_pairs, components, in_groups
from trackloom.session import cut_lineage

WORDS = 5
REGISTERS = 132
#: Base of the registers' logarithm, their rate and their largest value: sets of up to 1e12 shingles.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Shingles hashed at a time.
STEP = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, (64, 256), dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_CHUNK = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    raw = _UPPER[np.frombuffer((text or "").encode(), np.uint8)]
    blank = _SPACE[raw]
    inside = ~blank
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    at = np.flatnonzero(inside)
    place = at - np.repeat(begin, size)
    value = _BYTE[place & 63, raw[at]]
    if size.max() > 64:  # bytes 64 apart are told apart by a factor
        value = value * (_CHUNK ** (place >> 6).astype(np.uint64) | np.uint64(1))
    word = _mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
    n = len(word)
    if n < WORDS:
        both = np.full(1, n, np.uint64)
        for i in range(n):
            both = both * _PLACE[i] + word[i : i + 1]
        return _mix(both)
    both = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        both += word[i : n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(_mix(both))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Register values of a set; each grows with the set and never shrinks."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    seeds = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for a in range(0, len(seeds), STEP):
        x = seeds[a : a + STEP] ^ _SALT[:, None]
        x *= _FACTOR[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=1), out=low)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(reg: np.ndarray) -> np.ndarray:
    """Estimated set sizes of rows of registers."""
    scale = REGISTERS * (1 - 1 / BASE) / (RATE * math.log(BASE))
    return scale / np.maximum((BASE ** -(reg.astype(np.float64))).sum(axis=-1), 1e-300)


def joint_similarity(greater: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Most likely similarity of two sets of known sizes, given how many registers are greater and smaller.

    With u and v the shares of the two sizes, a register of the first is greater with probability
    p(u - v J), p(x) = -log_b(1 - x (b - 1) / b), and smaller with p(v - u J). The likelihood is concave
    in J and is maximised over a fixed grid, then between its neighbours.
    """
    u = n_u / (n_u + n_v)
    v = 1 - u
    cap = np.minimum(u / v, v / u)
    equal = REGISTERS - greater - smaller

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return greater * log(up) + smaller * log(down) + equal * log(1 - up - down)

    low, high = np.zeros_like(cap), cap.copy()
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(18):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(a, 500) for x in batches for a in range(0, x.num_rows, 500)):
        sizes, k1, k2, regs = [], [], [], []
        for text in b["text"].to_pylist():
            s = shingle_hashes(text)
            sizes.append(len(s))
            k1.append(int((_mix(s + np.uint64(1))).sum()) if len(s) else 0)
            k2.append(int((_mix(s ^ _CHUNK)).sum()) if len(s) else 0)
            regs.append(registers(s).tobytes() if len(s) else None)
        signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array(sizes, pa.int64()), signed(k1), signed(k2), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "reg"]
        )


def _bands(rows: int):
    bands = REGISTERS // rows

    def run(regs: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
        h = np.full(x.shape[:2], 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
        for i in range(rows):
            h = _mix(h * _PLACE[i % WORDS] + x[:, :, i])
        return pa.FixedSizeListArray.from_arrays(pa.array(h.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")


def _least(threshold: float) -> float:
    """Estimates down to four standard deviations below the threshold go on to the full sets."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _estimates(reg: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = reg[i], reg[j]
    return joint_similarity((a > b).sum(1).astype(float), (a < b).sum(1).astype(float), size[i], size[j])


def _candidate_pairs(reg: np.ndarray, size: np.ndarray, allowed, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows that may qualify, most similar first.

    The share of equal registers settles the clear cases; the others get the joint estimate, all at once.
    """
    first, second, shares = [], [], []
    for i in range(len(reg) - 1):
        j = np.arange(i + 1, len(reg))
        j = j[(np.minimum(size[i], size[j]) >= floor * np.maximum(size[i], size[j])) & allowed(i, j)]
        if len(j):
            share = (reg[i] == reg[j]).sum(1) / REGISTERS
            near = share >= floor - 0.1
            first.append(np.full(near.sum(), i))
            second.append(j[near])
            shares.append(share[near])
    if not first:
        z = np.zeros(0, np.int64)
        return z, z
    i, j, e = map(np.concatenate, (first, second, shares))
    open_ = np.flatnonzero(e < floor + 0.1)
    if len(open_):
        e[open_] = _estimates(reg, size, i[open_], j[open_])
    keep = np.flatnonzero(e >= floor)
    order = keep[np.lexsort((j[keep], i[keep], -e[keep]))]
    return i[order], j[order]


def _decode(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(p["reg"]), np.uint16).reshape(-1, REGISTERS), p["n_shingles"].astype(np.float64)


def _bucket_forest(floor: float):
    def run(p: dict[str, np.ndarray]) -> list[tuple]:
        order = np.lexsort((p["block"], p["cls"]))  # a leader's own row goes before its row as a member
        order = order[np.concatenate([[True], p["cls"][order][1:] != p["cls"][order][:-1]])]
        if len(order) < 2:
            return []
        p = {k: v[order] for k, v in p.items()}
        reg, size = _decode(p)
        cls, lead = p["cls"], p["block"] == -1
        i, j = _candidate_pairs(reg, size, lambda i, j: np.ones(len(j), bool), floor)
        forest = Forest(len(cls))
        edges = [(cls[a], cls[b]) for a, b in zip(i.tolist(), j.tolist()) if forest.union(a, b)]
        if lead.any():  # a block of a large bucket: tie what is left to the bucket's leader
            top = int(np.flatnonzero(lead)[0])
            edges += [(cls[top], cls[a]) for a in range(len(cls)) if forest.union(top, a)]
        return edges

    return run


def _groups(classes: DataFrame, floor: float, rows: int) -> DataFrame:
    """(cls, grp): classes that may be linked, over one or more steps, by qualifying pairs."""
    bands = classes.select("cls", F.posexplode(_bands(rows)("reg")).alias("band", "key"))
    same = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sizes = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("lead"), *same).where("n > 1")
    # buckets of the same members, as near copies have in most bands, are looked at once
    sizes = sizes.groupBy("n", "lead", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("_b")).select("_b.*", "n", "lead")
    members = cut_lineage(bands.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")))
    # a class that is in a bucket of several blocks brings its leader along to each of them
    dealt = members.select("band", "key", "cls", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cls"), F.col("parts"))).otherwise(0).cast("int").alias("part"), F.lit(0).alias("block"))
    leaders = (
        members.where("parts > 1 and cls = lead").select("band", "key", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("block"))
    )
    both = leaders.unionByName(dealt).join(classes.select("cls", "reg", "n_shingles"), "cls")
    edges = in_groups(both, ["band", "key", "part"], _bucket_forest(floor), "u long, v long")
    return components(edges).select(F.col("node").alias("cls"), F.col("component").alias("grp"))


def _confirm(threshold: float, floor: float):
    """Confirm pairs of one pair of blocks on their full sets; returns a spanning forest of true links."""
    percent = round(threshold * 100)

    def run(p: dict[str, np.ndarray]) -> list[tuple]:
        order = np.argsort(p["cls"])
        p = {k: v[order] for k, v in p.items()}
        reg, size = _decode(p)
        cls, comp, block = p["cls"], p["comp"], p["block"]
        across = block.min() != block.max()
        forest = Forest(len(cls))
        first: dict[int, int] = {}
        for k, c in enumerate(comp.tolist()):
            forest.union(first.setdefault(c, k), k)
        roots = np.array([forest.find(k) for k in range(len(cls))])
        if len(set(roots.tolist())) == 1:
            return []
        i, j = _candidate_pairs(reg, size, lambda i, j: (roots[i] != roots[j]) & ((block[i] != block[j]) | (not across)), floor)
        sets: dict[int, np.ndarray] = {}
        texts = p["text"]

        def own(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_hashes(texts[k])
            return sets[k]

        edges = []
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.find(a) == forest.find(b):
                continue
            x, y = own(a), own(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both) and forest.union(a, b):
                edges.append((cls[a], cls[b]))
        return edges

    return run


def _relabel(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with the component that the links found so far give them."""
    found = components(edges).select(F.col("node").alias("cls"), F.col("component").alias("_c"))
    return cut_lineage(members.drop("comp").join(found, "cls", "left").withColumn("comp", F.coalesce("_c", "cls")).drop("_c"))


def near_duplicates(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    floor = _least(threshold)
    sketched = cut_lineage(docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, k1 long, k2 long, reg binary"))
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    # one class per distinct set: the least id stands for it; the registers are those of any member
    classes = cut_lineage(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n_shingles"), F.first("reg").alias("reg")))
    groups = _groups(classes, floor, 6 if threshold >= 0.84 else 5)

    # texts of the classes that are in a group; equal rows give one text
    wanted = groups.join(classes, "cls")
    texts = docs.where("doc_id is not null").join(wanted.select(F.col("cls").alias("doc_id"), "grp"), "doc_id").select(F.col("doc_id").alias("cls"), "text")
    texts = texts.withColumn("_own", F.xxhash64("text")).groupBy("cls").agg(F.min_by("text", "_own").alias("text"))
    members = cut_lineage(wanted.join(texts, "cls").select("grp", "cls", "n_shingles", "reg", "text").withColumn("comp", F.col("cls")))

    schema = "u long, v long"
    dealt = block_pairs(members, ["grp"], "cls")
    # blocks on their own, and every block against the first
    near = in_groups(dealt.where("bi = bj or bi = 0"), ["grp", "bi", "bj"], _confirm(threshold, floor), schema)
    links = cut_lineage(near)
    members = _relabel(members, links)
    # the other pairs of blocks, unless all their members are in one component
    rest = block_pairs(members.drop("text", "reg"), ["grp"], "cls").where("bi <> bj and bi <> 0")
    split = rest.groupBy("grp", "bi", "bj").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp", "bi", "bj")
    split = cut_lineage(split)
    if split.limit(1).count():
        more = in_groups(block_pairs(members, ["grp"], "cls").join(split, ["grp", "bi", "bj"]), ["grp", "bi", "bj"], _confirm(threshold, floor), schema)
        links = cut_lineage(links.union(more))
    found = components(links).select(F.col("node").alias("cls"), "component")
    named = classes.select("k1", "k2", "cls").join(found, "cls", "left").select("k1", "k2", F.coalesce("component", "cls").alias("_c"))
    out = sketched.join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
