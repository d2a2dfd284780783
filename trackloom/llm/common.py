"""Helpers the operators share: folds, graph components, bounded blocks of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom.session import cut_lineage, shuffles_dropped

#: Rows of one block of a group; a task holds at most two blocks.
BLOCK = 256
#: Id rows up to which a counted key table is broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """The test fold: crc32 of the id's digits is a multiple of five. A null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, component), the component being its smallest node.

    Alternates two steps that contract the graph until nothing changes: every node is linked to the
    smallest node of its neighbourhood, first over larger neighbours, then over smaller ones. Each is
    one aggregation, so a node with many edges is pre-aggregated and never held whole. The edges of a
    round are written to the checkpoint folder. Self-loops are ignored; an empty edge list gives no rows.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    state = _digest(e)
    for _ in range(max_rounds):
        # every larger neighbour, and the node itself, points to the smallest of the neighbourhood
        small = _min_neighbour(e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(e.select(F.col("lo").alias("n"), F.col("lo").alias("m"))))
        large = e.join(small.withColumnRenamed("n", "lo"), "lo").where("m <= lo").select("hi", F.col("m").alias("lo"))
        # every smaller neighbour points to the smallest one
        star = large.union(small.where("m < n").select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct()
        low = _min_neighbour(star.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        nxt = cut_lineage(
            star.join(low.withColumnRenamed("n", "hi"), "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p"))
            .select("p.hi", "p.lo").where("hi > lo").distinct()
        )
        before, e, state = state, nxt, _digest(nxt)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    ).distinct()


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("n").agg(F.min("m").alias("m"))


def _digest(edges: DataFrame) -> tuple:
    """An order-free digest of an edge list; its one row is all that reaches the driver."""
    columns = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))]
    with shuffles_dropped(edges.sparkSession):
        return tuple(edges.agg(*columns).first())


def block_pairs(members: DataFrame, group: Sequence[str], member: str, block: int = BLOCK) -> DataFrame:
    """Give each member its block and the pairs of blocks that it belongs to.

    Adds (block, bi, bj) with bi <= bj; grouping by (group, bi, bj) then brings any two members of a
    group together in at least one task, and no task gets more than two blocks. A group of n members is
    dealt over ceil(n / block) blocks by a hash, so each member is repeated once for each block.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = members.join(sizes, list(group)).withColumn("_b", blocks).withColumn("block", F.pmod(F.xxhash64(member), F.col("_b")).cast("int"))
    return (
        dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("bi", F.least("block", "_o")).withColumn("bj", F.greatest("block", "_o"))
        .drop("_n", "_b", "_o")
    )


def without(docs: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` columns are not in ``gone``, a null id being equal to a null id.

    The keys are counted first and broadcast up to ``BROADCAST_KEYS``, so that texts need not be
    shuffled; beyond that it is a shuffled anti-join.
    """
    keys = cut_lineage(gone.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct())
    few = keys.count() <= BROADCAST_KEYS
    match = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in on]
    return docs.join(F.broadcast(keys) if few else keys, match, "left_anti")


def in_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key, given as numpy columns; it returns output rows.

    One shuffle by key and a sort that may spill; a task streams its partition and holds one group at a
    time, so groups must be bounded. Unlike a grouped map, small groups cost no call of their own.
    """
    names = df.columns
    order = [names.index(k) for k in keys]

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for c in batch.columns:
            plain = pa.types.is_integer(c.type) or pa.types.is_floating(c.type)
            if plain and not c.null_count:
                out.append(c.to_numpy())
            else:
                out.append(np.empty(len(c), object))
                out[-1][:] = c.to_pylist()
        return out

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        last: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = columns(b)
            change = np.zeros(b.num_rows, bool)
            for k in order:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            change[0] = last is not None and tuple(cols[k][0] for k in order) != last
            last = tuple(cols[k][-1] for k in order)
            cuts = np.flatnonzero(change).tolist()
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if a in cuts and held:
                    yield [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]
                    held = []
                if z > a:
                    held.append([c[a:z] for c in cols])
        if held:
            yield [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for cols in groups(batches):
            out += fn(dict(zip(names, cols)))
            if len(out) >= 20_000:
                yield _rows(out, wanted)
                out = []
        yield _rows(out, wanted)

    wanted = [x.split() for x in schema.split(",")]
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _rows(rows: list[tuple], wanted: list[list[str]]) -> pa.RecordBatch:
    """Rows of long columns."""
    cols = list(zip(*rows)) if rows else [()] * len(wanted)
    return pa.RecordBatch.from_arrays([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in cols], [n for n, _ in wanted])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
