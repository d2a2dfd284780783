"""Mixing sources to target weights: how often a mix takes each document.

The words of a mix are dealt to sources by weight, no source above a multiple of its own words. A source
of share x takes every document floor(x) times, and once more with the fraction p that is left. Which
documents those are is settled by pivotal dependent rounding: two fractional documents meet, and words of
one are moved to the other, in a random direction that keeps both expectations, until one of them is
whole. The words taken from a source therefore never drift: they miss its target by less than one
document.

Documents of a source are dealt over blocks by a hash. A task streams a block from the largest document to
the smallest and carries a single fractional one, so the residual of a block tends to be a small document.
Residuals climb a tree of blocks until one is left per source, which is rounded at random. Random numbers
follow from the seed, the source and the block, so a rerun gives the same mix.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own,
after all others; null ids are kept; rows equal in source, id and size share their fractions first, so any
number of them is settled at once; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.ordered import index_within
from trackloom.session import cut_lineage

#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
#: Documents of a block, and blocks whose residuals meet in one block of the next level.
BLOCK, FAN = 2048, 64
#: Bytes of source names up to which the table of sources is broadcast.
BROADCAST_BYTES = 16_000_000
#: Copies of one row made from one array.
CHUNK = 100_000


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): ``share`` times all words, dealt by weight.

    Sources take ``weights`` in turn, by code point and null last. Targets stop at ``most`` times the
    source's size and what is left over is dealt again; only sums over all sources reach the driver.
    """
    if share > most:
        raise ValueError("a mix cannot take more than every source may give")
    named = sizes.withColumns({"_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    # the sorted partitions are the segments of the numbering, so they are written down first
    parts = cut_lineage(named.orderBy("_last", "_name").withColumn("_part", F.spark_partition_id()))
    placed = index_within(parts, [], ["_last", "_name"], F.col("_part"), "_place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int"))
    table = cut_lineage(placed.select(*sizes.columns, weight.alias("_weight")))
    full = F.lit(float(most)) * F.col("source_size")
    total = table.agg(F.sum("source_size").alias("n"), F.sum("_weight").alias("w")).first()
    want, rate, before = share * (total.n or 0), 0.0, -1
    free_weight, free_words = total.w or 0, share * (total.n or 0)
    while free_weight:
        rate = free_words / free_weight
        above = full < F.lit(rate) * F.col("_weight")
        row = table.agg(
            F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)).alias("w")
        ).first()
        if row.n == before:
            break
        before, free_weight, free_words = row.n, row.w, want - most * row.words
    return table.withColumn("target", F.least(full, F.lit(rate) * F.col("_weight"))).drop("_weight")


_LEVEL = (
    "source string, block long, doc_id long, size long, source_size long, target double, whole long, p double, key long, extra long"
)


def _level(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Settle all documents of each block but one; the last level settles all."""
    names = [x.split()[0] for x in _LEVEL.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, float, int | None]]:
        at, rng, held, p = None, None, None, 0.0
        for b in batches:
            for row in zip(*(b[n].to_pylist() for n in names[:-1])):
                if row[:2] != at:
                    if held is not None:
                        yield _rest(held, p, rng, last)
                    at, held = row[:2], None
                    rng = np.random.default_rng([seed, level, row[1], zlib.crc32(repr(row[0]).encode())])
                size, q = row[3], row[7]
                if not 0.0 < q < 1.0 or not size:  # a document without words is never taken
                    yield row, q, int(q >= 1.0 and size > 0)
                    continue
                if held is None:
                    held, p = row, q
                    continue
                p, q = _transfer(held[3], p, size, q, rng.random())
                if p in (0.0, 1.0):
                    yield held, p, int(p)
                    held, p = row, q
                    if q in (0.0, 1.0):
                        yield row, q, int(q)
                        held = None
                else:
                    yield row, q, int(q)
        if held is not None:
            yield _rest(held, p, rng, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, p, extra in stream(batches):
            out.append((*row[:7], p, row[8], extra))
            if len(out) == 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    order = ["source", "block", F.desc("size"), "key", "doc_id"]
    return rows.select(names[:-1]).repartition("source", "block").sortWithinPartitions(*order).mapInArrow(run, _LEVEL)


_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in _LEVEL.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _rest(row: tuple, p: float, rng: np.random.Generator, last: bool) -> tuple[tuple, float, int | None]:
    """The last fractional document of a block: settled at the top, else handed on with its fraction."""
    return row, p, int(rng.random() < p) if last else None


def _transfer(a: int, p: float, b: int, q: float, u: float) -> tuple[float, float]:
    """Move words between two documents of sizes a, b and fractions p, q until one fraction is 0 or 1."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        p, q = (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
    else:
        p, q = (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)
    return _settled(p), _settled(q)


def _settled(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 13) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every document; ``taken`` is copies x size."""
    counted = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"))
    # equal rows meet before the shuffle; texts are read once
    counted = cut_lineage(counted.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = cut_lineage(source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source"))
    facts = targets.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 40).alias("bytes"), F.max("n_rows").alias("rows")).first()
    small = (facts.bytes or 0) <= BROADCAST_BYTES
    joined = counted.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parted = joined.withColumn("whole", F.floor(x)).withColumn("p", x - F.col("whole"))
    # of n equal rows, floor(n p) take one more and one keeps the fraction that is left
    mass = F.col("n") * F.col("p")
    parted = parted.withColumn("more", F.least(F.floor(mass), F.col("n") - 1))
    keys = F.xxhash64(F.lit(seed), "doc_id", "size")
    blocks = F.ceil(F.col("n_rows") / F.lit(BLOCK))
    rows = parted.withColumns(
        {"p": F.greatest(mass - F.col("more"), F.lit(0.0)), "key": keys, "block": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), blocks)}
    )
    result = ["doc_id", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    alike = F.explode(F.array(F.struct(F.col("more").alias("k"), F.lit(1).alias("extra")), F.struct((F.col("n") - 1 - F.col("more")).alias("k"), F.lit(0).alias("extra"))))
    done = [_repeated(parted.where("n > 1").select("*", alike.alias("_a")).select("doc_id", "size", "source_size", "target", "whole", "_a.extra", "_a.k")).select(*result)]
    levels = 0
    while BLOCK * FAN**levels < (facts.rows or 0):
        levels += 1
    for level in range(levels + 1):
        out = cut_lineage(_level(rows, level, seed, level == levels))
        done.append(out.where("extra is not null").select(*result))
        rows = out.where("extra is null").withColumn("block", F.floor(F.col("block") / F.lit(FAN)))
    mixed = done[0]
    for d in done[1:]:
        mixed = mixed.unionByName(d)
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row ``k`` times, from arrays of at most ``CHUNK`` entries."""
    part = rows.where("k > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / F.lit(CHUNK)))))
    left = F.least(F.lit(CHUNK), F.col("k") - F.col("_c") * CHUNK).cast("int")
    return part.withColumn("_r", F.explode(F.array_repeat(F.lit(0), left))).drop("_c", "_r", "k")
