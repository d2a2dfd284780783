"""Phrase collocations by dynamic itemset counting.

Texts are cut into numbered words once and dealt over shards, which are scanned in a cycle. Words are counted from the first shard on.
After each shard, a longer phrase becomes active once the phrases of one word less at its front and its
back have reached the threshold in what was seen so far; it is then counted in the following shards for one
full cycle. Lengths are thus interleaved: the first scan counts words and, after its first shard, pairs
and longer phrases as well, and a frequent phrase of m words is complete after at most m cycles.

Counts live in a table keyed by a 128-bit hash of language and phrase, written to the shared folder after
each shard; a last scan brings the texts of the frequent ones and fails if two of them share a hash. A
shard's count of a phrase is a fact of that shard, taken once (a bit notes the shards that gave one), so a
phrase that is counted too early or too long only gets its true counts, and a phrase that ended its cycle
below the threshold is dropped. Tasks therefore need not know the active set exactly: they are given one
byte for each of ``slots`` hash slots, the last step at which a phrase of that slot reached the threshold.
Two slots have to agree, so few others are counted, and none of the active ones is missed. That table has a
fixed size; when a corpus outgrows it, more phrases are counted than need be and the result is the same.

A task numbers the words of some megabytes of text, counts phrases as pairs of numbers and hands on one
narrow row per distinct phrase, so a very frequent word or phrase is a few rows in the shuffle.

Defined results: a null text is empty, a null language is ``und``; texts without words add nothing; phrases
never cross the marks ``. , ; : ! ?`` or line ends; repeated documents count each time; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trackloom.functions.ordered import top_k
from trackloom.session import cut_lineage, shared_folder

#: Shards of a cycle.
SHARDS = 2
#: Hash slots of the table of phrases that reached the threshold, one byte each.
SLOTS = 1 << 24
#: Bytes of text that are numbered together, and whose phrases a task counts at a time.
CHUNK = 4_000_000

_BREAK = b"\xff"  # no byte of UTF-8
_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_TABLE = bytes(0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))


Hashes = tuple[np.ndarray, np.ndarray]


def _mixed(front: Hashes, last: Hashes) -> Hashes:
    """Hash of a phrase from those of all but its last word, and of its last word."""
    out = []
    for a, b, odd in zip(front, last, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = a * np.uint64(odd) + (b ^ (b >> np.uint64(29)))
        out.append((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
    return out[0], out[1]


def _word_hashes(words: list[bytes], lang: str) -> Hashes:
    seed = zlib.crc32(lang.encode())
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for w in words), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _reached(h: Hashes, table: np.ndarray) -> np.ndarray:
    """One more than the latest step at which the phrase may have reached the threshold; 0: it has not."""
    low = np.uint64(len(table) - 1)
    return np.minimum(table[(h[0] & low).astype(np.int64)], table[(h[1] & low).astype(np.int64)])


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Words of some texts as numbers, in order, with -1 where a piece ends, and the words by number."""
    joined = b"\n".join([*texts, b""]).translate(_TABLE).replace(b"\n", b" \xff ")
    tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten().dictionary_encode()
    numbers, words = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary.cast(pa.binary())
    kind = np.fromiter(((w != b"") + (w == _BREAK) for w in words.to_pylist()), np.int8, len(words))
    numbers = numbers[kind[numbers] > 0]  # nothing stands between two spaces
    return np.where(kind[numbers] == 2, -1, numbers), words


_CHUNKS = "shard int, sign int, lang string, numbers binary, words binary, hashes binary"


def _numbered_chunks(docs: DataFrame, shards: int) -> DataFrame:
    """Some megabytes of text of a language a row: word numbers, the words, and their hashes.

    Chunks go to the shards in turn, from a place that depends on the partition. ``sign`` is one of 254
    numbers that tells most chunks from a given one.
    """
    chunk_bytes = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        turn = place
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                numbers, words = _numbered(texts)
                hashes = np.stack(_word_hashes(words.to_pylist(), lang))
                sign = 1 + zlib.crc32(f"{place} {turn} {lang}".encode()) % 254
                row = (turn % shards, sign, lang, numbers.astype(np.int32).tobytes(), b" ".join(words.to_pylist()), hashes.tobytes())
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["shard", "sign", "lang", "numbers", "words", "hashes"])

        rows = (
            (lang, text) for b in batches for at in range(0, b.num_rows, 200) for part in [b.slice(at, 200)]
            for lang, text in zip(part["lang"].to_pylist(), part["text"].cast(pa.binary()).to_pylist())
        )
        for lang, text in rows:
            start = 0
            while start < len(text):  # a long text is cut where a piece ends
                cut = _END.search(text, start + chunk_bytes) if len(text) - start > chunk_bytes else None
                end = cut.start() if cut else len(text)
                held[lang].append(text[start:end])
                size += end - start
                start = end
                if size >= chunk_bytes:
                    yield from flush()
                    held.clear()
                    size, turn = 0, turn + 1
        yield from flush()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _CHUNKS)


class _Chunk:
    """A numbered text of one language, and the phrases in it that may have reached the threshold."""

    def __init__(self, numbers: bytes, hashes: bytes, words: bytes | None, table: np.ndarray) -> None:
        self.numbers, self.table = np.frombuffer(numbers, np.int32), table
        both = np.frombuffer(hashes, np.uint64).reshape(2, -1)
        self.word_hashes, self.size = (both[0], both[1]), both.shape[1]
        self.words = None if words is None else words.split(b" ")

    def lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray, Hashes, np.ndarray]]:
        """Of each length: positions whose phrase may be frequent by its parts, its hashes, and the later part's step + 1.

        For single words, all positions and 0.
        """
        every = np.flatnonzero(self.numbers >= 0)
        hashes = tuple(h[self.numbers[every]] for h in self.word_hashes)
        yield 1, every, hashes, np.zeros(len(every), np.uint8)
        steps = np.zeros(len(self.numbers), np.uint8)
        steps[every] = _reached(self.word_hashes, self.table)[self.numbers[every]]
        for k in range(2, longest + 1):
            place = np.zeros(len(self.numbers), np.int32)
            place[every] = np.arange(len(every))
            at = np.flatnonzero((steps[:-1] > 0) & (steps[1:] > 0))
            before = place[at]
            hashes = _mixed(tuple(h[before] for h in hashes), tuple(h[self.numbers[at + k - 1]] for h in self.word_hashes))
            yield k, at, hashes, np.maximum(steps[at], steps[at + 1])
            if k < longest:
                steps = np.zeros(len(steps) - 1, np.uint8)
                steps[at] = _reached(hashes, self.table)
                every = at

    def distinct(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at`` of one place of each distinct phrase of k words, its count)."""
        number, unique = pd.factorize(self.numbers[at].astype(np.int64))
        for j in range(1, k):
            number, unique = pd.factorize(number * self.size + self.numbers[at + j])
        first = np.empty(len(unique), np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        return first, np.bincount(number, minlength=len(unique))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        words = pa.array(self.words, pa.binary())
        return pc.binary_join_element_wise(*(words.take(pa.array(self.numbers[at + j])) for j in range(k)), b" ").cast(pa.string())


def _each_chunk(chunks: DataFrame, table, rows, schema: str, words: bool = False) -> DataFrame:
    """Apply ``rows(chunk, lang, sign)``, which gives Arrow batches, to every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lang, sign, numbers, hashes, *names = (c[i].as_py() for c in b.columns)
                yield from rows(_Chunk(numbers, hashes, names[0] if names else None, table.value), lang, sign)

    return chunks.select("lang", "sign", "numbers", "hashes", *["words"] * words).mapInArrow(run, schema)


def _batches(columns: dict[str, np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(next(iter(columns.values()))), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows]) for c in columns.values()], list(columns))


def _counted(chunks: DataFrame, step: int, shards: int, longest: int, table) -> DataFrame:
    """(a, b, n, until) of the active phrases of one shard, one row per phrase and chunk.

    ``until`` is the last step of the phrase's cycle, times 256, plus the sign of a chunk that holds it.
    """

    def rows(chunk: _Chunk, lang: str, sign: int) -> Iterator[pa.RecordBatch]:
        for k, at, (a, b), later in chunk.lengths(longest):
            # a word's cycle ends with the first one; a phrase's, one cycle after its parts reached the threshold
            until = later.astype(np.int32) - 1 + shards
            alive = np.flatnonzero(until >= step) if k > 1 else np.arange(len(at) if step < shards else 0)
            if len(alive):
                first, n = chunk.distinct(at[alive], k)
                one = alive[first]
                yield from _batches({"a": a[one].view(np.int64), "b": b[one].view(np.int64), "n": n.astype(np.int64), "until": until[one] * 256 + sign})

    return _each_chunk(chunks, table, rows, "a long, b long, n long, until int")


def _named(chunks: DataFrame, longest: int, table, signs) -> DataFrame:
    """(a, b, k, lang, phrase, n): texts of the frequent phrases; for the empty phrase (k = 0), all words.

    ``signs`` has, by slot, the sign of a chunk that holds the phrase, or 255 where phrases of that slot
    disagree: a phrase is named by that chunk and by few others.
    """

    def rows(chunk: _Chunk, lang: str, sign: int) -> Iterator[pa.RecordBatch]:
        low = np.uint64(len(signs.value) - 1)
        for k, at, (a, b), _ in chunk.lengths(longest):
            if k == 1:
                yield _names(np.zeros(1, np.int64), np.zeros(1, np.int64), 0, lang, pa.array([""]), len(at))
            mine = np.ones(len(at), bool)
            for h in (a, b):
                found = signs.value[(h & low).astype(np.int64)]
                mine &= (found == sign) | (found == _MANY)
            some = np.flatnonzero(mine)
            one = some[chunk.distinct(at[some], k)[0]]
            for z in range(0, len(one), 50_000):
                part = one[z : z + 50_000]
                yield _names(a[part].view(np.int64), b[part].view(np.int64), k, lang, chunk.phrases(at[part], k), 0)

    return _each_chunk(chunks, table, rows, "a long, b long, k int, lang string, phrase string, n long", words=True)


def _names(a: np.ndarray, b: np.ndarray, k: int, lang: str, phrase: pa.Array, n: int) -> pa.RecordBatch:
    rows = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(np.full(rows, k, np.int32)), pa.repeat(pa.scalar(lang), rows), phrase, pa.array(np.full(rows, n, np.int64))], ["a", "b", "k", "lang", "phrase", "n"]
    )


_MANY = 255


def _slot_table(hashes: DataFrame, slots: int) -> np.ndarray:
    """Table of one byte per slot from (a, b, value): the value of the hashes of a slot, ``_MANY`` where they differ, else 0.

    Ranges of slots are put together in the tasks; ``slots`` bytes reach the driver at most.
    """
    width = min(slots, 1 << 16)

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(x == 0, y, np.where((y == 0) | (x == y), x, _MANY)).astype(np.uint8)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            value = batch["value"].to_numpy().astype(np.uint8)
            for h in ("a", "b"):
                at = batch[h].to_numpy() & (slots - 1)
                order = np.argsort(at, kind="stable")
                at, v = at[order], value[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                low, high = (f.reduceat(v, starts) if len(starts) else v for f in (np.minimum, np.maximum))
                at, v = at[starts], np.where(low == high, low, _MANY).astype(np.uint8)
                for r in np.unique(at // width).tolist():
                    part = np.zeros(width, np.uint8)
                    part[at[at // width == r] % width] = v[at // width == r]
                    seen[r] = both(seen[r], part) if r in seen else part
        yield _ranges(seen)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, x in zip(batch["r"].to_pylist(), batch["bytes"].to_pylist()):
                part = np.frombuffer(zlib.decompress(x), np.uint8)
                seen[r] = both(seen[r], part) if r in seen else part
        yield _ranges(seen)

    schema = "r int, bytes binary"
    out = np.zeros(slots, np.uint8)
    for row in hashes.select("a", "b", "value").mapInArrow(spread, schema).repartition("r").mapInArrow(union, schema).collect():
        out[row.r * width : (row.r + 1) * width] = np.frombuffer(zlib.decompress(row.bytes), np.uint8)
    return out


def _ranges(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in found.values()], pa.binary())], ["r", "bytes"])


_STATE = "a long, b long, n long, mask int, until int, reached int"


def _merged(state: DataFrame, new: DataFrame, step: int, here: int, min_count: int) -> DataFrame:
    """Counts after a shard; phrases that ended their cycle below the threshold go."""
    zero, bit = F.lit(0).cast("long"), F.lit(1 << here)
    # shuffled rows are narrow: an old count travels with its mask, and one more than the step at which it
    # reached the threshold, as one negative number; a new one is positive
    facts = F.shiftleft(F.coalesce(F.col("reached") + 1, F.lit(0)), 8).bitwiseOR(F.col("mask")).cast("long")
    old = state.select("a", "b", (-F.shiftleft("n", 16) - facts).alias("v"), "until")
    both = old.union(new.select("a", "b", F.col("n").alias("v"), "until")).repartition("a", "b")
    v = F.col("v")
    once = both.groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(v > 0, v)), zero).alias("more"), F.coalesce(F.max(F.when(v < 0, -v)), zero).alias("old"), F.max("until").alias("until")
    )
    mask = F.col("old").bitwiseAND(F.lit(255)).cast("int")
    reached = F.shiftright("old", 8).bitwiseAND(F.lit(255)).cast("int")
    once = once.withColumns({"mask": mask, "reached": F.when(reached > 0, reached - 1), "n": F.shiftright("old", 16) + F.when(mask.bitwiseAND(bit) == 0, F.col("more")).otherwise(zero)})
    return once.select(
        "a", "b", "n", F.col("mask").bitwiseOR(F.when(F.col("more") > 0, bit).otherwise(F.lit(0))).alias("mask"), "until",
        F.coalesce("reached", F.when(F.col("n") >= min_count, F.lit(step))).cast("int").alias("reached"),
    ).where((F.col("n") >= min_count) | (F.shiftright("until", 8) > step))


def frequent_phrases(docs: DataFrame, min_count: int = 10, longest: int = 3, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, phrase, k, n): all phrases of 1 to ``longest`` words that occur ``min_count`` times or more.

    The row of k = 0 and an empty phrase holds the number of all words of its language. ``shards`` is at most
    8, ``slots`` a power of two.
    """
    if not 1 <= shards <= 8 or longest * shards > 250 or slots & (slots - 1):
        raise ValueError("shards are 1 to 8, slots a power of two")
    spark = docs.sparkSession
    folder = shared_folder(spark, "phrases")
    # texts are cut into words once; every later scan reads numbers
    _numbered_chunks(docs, shards).write.partitionBy("shard").parquet(f"{folder}/shards")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{folder}/shards")
    table = np.zeros(slots, np.uint8)
    state = spark.createDataFrame([], _STATE)
    step, last = 0, shards - 1
    while step <= last:
        reached = spark.sparkContext.broadcast(table)
        new = _counted(chunks.where(F.col("shard") == step % shards), step, shards, longest, reached)
        # two tables in turn: the last state is read while this one is written
        path = f"{folder}/state{step % 2}"
        _merged(state, new, step, step % shards, min_count).write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)
        reached.destroy()
        del new
        spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of this step
        state = spark.read.schema(_STATE).parquet(path)
        # phrases that reached the threshold here open longer ones for one cycle
        fresh = _slot_table(state.where(F.col("reached") == step).select("a", "b", F.lit(1).alias("value")), slots)
        table = np.where(fresh > 0, np.uint8(step + 1), table)
        last = max(last, min(step + shards, longest * shards - 1)) if fresh.any() else last
        step += 1
    frequent = state.where(F.col("n") >= min_count)
    signs = _slot_table(frequent.select("a", "b", F.col("until").bitwiseAND(F.lit(255)).alias("value")), slots)
    frequent = frequent.select("a", "b", "n")
    named = _named(chunks, longest, spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(signs))
    totals = named.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("k"), "n")
    text = F.struct("k", "lang", "phrase")
    names = named.where("k > 0").groupBy("a", "b").agg(F.min(text).alias("_t"), F.max(text).alias("_u"))
    one = F.when(F.col("_t") == F.col("_u"), F.col("_t")).otherwise(F.raise_error(F.lit("two phrases share a hash")))
    found = frequent.join(names, ["a", "b"]).select(one.alias("_t"), "n").select("_t.lang", "_t.phrase", "_t.k", "n")
    return cut_lineage(found.unionByName(totals))


def collocations(phrases: DataFrame, per_language: int = 2000, covered: int = 50) -> DataFrame:
    """Best-scored phrases of each language from :func:`frequent_phrases`, with rank from 1.

    A phrase of a occurrences that falls into parts of l and r occurrences scores floor(1000000 a a / (l r));
    its lowest cut counts. A phrase is left out if a longer one that holds it has ``covered`` percent of its
    occurrences. Arithmetic is in decimals of 38 digits.
    """
    n = F.col("n")
    several = phrases.where("k >= 2")
    words = F.split("phrase", " ")
    some = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))))
    )
    longer = several.where("k >= 3").select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    alone = several.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < F.lit(covered) * n, F.lit(True))).drop("_longer")
    cut = alone.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"_left": some(F.lit(1), F.col("cut")), "_right": some(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    part = phrases.where("k >= 1")
    for side, name in (("_left", "l"), ("_right", "r")):
        cut = cut.join(part.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    scored = cut.withColumn("score", F.expr(f"({wide['a']} * {wide['a']} * 1000000) div ({wide['l']} * {wide['r']})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("_b")).select("lang", "phrase", "a", "_b.*")
    ranked = top_k(best, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], per_language)
    totals = phrases.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
