"""Choosing records: filters, group limits, sharding, deterministic draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.ordered import even_positions, index_within

# Rows of one segment when positions are taken over ordinals.
ORDINAL_SEGMENT = 1_000_000


def _segment(ordinal: str) -> Column:
    return F.floor(F.col(ordinal) / F.lit(ORDINAL_SEGMENT))


def select_records(
    df: DataFrame,
    split: str | None = None,
    groups: Sequence[str] | None = None,
    axis: str | None = None,
    group: str = "base_scene_id",
) -> DataFrame:
    """Plain pushed-down filters; an axis filter always keeps base rows."""
    out = df
    if split is not None:
        out = out.filter(F.col("split") == split)
    if groups is not None:
        out = out.filter(F.col(group).isin(*groups))
    if axis is not None:
        out = out.filter((F.col("mode") == "base") | (F.col("axis") == axis))
    return out


def unknown_groups(df: DataFrame, groups: Sequence[str], group: str = "base_scene_id") -> DataFrame:
    """Requested group ids that no row carries."""
    wanted = df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
    return wanted.join(df.select(group), group, "left_anti").orderBy(group)


def group_order(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Groups numbered by first appearance; numbering is segmented, not one global sort."""
    first = df.groupBy(group).agg(F.min(ordinal).alias("_first"))
    return index_within(first, [], ["_first"], _segment("_first"), "group_index").drop("_first")


def first_n_groups(df: DataFrame, group: str, ordinal: str, n: int) -> DataFrame:
    """All rows of the first ``n`` groups by first appearance."""
    keep = df.groupBy(group).agg(F.min(ordinal).alias("_first")).orderBy("_first").limit(n)
    return df.join(keep.select(group), group, "left_semi")


def with_shard(df: DataFrame, group: str, ordinal: str, shards: int) -> DataFrame:
    """Shard number of every row; a group never crosses shards."""
    numbered = group_order(df, group, ordinal)
    return df.join(numbered, group).withColumn("shard", F.pmod("group_index", F.lit(shards)).cast("int"))


def limit_ordered(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """First ``n`` rows in file order (a distributed top-n, not a full sort)."""
    return df.orderBy(ordinal).limit(n)


def nth(df: DataFrame, ordinal: str, index: int) -> DataFrame:
    """The row at a position, empty when out of range."""
    return df.filter(F.col(ordinal) == index)


def round_robin(df: DataFrame, group: str, ordinal: str, n: int, groups: int) -> DataFrame:
    """First ``n`` rows dealt one per group in turn, over the first ``groups`` groups.

    No group can give more than ``n`` rows, so a rank filter drops the rest of a
    large group early.
    """
    ranked = _first_rows(df, [group], [ordinal], _segment(ordinal), n, "_turn")
    keep = (
        df.groupBy(group)
        .agg(F.min(ordinal).alias("_first"))
        .orderBy("_first")
        .limit(groups)
    )
    picked = ranked.join(keep, group).orderBy("_turn", "_first").limit(n)
    # a turn has one row per group at most, so turns are the segments of the numbering
    return index_within(picked, [], ["_turn", "_first"], F.col("_turn"), "position").drop("_turn", "_first")


def _first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, n: int, name: str
) -> DataFrame:
    """First ``n`` rows per key with their rank; a large key never sits in one task."""
    return index_within(df, keys, order, segment, name).filter(F.col(name) < n)


def one_per_group(df: DataFrame, group: str, ordinal: str, last: bool = False) -> DataFrame:
    """First (or last) row of every group by order, without sorting whole groups."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, ordinal) if last else F.min_by(row, ordinal)
    return df.groupBy(group).agg(pick.alias("_r")).select("_r.*")


def even_groups(df: DataFrame, group: str, ordinal: str, n: int) -> DataFrame:
    """One row per group, then ``n`` groups spread evenly over first appearance."""
    first = one_per_group(df, group, ordinal)
    numbered = index_within(first, [], [ordinal], _segment(ordinal), "_pos")
    return _at_even_positions(numbered, [], "_pos", n).drop("_pos")


def _at_even_positions(df: DataFrame, keys: Sequence[str], position: str, n: int) -> DataFrame:
    """Rows at evenly spread positions; keys with fewer rows than ``n`` keep all rows."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(position) + 1).alias("_size"))
    wanted = sizes.select(
        *keys,
        F.explode(
            F.when(F.col("_size") <= n, F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).otherwise(
                F.array_distinct(even_positions(F.col("_size"), n))
            )
        ).alias(position),
    )
    return df.join(wanted, [*keys, position], "left_semi")


def decimate(points: DataFrame, n: int, count: int, point: str = "point_id") -> DataFrame:
    """Evenly spaced point ids out of ``count`` (a literal list, so it pushes down)."""
    ids = F.array_distinct(even_positions(F.lit(count), min(n, count)))
    return points.filter(F.array_contains(ids, F.col(point).cast("long")))


def resample_frames(df: DataFrame, keys: Sequence[str], frame: str, k: int) -> DataFrame:
    """Keep ``k`` evenly spread frames per key and number them again.

    Keys shorter than ``k`` give no rows (see ``short_sequences``).
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(frame) + 1).alias("_size")).filter(F.col("_size") >= k)
    wanted = sizes.select(
        *keys, F.posexplode(even_positions(F.col("_size"), k)).alias("new_frame", frame)
    )
    return df.join(wanted, [*keys, frame])


def short_sequences(df: DataFrame, keys: Sequence[str], frame: str, k: int) -> DataFrame:
    """Keys with fewer than ``k`` frames, which resampling rejects."""
    return df.groupBy(*keys).agg((F.max(frame) + 1).alias("frames")).filter(F.col("frames") < k)


def _hash_segment() -> Column:
    """65536 equal slices of the hash order."""
    return F.substring("_h", 1, 4)


def draw_hash(seed: Column | int, ident: Column) -> Column:
    """Hex digest that orders rows pseudo-randomly and identically on any engine."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat_ws(":", seed.cast("string"), ident.cast("string")).cast("binary"), 256)


def sample_exact(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniform without replacement, in id order."""
    return (
        df.withColumn("_h", draw_hash(seed, F.col(ident)))
        .orderBy("_h", ident)
        .limit(n)
        .drop("_h")
        .orderBy(ident)
    )


def sample_per_layer(df: DataFrame, layer: Sequence[str], ident: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per layer by hash rank."""
    hashed = df.withColumn("_h", draw_hash(seed, F.col(ident)))
    return _first_rows(hashed, layer, ["_h", ident], _hash_segment(), n, "_rank").drop("_h", "_rank")


def permuted(df: DataFrame, ident: str, seed: int, cycle: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``offset`` of every row in a seeded permutation (one per key, optionally per cycle)."""
    salt = F.lit(seed) if cycle is None else F.lit(seed) + cycle
    tagged = df.withColumn("_h", draw_hash(salt, F.col(ident)))
    return index_within(tagged, list(keys), ["_h", ident], _hash_segment(), "offset").drop("_h")


def cyclic_draw(items: DataFrame, ident: str, draws: DataFrame, index: str, seed: int, count: int) -> DataFrame:
    """Rows for draw indices: each cycle walks a new permutation of all ``count`` items.

    Cycles are replicated only as far as the draws reach; items and draws then meet
    on (cycle, offset), which is one row per draw and cannot skew.
    """
    keyed = draws.withColumn("cycle", F.floor(F.col(index) / F.lit(count))).withColumn(
        "offset", F.pmod(F.col(index), F.lit(count))
    )
    cycles = keyed.agg(F.max("cycle").alias("_top"))
    spread = items.join(F.broadcast(cycles)).withColumn(
        "cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top")))
    ).drop("_top")
    return keyed.join(permuted(spread, ident, seed, F.col("cycle"), ["cycle"]), ["cycle", "offset"])


def validation_draws(pairs: DataFrame, order: Sequence[str], segment: Column, count: int, batches: int, ranks: int) -> DataFrame:
    """Pairs walked in order by (batch * ranks + rank) modulo their number."""
    numbered = index_within(pairs, [], order, segment, "pair_index")
    draws = (
        pairs.sparkSession.range(batches * ranks)
        .select(
            F.floor(F.col("id") / ranks).alias("batch"),
            (F.col("id") % ranks).alias("rank"),
            (F.col("id") % count).alias("pair_index"),
        )
    )
    return draws.join(numbered, "pair_index")


def allowed_sample(cache: DataFrame, snapshot: DataFrame, wanted: str | None = None) -> DataFrame:
    """The wanted sample, or the first by order, among samples in both cache and snapshot."""
    both = cache.join(snapshot.select("sample_id"), "sample_id", "left_semi")
    if wanted is not None:
        return both.filter(F.col("sample_id") == wanted)
    return both.orderBy("ordinal").limit(1)


def base_records(samples: DataFrame) -> DataFrame:
    """Base row per scene; the last one wins when a scene has several."""
    return one_per_group(samples.filter(F.col("mode") == "base"), "base_scene_id", "ordinal", last=True)
