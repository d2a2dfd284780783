"""Order-aware building blocks that never sort one whole key in one task.

A key (a video, a user, a scene) may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would put that share into a single task.  Here every
key is cut into segments by a monotone expression of its order column; rows are
sorted per (key, segment) and only one summary row per segment is carried across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DEFAULT_BLOCK = 4096


def _order(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition so that rows of equal ``keys`` share a partition, whatever comes before.

    A plain ``repartition(keys)`` above a join on the same keys is dropped as redundant; adaptive
    execution may then turn that join into a broadcast with local reads and the keys fall apart.
    Partitions of a hash of the keys are never those of a join.
    """
    return df.repartition(F.xxhash64(*keys))


def index_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    segment: Column,
    name: str = "frame",
) -> DataFrame:
    """Zero-based position of every row inside its key, in ``order``.

    ``segment`` must be non-decreasing along ``order`` (a day of a timestamp, an
    id divided by a block size, a hash prefix).  With no keys the numbering is
    global and only the per-segment counts meet in one task.  Keys and order columns
    must not be NULL.
    """
    keys = list(keys)
    tagged = df.withColumn("_seg", segment)
    local = tagged.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_seg").orderBy(*_order(order)))
    )
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_seg")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        local.join(offsets, [*keys, "_seg"])
        .withColumn(name, (F.col("_rn") + F.col("_off") - 1).cast("long"))
        .drop("_seg", "_rn", "_off")
        .select(*df.columns, name)
    )


def with_adjacent(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    columns: Sequence[str],
    back: int = 1,
    ahead: int = 0,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Attach ``prev_<c>`` (and ``next_<c>``) from the neighbouring row.

    ``frame`` must be dense within the key.  Rows on a block edge are copied into
    the neighbouring block first, so each (key, block) is self-contained and the
    work is one shuffle; the copies are dropped afterwards.
    """
    keys = list(keys)
    f = F.col(frame)
    home = F.floor(f / F.lit(block)).cast("long")
    targets = [home]
    if back:
        targets.append(F.when(F.pmod(f, F.lit(block)) == block - 1, home + 1))
    if ahead:
        targets.append(F.when((f % block == 0) & (f > 0), home - 1))
    spread = df.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    w = W.partitionBy(*keys, "_blk").orderBy(frame)
    extra = [F.lag(c).over(w).alias(f"prev_{c}") for c in columns] if back else []
    extra += [F.lead(c).over(w).alias(f"next_{c}") for c in columns] if ahead else []
    return (
        spread.select(*df.columns, "_blk", *extra)
        .filter(F.col("_blk") == home)
        .drop("_blk")
    )


def running_min_before(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: str,
    name: str = "best_before",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Smallest ``value`` over all earlier rows of the key (NULL on the first)."""
    keys = list(keys)
    tagged = df.withColumn("_blk", F.floor(F.col(frame) / F.lit(block)).cast("long"))
    inside = W.partitionBy(*keys, "_blk").orderBy(frame).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        tagged.groupBy(*keys, "_blk")
        .agg(F.min(value).alias("_m"))
        .select(*keys, "_blk", F.min("_m").over(before).alias("_carry"))
    )
    return (
        tagged.withColumn("_in", F.min(value).over(inside))
        .join(carried, [*keys, "_blk"])
        .withColumn(name, F.least("_in", "_carry"))
        .select(*df.columns, name)
    )


def even_positions(count: Column, wanted: int) -> Column:
    """``wanted`` positions spread evenly over ``0 .. count-1``.

    The step is computed once and multiplied, the last position is pinned, and
    ties round to even, which is the linspace-then-rint rule.
    """
    last = (count - 1).cast("double")
    if wanted == 1:
        return F.array(F.lit(0).cast("long"))
    step = last / F.lit(float(wanted - 1))
    inner = F.transform(
        F.sequence(F.lit(0), F.lit(wanted - 2)), lambda i: F.rint(i * step).cast("long")
    )
    return F.concat(inner, F.array(last.cast("long")))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, for any session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    fraction = (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")
    return (days * 86400 + seconds.cast("long")) * 1000000 + fraction


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    k: int,
    name: str = "rank",
    fan: int = 64,
    rounds: int = 3,
) -> DataFrame:
    """First ``k`` rows of every key in ``order``, ranked from 1.

    Up to the session's limit for ranked windows (1,000) Spark itself keeps the first rows of every task
    before it shuffles. Beyond it, rows are ranked inside their own partition first, and the first ``k``
    of ``fan`` partitions meet in each further round. Either way a key that holds most rows never sits in
    one task. ``order`` must be total for a reproducible choice; which partition a row comes from does not
    change the result.
    """
    keys, order = list(keys), _order(order)
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        rounds = 0
    out = df.withColumn("_part", F.spark_partition_id()) if rounds else df
    for _ in range(rounds):
        ranked = out.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
        out = ranked.filter(F.col("_r") <= k).withColumn("_part", F.floor(F.col("_part") / F.lit(fan)).cast("int")).drop("_r")
    ranked = out.drop("_part").withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(name) <= k)
