"""Exact quantiles.

``percentile`` keeps every distinct value of a group in one buffer.  That is fine
for groups with a contract bound (a frame, a pixel, a sample's points) and is what
``bounded_percentiles`` uses.  ``percentiles`` is for keys of any size: a mergeable
sketch brackets each quantile, everything outside the brackets is counted, and only
the few distinct values inside a bracket are ranked.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom.session import cut_lineage

# The sketch is off by at most 1/ACCURACY of the rows, half the bracket margin. Its size is in proportion
# to ACCURACY; the values ranked are 4/ACCURACY of the rows for each quantile.
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
# A key with more rows is never gathered; there is at most one such key for so many rows.
LARGE = 100_000


def bounded_percentiles(value: str | Column, probs: Sequence[float]) -> Column:
    """Linear-interpolated quantiles of a group whose size has a contract bound."""
    return F.percentile(value, [float(p) for p in probs])


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    count: str | None = None,
) -> DataFrame:
    """One row per (non-NULL) key with exact linear-interpolated quantiles; NULLs are skipped.

    ``count`` names an extra column with the number of values of the key. The rows are read twice and must
    be the same both times: cut the lineage of values such as means, whose last bits follow the order in which a
    cluster adds them, or a value may slip out of the bracket that it was to be.
    """
    keys = list(keys)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    ranked = [float(probs[i]) for i in order]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    lows = [max(p - MARGIN, 0.0) for p in ranked]
    highs = [min(p + MARGIN, 1.0) for p in ranked]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lows + highs, ACCURACY).alias("_b"),
    )
    k = len(ranked)
    keyed = _attach(rows, cut_lineage(stats) if keys else stats, keys, "_n")
    # Number of brackets that end below the value, and whether the value is inside the next one.
    below = sum(
        (F.when(F.col("_b")[k + i] < F.col("_v"), 1).otherwise(0) for i in range(k)),
        F.lit(0),
    )
    inside = F.lit(False)
    for i in range(k):
        inside = inside | ((F.col("_b")[i] <= F.col("_v")) & (F.col("_v") <= F.col("_b")[k + i]))
    keyed = keyed.withColumn("_in", inside).withColumn(
        "_zone", below * 2 + F.col("_in").cast("int")
    )
    counted = keyed.groupBy(
        *keys, "_n", "_zone", F.when(F.col("_in"), F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = W.partitionBy(*keys).orderBy("_zone", "_v").rowsBetween(W.unboundedPreceding, 0)
    cumulative = counted.withColumn("_cum", F.sum("_c").over(w))
    picks = []

    def value_at(rank: Column) -> Column:
        # A rank just outside its bracket is the first or last value of the counted zone beside it.
        start = F.col("_cum") - F.col("_c")
        return F.min(F.when((start <= rank) & (rank < F.col("_cum")), F.when(rank == start, F.col("_lo")).otherwise(F.col("_hi"))))

    for i, p in enumerate(ranked):
        rank = F.lit(p) * (F.col("_n") - 1)
        picks.append(value_at(F.floor(rank)).alias(f"_l{i}"))
        picks.append(value_at(F.ceil(rank)).alias(f"_h{i}"))
    picked = cumulative.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, original in enumerate(order):
        rank = F.lit(ranked[i]) * (F.col("_n") - 1)
        part = rank - F.floor(rank)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append((low + (high - low) * part).alias(names[original]))
    if count:
        out.append(F.col("_n").alias(count))
    return picked.select(*keys, *out)


def _attach(rows: DataFrame, stats: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows with the one row of ``stats`` (checkpointed) of their key, whose ``count`` is its number of rows.

    Rows of large keys meet a broadcast and stay where they are; only those of small keys are shuffled by key.
    """
    if not keys:
        return rows.join(F.broadcast(stats))  # exactly one row
    large, small = stats.filter(F.col(count) > LARGE), stats.filter(F.col(count) <= LARGE)
    if large.isEmpty():
        return rows.join(stats, keys)
    found = rows.join(F.broadcast(large), keys)
    if small.isEmpty():
        return found
    return found.unionByName(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys))


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and max(1.4826 MAD, 0.001 |median|, 1e-6) per key."""
    keys = list(keys)
    mid = cut_lineage(percentiles(df, keys, value, [0.5], ["median"], "_values"))
    # NULL values have no deviation; without them the count of a key is that of its rows.
    spread = _attach(df.select(*keys, value).filter(F.col(value).isNotNull()), mid, keys, "_values").withColumn(
        "_dev", F.abs(F.col(value) - F.col("median"))
    )
    mad = percentiles(spread, keys, "_dev", [0.5], ["mad"])
    joined = mid.join(mad, keys) if keys else mid.join(F.broadcast(mad))
    return joined.select(
        *keys,
        "median",
        F.greatest(
            F.lit(1.4826) * F.col("mad"), F.abs("median") * F.lit(1e-3), F.lit(1e-6)
        ).alias("scale"),
    )


def trimmed_median(
    df: DataFrame, keys: Sequence[str], value: str, low: float = 0.15, high: float = 0.85
) -> DataFrame:
    """Median of the finite positive values inside the [low, high] quantile band.

    Groups with fewer than four usable values give no row.
    """
    keys = list(keys)
    good = df.select(*keys, F.col(value).alias("_r")).filter(
        F.col("_r").isNotNull()
        & ~F.isnan("_r")
        & (F.col("_r") > 0)
        & (F.col("_r") < F.lit(float("inf")))
    )
    edges = cut_lineage(percentiles(good, keys, "_r", [low, high], ["_lo", "_hi"], "_values").filter("_values >= 4"))
    kept = _attach(good, edges, keys, "_values").filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") <= F.col("_hi")))
    return percentiles(kept, keys, "_r", [0.5], ["scale"], "kept")
