"""Evaluation metrics over (sample, frame, cell, predicted, target, mask) tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.geometry import d
from trackloom.functions.ordered import DEFAULT_BLOCK, with_adjacent
from trackloom.functions.quantiles import percentiles

EPSILON = float(np.finfo(np.float32).eps)


def weighted_metrics(df: DataFrame, keys: Sequence[str], numerator: str, count: str) -> DataFrame:
    """sum(numerator) / max(sum(count), 1) per key; sums merge across workers."""
    return df.groupBy(*keys).agg(
        (F.sum(numerator) / F.greatest(F.sum(count), F.lit(1.0))).alias("metric"),
        F.sum(count).alias("weight"),
    )


def masked_mse(df: DataFrame, keys: Sequence[str], pred: str, target: str, mask: str) -> DataFrame:
    """sum(mask err^2) / max(sum(mask), 1)."""
    error = d(pred) - d(target)
    return df.groupBy(*keys).agg(
        (F.sum(d(mask) * error * error) / F.greatest(F.sum(d(mask)), F.lit(1.0))).alias("masked_mse")
    )


def balanced_weights(df: DataFrame, keys: Sequence[str], base: str, motion: str, share: float) -> DataFrame:
    """Per row weight giving the moving region a fixed share of the total.

    Totals are one pre-aggregated row per key joined back, not a window over the key.
    """
    front = F.when(F.col(motion) > 0, d(base)).otherwise(F.lit(0.0))
    back = F.when(F.col(motion) > 0, F.lit(0.0)).otherwise(d(base))
    totals = df.groupBy(*keys).agg(F.sum(front).alias("_f"), F.sum(back).alias("_b"), F.sum(d(base)).alias("_t"))
    weight = F.when((F.col("_f") == 0) | (F.col("_b") == 0), d(base)).otherwise(
        F.when(F.col(motion) > 0, d(base) * share * F.col("_t") / F.col("_f")).otherwise(
            d(base) * (1.0 - share) * F.col("_t") / F.col("_b")
        )
    )
    return df.join(totals, list(keys)).withColumn("weight", weight).drop("_f", "_b", "_t")


def response_error(
    df: DataFrame,
    keys: Sequence[str],
    low: tuple[str, str, str],
    high: tuple[str, str, str],
    response_mask: str | None = None,
    minimum_energy: float = 1e-3,
) -> DataFrame:
    """Error of the high-low change over the target's change energy.

    ``low`` and ``high`` name the (prediction, target, mask) columns of one joined row.
    """
    mask = d(low[2]) * d(high[2])
    if response_mask:
        mask = mask * d(response_mask)
    predicted, target = d(high[0]) - d(low[0]), d(high[1]) - d(low[1])
    sums = df.groupBy(*keys).agg(
        F.greatest(F.sum(mask), F.lit(1.0)).alias("_n"),
        F.sum((predicted - target) * (predicted - target) * mask).alias("_e"),
        F.sum(target * target * mask).alias("_t"),
    )
    return sums.select(
        *keys,
        ((F.col("_e") / F.col("_n")) / F.greatest(F.col("_t") / F.col("_n"), F.lit(minimum_energy))).alias(
            "response_error"
        ),
    )


def smooth_l1(difference: Column, beta: float) -> Column:
    size = F.abs(difference)
    return F.when(size < beta, F.lit(0.5) * size * size / F.lit(beta)).otherwise(size - F.lit(0.5 * beta))


def smooth_l1_delta(
    df: DataFrame, group: Sequence[str], cell: Sequence[str], frame: str, pred: str, target: str, beta: float = 0.05, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Mean smooth-L1 between adjacent-frame changes of prediction and target."""
    keys = [*group, *cell]
    near = with_adjacent(df.select(*keys, frame, pred, target), keys, frame, [pred, target], block=block)
    change = (d(pred) - d(f"prev_{pred}")) - (d(target) - d(f"prev_{target}"))
    return (
        near.filter(F.col(f"prev_{pred}").isNotNull())
        .groupBy(*group)
        .agg(F.avg(smooth_l1(change, beta)).alias("smooth_l1"))
    )


def js_terms(p: Column, q: Column) -> Column:
    """Half the two KL terms of one position against the midpoint, floored at float eps."""
    eps = F.lit(EPSILON)
    middle = (p + q) * F.lit(0.5)
    log_mid = F.log(F.greatest(middle, eps))
    left = p * (F.log(F.greatest(p, eps)) - log_mid)
    right = F.when(q > 0, q * (F.log(F.greatest(q, eps)) - log_mid)).otherwise(F.lit(0.0))
    return F.lit(0.5) * (left + right)


def js_divergence(df: DataFrame, keys: Sequence[str], frame: str, p: str, q: str) -> DataFrame:
    """Jensen-Shannon divergence summed over positions, averaged over frames."""
    per_frame = df.groupBy(*keys, frame).agg(F.sum(js_terms(d(p), d(q))).alias("_js"))
    return per_frame.groupBy(*keys).agg(F.avg("_js").alias("js"))


def abs_diff_stats(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str) -> DataFrame:
    """Mean, 95th percentile and maximum absolute difference; NULL where sizes differ."""
    keys = list(keys)
    left = a.select(*keys, *cell, d(value).alias("_a"))
    right = b.select(*keys, *cell, d(value).alias("_b"))
    joined = left.join(right, [*keys, *cell], "full")
    aligned = joined.groupBy(*keys).agg(
        F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("comparable"),
        F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("_mean"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("_max"),
    )
    ranks = percentiles(joined.withColumn("_d", F.abs(F.col("_a") - F.col("_b"))), keys, "_d", [0.95], ["_p95"])
    ok = F.col("comparable")
    return aligned.join(ranks, keys, "left").select(
        *keys,
        "comparable",
        F.when(ok, F.col("_mean")).alias("mean_abs_difference"),
        F.when(ok, F.col("_p95")).alias("p95_abs_difference"),
        F.when(ok, F.col("_max")).alias("max_abs_difference"),
    )


def loss_history(history: DataFrame, keys: Sequence[str], steps: str = "steps", component: str = "component", values: str = "values") -> DataFrame:
    """Final and maximum value of each loss component, and whether lengths match.

    ``history(keys..., component, steps, values ARRAY<DOUBLE>)``.
    """
    return history.select(
        *keys,
        component,
        (F.size(values) == F.col(steps)).alias("length_ok"),
        F.element_at(values, -1).alias("final_value"),
        F.array_max(values).alias("max_value"),
    )


def centred_unit(features: DataFrame, frame_keys: Sequence[str], vector: str, size: int) -> DataFrame:
    """Subtract the frame's mean feature and scale to unit length (floor 1e-6)."""
    frame_keys = list(frame_keys)
    means = features.groupBy(*frame_keys).agg(
        F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(size)]).alias("_mean")
    )
    shifted = F.zip_with(vector, "_mean", lambda a, b: a.cast("double") - b)
    length = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x))
    return (
        features.join(means, frame_keys)
        .withColumn("_c", shifted)
        .withColumn("_len", F.greatest(length, F.lit(1e-6)))
        .withColumn(vector, F.transform("_c", lambda x: x / F.col("_len")))
        .drop("_mean", "_c", "_len")
    )


def best_match(
    predicted: DataFrame, target: DataFrame, frame_keys: Sequence[str], cell: str, vector: str, mask: str
) -> DataFrame:
    """Highest cosine of every predicted cell against the frame's masked target tokens.

    Both sides are centred unit vectors.  A frame is one grid, so its token list is
    bounded by the grid; each task multiplies one frame's matrices and emits one row
    per predicted cell, never the pairs.
    """
    frame_keys = list(frame_keys)
    left = predicted.select(*frame_keys, cell, vector)
    # Renamed keys keep the two sides apart even when they come from one table.
    other = [f"_t{i}" for i in range(len(frame_keys))]
    right = target.filter(F.col(mask)).select(*[F.col(k).alias(o) for k, o in zip(frame_keys, other)], F.col(vector).alias("_token"))
    key_fields = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields if f.name in (*frame_keys, cell)
    )

    def match(queries: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
        out = queries[[*frame_keys, cell]].copy()
        if queries.empty or tokens.empty:
            return out.iloc[:0].assign(score=np.zeros(0))
        bank = np.vstack(tokens["_token"].to_numpy()).T
        out["score"] = (np.vstack(queries[vector].to_numpy()) @ bank).max(axis=1)
        return out

    grouped = left.groupBy(*frame_keys).cogroup(right.groupBy(*other))
    return grouped.applyInPandas(match, f"{key_fields}, score double")


def soft_centre(
    scores: DataFrame, frame_keys: Sequence[str], score: str, x: str, y: str, mask: str, temperature: float = 0.07
) -> DataFrame:
    """Expected coordinate under a softmax of scores, next to the mask's mean coordinate.

    One aggregation finds the maximum, one the sums; both merge map-side.
    """
    frame_keys = list(frame_keys)
    tops = scores.groupBy(*frame_keys).agg(F.max(score).alias("_top"))
    weight = F.exp((d(score) - F.col("_top")) / F.lit(temperature))
    on = F.col(mask)
    sums = (
        scores.join(tops, frame_keys)
        .withColumn("_w", weight)
        .groupBy(*frame_keys)
        .agg(
            (F.sum(F.col("_w") * d(x)) / F.sum("_w")).alias("pred_x"),
            (F.sum(F.col("_w") * d(y)) / F.sum("_w")).alias("pred_y"),
            F.avg(F.when(on, d(x))).alias("target_x"),
            F.avg(F.when(on, d(y))).alias("target_y"),
            F.bool_or(on).alias("valid"),
        )
    )
    return sums


def motion_errors(
    centres: DataFrame, distributions: DataFrame, sample: str = "sample_id", frame: str = "frame", beta: float = 0.05
) -> DataFrame:
    """Centre, occupancy and velocity errors per sample over valid frames.

    ``centres`` comes from ``soft_centre`` with frame 0 marked invalid;
    ``distributions(sample, frame, p, q)`` holds normalised mass per position.
    """
    coords = ("pred_x", "pred_y", "target_x", "target_y")
    valid = centres.withColumn("valid", F.col("valid") & (F.col(frame) > 0))
    near = with_adjacent(valid.select(sample, frame, "valid", *coords), [sample], frame, ["valid", *coords])
    position = (smooth_l1(F.col("pred_x") - F.col("target_x"), beta) + smooth_l1(F.col("pred_y") - F.col("target_y"), beta)) / 2

    def speed(axis: str) -> Column:
        return (F.col(f"pred_{axis}") - F.col(f"prev_pred_{axis}")) - (F.col(f"target_{axis}") - F.col(f"prev_target_{axis}"))

    velocity = (smooth_l1(speed("x"), beta) + smooth_l1(speed("y"), beta)) / 2
    both = F.col("valid") & F.coalesce("prev_valid", F.lit(False))
    moved = near.groupBy(sample).agg(
        F.avg(F.when(F.col("valid"), position)).alias("center"), F.avg(F.when(both, velocity)).alias("velocity")
    )
    mass = distributions.join(valid.filter("valid").select(sample, frame), [sample, frame], "left_semi")
    return moved.join(
        js_divergence(mass, [sample], frame, "p", "q").withColumnRenamed("js", "distribution"), sample, "left"
    )
