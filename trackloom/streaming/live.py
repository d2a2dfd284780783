"""Structured Streaming forms of the metrics log, the tracker and record checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.records import validate_records
from trackloom.operators.sequence import TRACK_SCHEMA, FollowState, running_best

PROGRESS_SCHEMA = (
    "step long, mode string, axis string, total double, reconstruction double, response double, "
    "trajectory_center double, trajectory_distribution double, trajectory_velocity double, "
    "temporal_consistency double, lpips double, sigma double, grad_norm double, "
    "learning_rates map<string,double>"
)


def read_progress(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The append-only metrics log, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PROGRESS_SCHEMA).json(path)


def live_metrics(progress: DataFrame, value: str = "total", weight: str | None = None) -> DataFrame:
    """Weighted mean per mode and axis, with a counter of non-finite values as the alert.

    The state is one row per (mode, axis), so it stays small however long the log is.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    w = F.col(weight) if weight else F.lit(1.0)
    return progress.groupBy("mode", "axis").agg(
        (F.sum(F.when(finite, F.col(value) * w)) / F.greatest(F.sum(F.when(finite, w)), F.lit(1.0))).alias("metric"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~finite).alias("non_finite"),
        F.max("step").alias("last_step"),
    )


def best_so_far_writer(path: str, key: str = "mode", value: str = "total") -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends every row improving on all before it, by step within a batch.

    The rows of a batch go to ``path/batch=<id>`` and the best value of every key so far to
    ``path-best/<id>``, which the next batch reads alone. A replayed batch overwrites its own
    two folders and changes nothing else.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = running_best(batch.select(key, value, "step").filter(F.col(value).isNotNull()), [key], "step", value)
        now = batch.groupBy(key).agg(F.min(value).alias("_k"))
        if batch_id > 0:
            known = spark.read.schema(f"{key} string, _k double").parquet(f"{path}-best/{batch_id - 1}")
            fresh = fresh.join(known, key, "left").filter(F.col("_k").isNull() | (F.col(value) < F.col("_k"))).drop("_k")
            now = now.union(known).groupBy(key).agg(F.min("_k").alias("_k"))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        now.write.mode("overwrite").parquet(f"{path}-best/{batch_id}")

    return write


_ARRIVING = (("frame", np.int64), ("candidate_id", np.int64), *((c, np.float64) for c in ("cx", "cy", "area", "sx", "sy")))
MEMORY_SCHEMA = "video array<string>, lx array<double>, ly array<double>, bx array<double>, by array<double>, area array<double>, frame array<long>"


def live_tracker(candidates: DataFrame, gate: float = 150.0, seed_gate: float = 160.0, buckets: int = 4096) -> DataFrame:
    """Streaming tracker over ``candidates(video, frame, candidate_id, cx, cy, area, sx, sy)``.

    Between batches two centres, one area and the frame number of a video are kept. A call for every
    video would cost milliseconds each, so videos are hashed into ``buckets``: a call takes the arrived
    rows of one bucket, and its state holds one entry for each of the bucket's videos. A frame at or
    before the last one seen of its video gives a row without a centre and with ``late`` set; it does
    not move the track.
    """
    def follow(key: tuple, chunks: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        known = {row[0]: row[1:] for row in zip(*memory.get)} if memory.exists else {}
        # A micro-batch brings the newly arrived frames of some videos, not their history.
        # Frames at or before the last one seen cannot be inserted; they are given out as late.
        parts = [[c["video"].to_numpy(object), *(c[n].to_numpy(t) for n, t in _ARRIVING)] for c in chunks]
        video, frame, candidate, cx, cy, area, sx, sy = [np.concatenate(x) for x in zip(*parts)]
        codes, names = pd.factorize(video)
        order = np.lexsort((candidate, frame, codes))
        video, frame, area = video[order], frame[order], area[order]
        centres, seeds = (np.column_stack(c)[order].astype(np.float32) for c in ((cx, cy), (sx, sy)))
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        out = []
        for name, lo, hi in zip(names, [0, *ends], ends):
            state = FollowState(gate, seed_gate)
            state.video = name
            if name in known:
                lx, ly, bx, by, state.area, state.frame = known[name]
                state.last = None if lx is None else np.array([lx, ly], np.float32)
                state.before = None if bx is None else np.array([bx, by], np.float32)
            first = lo + int(np.searchsorted(frame[lo:hi], state.frame, "right"))
            out += [(name, f, None, None, 0.0, True) for f in np.unique(frame[lo:first]).tolist()]
            if first == hi:
                continue
            out += [(*r, False) for r in state.walk(video[first:hi], frame[first:hi], centres[first:hi], area[first:hi], seeds[first:hi])]
            last = (None, None) if state.last is None else tuple(float(v) for v in state.last)
            before = (None, None) if state.before is None else tuple(float(v) for v in state.before)
            known[name] = (*last, *before, float(state.area), int(state.frame))
        memory.update(tuple(list(c) for c in zip(*((k, *v) for k, v in known.items()))))
        yield pd.DataFrame(out, columns=["video", "frame", "cx", "cy", "area", "late"])

    bucketed = candidates.withColumn("_bucket", F.pmod(F.xxhash64("video"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(
        follow,
        outputStructType=f"{TRACK_SCHEMA}, late boolean",
        stateStructType=MEMORY_SCHEMA,
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def live_validation(lines: DataFrame, mode: str = "first") -> DataFrame:
    """Contract violations of manifest lines as they arrive (stateless)."""
    parsed = lines.select(
        F.lit(None).cast("long").alias("ordinal"), F.trim("value").alias("raw"), F.try_parse_json(F.trim("value")).alias("rec")
    ).filter(F.length("raw") > 0)
    return validate_records(parsed, mode)


def live_unique_samples(lines: DataFrame) -> DataFrame:
    """First arrival of each sample id; later copies are dropped by the state store.

    Sample ids are unique for the life of a manifest, so the state must cover all of it.
    """
    return lines.select(
        F.try_variant_get(F.try_parse_json(F.trim("value")), "$.sample_id", "string").alias("sample_id")
    ).filter("sample_id is not null").dropDuplicates(["sample_id"])
