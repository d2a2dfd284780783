"""Frame-ordered operators: differences, runs, pooling, tracking, stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions.geometry import d, latent_frame, norm, window_start
from trackloom.functions.ordered import DEFAULT_BLOCK, gathered, index_within, running_min_before, with_adjacent
from trackloom.functions.quantiles import bounded_percentiles, percentiles
from trackloom.session import cut_lineage


def strictly_increasing(df: DataFrame, keys: Sequence[str], frame: str, time: str) -> DataFrame:
    """Per key: whether every time difference is positive."""
    stepped = with_adjacent(df.select(*keys, frame, time), keys, frame, [time])
    good = F.col(f"prev_{time}").isNull() | (F.col(time) > F.col(f"prev_{time}"))
    return stepped.groupBy(*keys).agg(F.bool_and(good).alias("increasing"))


def second_difference(
    df: DataFrame, keys: Sequence[str], frame: str, value: str, carry: Sequence[str] = (), block: int = DEFAULT_BLOCK
) -> DataFrame:
    """|x[t+1] - 2 x[t] + x[t-1]| on interior frames, as column ``second_difference``."""
    cols = [*keys, frame, value, *carry]
    near = with_adjacent(df.select(*cols), keys, frame, [value], back=1, ahead=1, block=block)
    change = F.abs(F.col(f"next_{value}") - F.lit(2.0) * F.col(value) + F.col(f"prev_{value}"))
    return near.withColumn("second_difference", change).filter("second_difference is not null")


def temporal_scores(diffs: DataFrame, group: Sequence[str], mask: str, value: str = "second_difference") -> DataFrame:
    """Mean on the object, on the background, overall, and the overall 95th percentile.

    Empty sides are NULL.  The percentile is the skew-safe exact one.
    """
    on = F.col(mask)
    means = diffs.groupBy(*group).agg(
        F.avg(F.when(on, F.col(value))).alias("object_mean"),
        F.avg(F.when(~on, F.col(value))).alias("background_mean"),
        F.avg(value).alias("global_mean"),
    )
    return means.join(percentiles(diffs, group, value, [0.95], ["global_p95"]), list(group))


def adjacent_difference(pixels: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Per (video, frame >= 1): mean absolute change and exact equality with the previous frame.

    Missing values are skipped. Whole numbers are added up before the one division, so the mean is the
    same in whatever order a cluster adds them.
    """
    near = with_adjacent(pixels, ["video", "y", "x"], "frame", list(channels))
    deltas = [F.abs(d(c) - d(f"prev_{c}")) for c in channels]
    change = sum((F.coalesce(x, F.lit(0.0)) for x in deltas), F.lit(0.0))
    known = F.sum(sum((x.isNotNull().cast("int") for x in deltas), F.lit(0)))
    same = F.lit(True)
    for c in channels:
        same = same & F.coalesce(F.col(c) == F.col(f"prev_{c}"), F.lit(True))
    return (
        near.filter(F.coalesce(*[F.col(f"prev_{c}") for c in channels]).isNotNull())
        .groupBy("video", "frame")
        .agg(F.try_divide(F.sum(change), known).alias("mae"), ((known > 0) & F.bool_and(same)).alias("identical"))
    )


def frame_stats(pixels: DataFrame) -> DataFrame:
    """Decoded-video statistics per video from (video, frame, y, x, r, g, b); missing values are neither dark nor bright."""
    rgb = ("r", "g", "b")
    values = [F.coalesce(d(c), F.lit(0.0)) for c in rgb]
    total = F.sum(sum(values[1:], values[0]))
    squares = F.sum(sum((v * v for v in values[1:]), values[0] * values[0]))
    known = F.sum(sum((F.col(c).isNotNull().cast("int") for c in rgb), F.lit(0)))
    dark = sum((F.coalesce(F.col(c) <= 2, F.lit(False)).cast("int") for c in rgb), F.lit(0))
    bright = sum((F.coalesce(F.col(c) >= 253, F.lit(False)).cast("int") for c in rgb), F.lit(0))
    count = F.count(F.lit(1)) * 3
    # Of whole numbers both products are exact, so nothing is lost in their difference.
    spread = known * squares - total * total
    per_frame = pixels.groupBy("video", "frame").agg(
        F.try_divide(F.sqrt(F.greatest(spread, F.lit(0.0))), known).alias("std"),
        (F.sum(dark) / count).alias("dark"),
        (F.sum(bright) / count).alias("bright"),
    )
    spatial = per_frame.groupBy("video").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("std").alias("spatial_std_min"),
        F.max("std").alias("spatial_std_max"),
        F.max("dark").alias("near_black_max"),
        F.max("bright").alias("near_white_max"),
    )
    # The quantiles read the changes twice; cut, both are the same numbers, and the pixels are compared once.
    changes = cut_lineage(adjacent_difference(pixels))
    return spatial.join(adjacent_stats(changes, ["video"], "mae", "identical"), "video", "left")


def adjacent_stats(changes: DataFrame, keys: Sequence[str], value: str, same: str) -> DataFrame:
    """Minimum, median, 95th percentile, maximum of per-frame changes and duplicate count.

    As in ``percentiles``, a value must come out the same whenever it is computed.
    """
    simple = changes.groupBy(*keys).agg(
        F.min(value).alias("adjacent_min"),
        F.max(value).alias("adjacent_max"),
        F.count_if(F.col(same)).alias("exact_duplicates"),
    )
    ranks = percentiles(changes, keys, value, [0.5, 0.95], ["adjacent_median", "adjacent_p95"])
    return simple.join(ranks, list(keys), "left")


def frame_psnr(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Mean absolute error and PSNR (8-bit peak) of two still frames, joined by pixel."""
    rgb = ("r", "g", "b")
    other = right.select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in rgb])
    deltas = [d(c) - d(f"_{c}") for c in rgb]
    mae = sum((F.abs(x) for x in deltas[1:]), F.abs(deltas[0])) / 3
    mse = sum((x * x for x in deltas[1:]), deltas[0] * deltas[0]) / 3
    out = left.join(other, [*keys, "y", "x"]).groupBy(*keys).agg(F.avg(mae).alias("mae"), F.avg(mse).alias("_mse"))
    psnr = F.when(F.col("_mse") > 0, F.lit(10.0) * F.log10(F.lit(255.0 * 255.0) / F.col("_mse")))
    return out.select(*keys, "mae", psnr.alias("psnr_db"))


def frame_median(pixels: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Per-pixel median over the frames of one video, truncated to an integer.

    A group holds one value per frame, and values are 0..255, so buffers are tiny.
    """
    return pixels.groupBy("video", "y", "x").agg(*[F.median(c).cast("int").alias(c) for c in channels])


def finite_runs(df: DataFrame, keys: Sequence[str], frame: str, ok: Column, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Maximal runs of at least two consecutive good frames: (keys, start, end, frames).

    A frame minus its position among good frames is constant inside a run.
    """
    keys = list(keys)
    good = df.filter(F.coalesce(ok, F.lit(False))).select(*keys, frame)
    ranked = index_within(good, keys, [frame], F.floor(F.col(frame) / F.lit(block)), "_pos")
    runs = ranked.groupBy(*keys, (F.col(frame) - F.col("_pos")).alias("_run")).agg(
        F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count(F.lit(1)).alias("frames")
    )
    return runs.filter("frames > 1").drop("_run")


def running_best(df: DataFrame, keys: Sequence[str], frame: str, value: str) -> DataFrame:
    """Rows whose value is strictly smaller than every earlier one."""
    seen = running_min_before(df, keys, frame, value)
    return seen.filter(F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))).drop("best_before")


def temporal_pool4(
    cells: DataFrame, keys: Sequence[str], values: Sequence[str], frame: str = "frame", how: str = "avg"
) -> DataFrame:
    """Frame 0 alone, then windows of four; absent cells count as zero in the mean."""
    latent = latent_frame(F.col(frame)).alias("latent")
    width = F.when(F.col("latent") == 0, F.lit(1.0)).otherwise(F.lit(4.0))
    grouped = cells.groupBy(*keys, latent)
    if how == "max":
        return grouped.agg(*[F.max(v).alias(v) for v in values])
    sums = grouped.agg(*[F.sum(d(v)).alias(v) for v in values])
    return sums.select(*keys, "latent", *[(F.col(v) / width).alias(v) for v in values])


def mask_hold(mask: DataFrame, latent: str = "latent", frame: str = "frame") -> DataFrame:
    """Every latent mask cell repeated over the video frames of its window."""
    start = window_start(F.col(latent))
    last = F.when(F.col(latent) == 0, start).otherwise(start + 3)
    return mask.withColumn(frame, F.explode(F.sequence(start, last))).drop(latent)


def occupancy_change(
    cells: DataFrame, keys: Sequence[str], pixel: Sequence[str], meta: DataFrame, frame: str = "frame"
) -> DataFrame:
    """Flip rate and IoU of active cells between adjacent frames.

    ``meta(keys..., frames, cells_total)``.  Each active cell is written once as the
    current and once as the previous frame's, so one aggregation replaces a self join.
    Frame pairs without any active cell have IoU 1 and flip rate 0.
    """
    keys = list(keys)
    role = F.explode(
        F.array(
            F.struct(F.col(frame).alias("f"), F.lit(1).alias("cur"), F.lit(0).alias("prev")),
            F.struct((F.col(frame) + 1).alias("f"), F.lit(0).alias("cur"), F.lit(1).alias("prev")),
        )
    )
    both = (
        cells.select(*keys, *pixel, role.alias("_r"))
        .groupBy(*keys, *pixel, F.col("_r.f").alias(frame))
        .agg(F.max("_r.cur").alias("cur"), F.max("_r.prev").alias("prev"))
    )
    per_frame = both.groupBy(*keys, frame).agg(
        F.count_if((F.col("cur") + F.col("prev")) == 2).alias("_inter"), F.count(F.lit(1)).alias("_union")
    )
    grid = meta.filter("frames > 1").select(
        *keys, "cells_total", F.explode(F.sequence(F.lit(1), F.col("frames").cast("int") - 1)).alias(frame)
    )
    joined = grid.join(per_frame, [*keys, frame], "left")
    inter, union = F.coalesce("_inter", F.lit(0)), F.coalesce("_union", F.lit(0))
    return joined.select(
        *keys,
        frame,
        ((union - inter) / F.col("cells_total")).alias("flip_rate"),
        F.when(union > 0, inter / union).otherwise(F.lit(1.0)).alias("iou"),
    )


def displacement_step(cells: DataFrame, keys: Sequence[str] = ("sample_id", "slot")) -> DataFrame:
    """Change of per-cell displacement between adjacent frames where both are usable.

    ``cells(keys..., frame, cy, cx, source, dx, dy, valid)``.  Per frame the mean and
    95th percentile over both components, then mean and 95th percentile over frames.
    """
    keys = list(keys)
    usable = cells.filter((F.col("source") > 0) & (F.col("valid") > 0)).select(*keys, "frame", "cy", "cx", "dx", "dy")
    previous = usable.select(
        *keys, (F.col("frame") + 1).alias("frame"), "cy", "cx", F.col("dx").alias("_dx"), F.col("dy").alias("_dy")
    )
    step = F.explode(F.array(F.abs(d("dx") - d("_dx")), F.abs(d("dy") - d("_dy"))))
    # A frame holds at most two values per grid cell, so the exact percentile is bounded.
    frames = (
        usable.join(previous, [*keys, "frame", "cy", "cx"])
        .select(*keys, "frame", step.alias("_s"))
        .groupBy(*keys, "frame")
        .agg(F.avg("_s").alias("mean_step"), bounded_percentiles("_s", [0.95])[0].alias("p95_step"))
    )
    return frames.groupBy(*keys).agg(
        F.avg("mean_step").alias("displacement_step_abs_mean"),
        bounded_percentiles("mean_step", [0.95])[0].alias("displacement_step_abs_p95"),
        bounded_percentiles("p95_step", [0.95])[0].alias("per_cell_displacement_abs_p95"),
    )


def radius_drift(points: DataFrame, keys: Sequence[str], xyz: Sequence[str] = ("wx", "wy", "wz")) -> DataFrame:
    """Distance of each point to its frame centroid, minus the same at frame 0.

    ``points(keys..., frame, point_id, xyz)``.
    """
    keys = list(keys)
    centre = points.groupBy(*keys, "frame").agg(*[F.avg(d(c)).alias(f"_m{c}") for c in xyz])
    radius = norm(*[d(c) - F.col(f"_m{c}") for c in xyz])
    measured = points.join(centre, [*keys, "frame"]).select(*keys, "frame", "point_id", radius.alias("radius"))
    start = measured.filter("frame = 0").select(*keys, "point_id", F.col("radius").alias("_r0"))
    return measured.join(start, [*keys, "point_id"]).withColumn("drift", F.abs(F.col("radius") - F.col("_r0"))).drop("_r0")


def track_metrics(points: DataFrame, times: DataFrame) -> DataFrame:
    """Per sample and slot: centre displacement, validity, shape drift, depth range, duration.

    ``points`` is the long track table; ``times(sample_id, frame, time_s)``.
    """
    keys = ["sample_id", "slot"]
    axes = ("wx", "wy", "wz")
    centre = points.groupBy(*keys, "frame").agg(*[F.avg(d(c)).alias(c) for c in axes])
    origin = centre.filter("frame = 0").select(*keys, *[F.col(c).alias(f"_{c}") for c in axes])
    moved = (
        centre.join(origin, keys)
        .groupBy(*keys)
        .agg(F.max(norm(*[F.col(c) - F.col(f"_{c}") for c in axes])).alias("max_center_displacement_m"))
    )
    depth = F.when(F.col("valid"), d("cz"))
    simple = points.groupBy(*keys).agg(
        F.avg(F.col("valid").cast("double")).alias("valid_ratio"),
        F.min(depth).alias("min_depth_m"),
        F.max(depth).alias("max_depth_m"),
    )
    drift = radius_drift(points, keys).groupBy(*keys).agg(F.max("drift").alias("max_rigid_shape_error_m"))
    span = times.groupBy("sample_id").agg((F.max("time_s") - F.min("time_s")).alias("duration_s"))
    return moved.join(simple, keys).join(drift, keys).join(span, "sample_id")


TRACK_SCHEMA = "video string, frame long, cx double, cy double, area double"


def track_candidates(
    candidates: DataFrame, seeds: DataFrame, gate: float = 150.0, seed_gate: float = 160.0, schema: str = TRACK_SCHEMA
) -> DataFrame:
    """Follow one object per video through per-frame candidates.

    ``candidates(video, frame, candidate_id, cx, cy, area)``; a frame without a
    detection has one row with NULL centre.  ``seeds(video, sx, sy)``.

    Each frame depends on the one before, so a video is walked in order.  Rows are
    shuffled by video, sorted on disk by Spark and streamed in Arrow batches; only
    the last two centres and the last area are kept, never the video.
    """
    rows = candidates.join(seeds, "video").select(
        "video", F.col("frame").cast("long").alias("frame"), "candidate_id", d("cx").alias("cx"), d("cy").alias("cy"), d("area").alias("area"), d("sx").alias("sx"), d("sy").alias("sy")
    )
    ordered = gathered(rows, "video").sortWithinPartitions("video", "frame", "candidate_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = FollowState(gate, seed_gate)
        pending: pd.DataFrame | None = None
        for batch in batches:
            if pending is not None:
                batch = pd.concat([pending, batch], ignore_index=True)
            if batch.empty:
                continue
            tail = (batch["video"] == batch["video"].iloc[-1]) & (batch["frame"] == batch["frame"].iloc[-1])
            pending = batch[tail]
            ready = batch[~tail]
            if len(ready):
                yield state.advance(ready)
        if pending is not None and len(pending):
            yield state.advance(pending)

    return ordered.mapInPandas(walk, schema)


class FollowState:
    """What the tracker remembers between frames: two centres, one area, one frame number."""

    def __init__(self, gate: float, seed_gate: float):
        self.gate, self.seed_gate = gate, seed_gate
        self.video: str | None = None
        self.restart()

    def restart(self) -> None:
        self.last: np.ndarray | None = None
        self.before: np.ndarray | None = None
        self.area = 0.0
        self.frame = -1

    def advance(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Walk whole frames; rows are sorted by video, frame and candidate."""
        out = self.walk(
            rows["video"].to_numpy(),
            rows["frame"].to_numpy(np.int64),
            rows[["cx", "cy"]].to_numpy(np.float32),
            rows["area"].to_numpy(np.float64),
            rows[["sx", "sy"]].to_numpy(np.float32),
        )
        return pd.DataFrame(out, columns=["video", "frame", "cx", "cy", "area"])

    def walk(self, video: np.ndarray, frame: np.ndarray, centres: np.ndarray, areas: np.ndarray, seeds: np.ndarray) -> list[tuple]:
        """The same over arrays: a tuple (video, frame, cx, cy, area) per frame."""
        usable = np.isfinite(centres).all(axis=1)
        changed = (frame[1:] != frame[:-1]) | (video[1:] != video[:-1])
        starts = np.concatenate(([0], np.flatnonzero(changed) + 1, [len(frame)]))
        out = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            if video[lo] != self.video:
                self.video = video[lo]
                self.restart()
            keep = usable[lo:hi]
            found = self.step(int(frame[lo]), centres[lo:hi][keep], areas[lo:hi][keep], seeds[lo])
            out.append((video[lo], int(frame[lo]), *found))
        return out

    def step(
        self, frame: int, centres: np.ndarray, areas: np.ndarray, seed: np.ndarray
    ) -> tuple[float | None, float | None, float]:
        if frame > self.frame + 1:
            self.area = 0.0
        self.frame = frame
        if self.last is None:
            aim, limit, known_area = seed, self.seed_gate, 0.0
        else:
            aim = self.last if self.before is None else self.last + (self.last - self.before)
            limit, known_area = self.gate, self.area
        gap = centres - aim
        distance = np.sqrt((gap * gap).sum(axis=1)).astype(np.float64)
        cost = distance.copy()
        if known_area > 0:
            cost += 3.0 * np.abs(np.log(np.maximum(areas, 1.0) / max(known_area, 1.0)))
        cost[distance > limit] = np.inf
        if not len(cost) or not np.isfinite(cost.min()):
            self.area = 0.0
            return None, None, 0.0
        best = int(np.argmin(cost))
        self.before, self.last = self.last, centres[best]
        self.area = float(areas[best])
        return float(centres[best][0]), float(centres[best][1]), self.area


def track_error(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """Pixel distance per (video, frame) where both positions are present and finite."""
    def present(a: str, b: str) -> Column:
        return F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)

    joined = observed.filter(present("cx", "cy")).join(reference.filter(present("u", "v")), ["video", "frame"])
    return joined.select("video", "frame", norm(d("cx") - d("u"), d("cy") - d("v")).alias("distance"))


def trajectory_report(observed: DataFrame, errors: DataFrame) -> DataFrame:
    """Coverage and distance statistics per video, rounded half-even like the report."""
    seen = F.col("cx").isNotNull() & ~F.isnan("cx")
    base = observed.groupBy("video").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(seen).alias("detected_frames"),
        F.bround(F.avg(seen.cast("double")), 6).alias("detection_coverage"),
    )
    stats = errors.groupBy("video").agg(
        F.bround(F.avg("distance"), 4).alias("mean_distance_px"),
        F.bround(F.sqrt(F.avg(F.col("distance") * F.col("distance"))), 4).alias("rmse_px"),
        F.bround(F.max("distance"), 4).alias("max_distance_px"),
    )
    ranks = percentiles(errors, ["video"], "distance", [0.5, 0.95], ["_m", "_p"]).select(
        "video", F.bround("_m", 4).alias("median_distance_px"), F.bround("_p", 4).alias("p95_distance_px")
    )
    return base.join(stats, "video", "left").join(ranks, "video", "left")


def report_samples(observed: DataFrame) -> DataFrame:
    """First, middle and last frame of every video."""
    sizes = observed.groupBy("video").agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select(
        "video",
        F.explode(
            F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("_n") / 2), F.col("_n") - 1))
        ).alias("frame"),
    )
    return observed.join(wanted, ["video", "frame"])
