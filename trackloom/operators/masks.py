"""Pixel masks and depth holes: morphology, regions, completion, overlap.

A mask is a sparse set of pixels ``(keys..., y, x)``.  Morphology works on
horizontal runs, so a radius-r kernel costs 2r+1 rows per run instead of
(2r+1)^2 rows per pixel, and every sort group is one image row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom.functions import checks as K
from trackloom.functions import geometry as G
from trackloom.functions.quantiles import percentiles

Spans = Sequence[tuple[int, int]]


def square_spans(radius: int) -> list[tuple[int, int]]:
    """(row offset, half width) of a square kernel."""
    return [(dy, radius) for dy in range(-radius, radius + 1)]


def disc_spans(radius: float) -> list[tuple[int, int]]:
    """All offsets within a Euclidean distance."""
    top = math.floor(radius)
    return [(dy, math.floor(math.sqrt(radius * radius - dy * dy))) for dy in range(-top, top + 1)]


def ellipse_half_width(radius: Column, dy: Column) -> Column:
    """Half width of an elliptic kernel row, rounded half-even."""
    r = radius.cast("double")
    return F.rint(r * F.sqrt((r * r - dy * dy) / (r * r))).cast("int")


def row_runs(mask: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Maximal horizontal runs (keys..., y, x0, x1)."""
    rows = [*keys, "y"]
    w = W.partitionBy(*rows).orderBy("x")
    return (
        mask.select(*rows, "x", *carry)
        .withColumn("_run", F.col("x") - F.row_number().over(w))
        .groupBy(*rows, "_run", *carry)
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_run")
    )


def fill_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct pixels covered by possibly overlapping runs, without a distinct shuffle."""
    rows = [*keys, "y"]
    w = W.partitionBy(*rows).orderBy("x0", "x1").rowsBetween(W.unboundedPreceding, -1)
    fresh = runs.withColumn("_from", F.greatest("x0", F.coalesce(F.max("x1").over(w) + 1, F.col("x0"))))
    return fresh.filter(F.col("_from") <= F.col("x1")).select(
        *rows, F.explode(F.sequence("_from", "x1")).alias("x")
    )


def dilate(mask: DataFrame, keys: Sequence[str], spans: Spans, width: int, height: int) -> DataFrame:
    """Dilation by a kernel of row spans, clipped to the image (never wrapping)."""
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in spans])
    return _grow(row_runs(mask, keys), keys, kernel, width, height)


def _grow(runs: DataFrame, keys: Sequence[str], kernel: Column, width: int, height: int) -> DataFrame:
    moved = runs.withColumn("_k", F.explode(kernel)).select(
        *keys,
        (F.col("y") + F.col("_k.dy")).alias("y"),
        F.greatest(F.col("x0") - F.col("_k.hw"), F.lit(0)).alias("x0"),
        F.least(F.col("x1") + F.col("_k.hw"), F.lit(width - 1)).alias("x1"),
    )
    return fill_runs(moved.filter((F.col("y") >= 0) & (F.col("y") < height)), keys)


def erode(mask: DataFrame, keys: Sequence[str], radius: int, width: int, height: int) -> DataFrame:
    """Square erosion; outside the image counts as set, so the border does not erode."""
    def shrink(pixels: DataFrame, along: str, across: str, size: int) -> DataFrame:
        turned = pixels.select(*keys, F.col(across).alias("y"), F.col(along).alias("x"))
        runs = row_runs(turned, keys)
        low = F.when(F.col("x0") == 0, 0).otherwise(F.col("x0") + radius)
        high = F.when(F.col("x1") == size - 1, size - 1).otherwise(F.col("x1") - radius)
        kept = runs.select(*keys, "y", low.alias("_l"), high.alias("_h")).filter("_l <= _h")
        out = kept.select(*keys, F.col("y").alias(across), F.explode(F.sequence("_l", "_h")).alias(along))
        return out.select(*keys, "y", "x")

    return shrink(shrink(mask, "x", "y", width), "y", "x", height)


def mask_bounds(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inclusive row and column bounds per mask."""
    return mask.groupBy(*keys).agg(
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.count(F.lit(1)).alias("pixels"),
    )


def padded_box(bounds: DataFrame, width: int, height: int, fraction: float = 0.12, minimum: int = 8) -> DataFrame:
    """Half-open box around the mask, padded by a share of its extent and clipped."""
    extent = F.greatest(F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1)
    pad = F.greatest(F.lit(minimum), F.rint(extent * fraction).cast("int"))
    return bounds.withColumn("pad", pad).select(
        *bounds.columns,
        F.greatest(F.col("x_min") - F.col("pad"), F.lit(0)).alias("x0"),
        F.greatest(F.col("y_min") - F.col("pad"), F.lit(0)).alias("y0"),
        F.least(F.col("x_max") + F.col("pad") + 1, F.lit(width)).alias("x1"),
        F.least(F.col("y_max") + F.col("pad") + 1, F.lit(height)).alias("y1"),
    )


def expand_hole(
    mask: DataFrame, content: DataFrame, keys: Sequence[str], width: int, height: int, ratio: float = 0.15, low: int = 3, high: int = 32
) -> DataFrame:
    """Elliptic dilation by a share of each mask's extent, inside the content."""
    keys = list(keys)
    extent = F.greatest(F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1)
    radius = mask_bounds(mask, keys).select(
        *keys, F.least(F.greatest(F.rint(extent * ratio).cast("int"), F.lit(low)), F.lit(high)).alias("radius")
    )
    runs = row_runs(mask, keys).join(radius, keys)
    kernel = F.transform(
        F.sequence(-F.col("radius"), F.col("radius")),
        lambda dy: F.struct(dy.alias("dy"), ellipse_half_width(F.col("radius"), dy).alias("hw")),
    )
    grown = _grow(runs, keys, kernel, width, height)
    return grown.join(content.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def mask_iou(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intersection over union (denominator at least 1) per key, in one aggregation."""
    keys = list(keys)
    left = a.select(*keys, "y", "x", F.lit(1).alias("_s"))
    right = b.select(*keys, "y", "x", F.lit(2).alias("_s"))
    cells = left.unionByName(right).groupBy(*keys, "y", "x").agg(F.bit_or("_s").alias("_s"))
    return cells.groupBy(*keys).agg(
        F.count_if(F.col("_s") == 3).alias("intersection"),
        F.count(F.lit(1)).alias("union"),
    ).withColumn("iou", F.col("intersection") / F.greatest(F.col("union"), F.lit(1)))


def mask_algebra(pixels: DataFrame, key: str = "scene") -> DataFrame:
    """Violating pixel counts per rule and scene.

    ``pixels(scene, observed, completed, dense, hole, content, reliable, depth, raw_depth)``.
    """
    o, m, dn, h, c, r = (F.col(x) for x in ("observed", "completed", "dense", "hole", "content", "reliable"))
    depth, raw = F.col("depth"), F.col("raw_depth")
    rules = {
        "completion_replaces_observed": o & m,
        "dense_is_not_union": dn != (o | m),
        "dense_outside_content": dn & ~c,
        "hole_outside_content": h & ~c,
        "completion_outside_hole": m & ~h,
        "reliable_not_observed": r & ~o,
        "completed_depth_not_positive": m & ~F.coalesce(K.finite(depth) & (depth > 0), F.lit(False)),
        "depth_outside_completion": ~m & ~(F.coalesce(depth, F.lit(0.0)) == 0),
        "raw_depth_in_padding": ~c & ~(F.coalesce(raw, F.lit(0.0)) == 0),
        "raw_depth_not_positive": h & ~F.coalesce(K.finite(raw) & (raw > 0), F.lit(False)),
    }
    return pixels.groupBy(key).agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])


def split_scene(
    pixels: DataFrame, width: int, height: int, quantile: float, boundary: int = 2, key: str = "scene"
) -> tuple[DataFrame, DataFrame]:
    """Object and environment pixels without leaking object edges.

    ``pixels(scene, y, x, depth, confidence, px, py, pz, object, content)``.  Returns
    (pixels with object_core, environment, reliable flags, per-scene report).
    """
    keys = [key]
    mask = pixels.filter("object").select(key, "y", "x")
    core = erode(mask, keys, boundary, width, height).withColumn("_core", F.lit(True))
    near = dilate(mask, keys, square_spans(boundary), width, height).withColumn("_near", F.lit(True))
    finite = (
        K.finite(F.col("px")) & K.finite(F.col("py")) & K.finite(F.col("pz"))
        & K.finite(F.col("confidence")) & K.finite(F.col("depth")) & (F.col("depth") > 0) & F.col("content")
    )
    tagged = (
        pixels.join(core, [key, "y", "x"], "left")
        .join(near, [key, "y", "x"], "left")
        .withColumn("_ok", F.coalesce(finite, F.lit(False)))
        .withColumn("_env", F.col("_ok") & F.col("_near").isNull())
        .withColumn("_objcore", F.col("_ok") & F.col("_core").isNotNull())
        .withColumn("_objany", F.col("_ok") & F.col("object"))
    )
    sizes = tagged.groupBy(key).agg(F.count_if("_objcore").alias("_ncore"))
    chosen = tagged.join(sizes, key).withColumn(
        "_obj", F.when(F.col("_ncore") < 64, F.col("_objany")).otherwise(F.col("_objcore"))
    )
    env_cut = percentiles(chosen.filter("_env"), keys, "confidence", [quantile], ["confidence_threshold"])
    obj_cut = percentiles(chosen.filter("_obj"), keys, "confidence", [quantile], ["object_confidence_threshold"])
    cut = chosen.join(env_cut, key, "left").join(obj_cut, key, "left")
    out = cut.withColumn("environment", F.col("_env")).withColumn(
        "reliable", F.col("_env") & (F.col("confidence") >= F.col("confidence_threshold"))
    ).withColumn("object_core", F.col("_obj") & (F.col("confidence") >= F.col("object_confidence_threshold")))
    report = out.groupBy(key).agg(
        F.first("confidence_threshold").alias("confidence_threshold"),
        F.first("object_confidence_threshold").alias("object_confidence_threshold"),
        F.count_if("_ok").alias("finite_points"),
        F.count_if("environment").alias("environment_points"),
        F.count_if("object_core").alias("object_points"),
        F.count_if(F.col("_obj")).alias("object_candidates"),
        F.count_if(F.col("_ok") & ~F.col("object_core") & ~F.col("environment")).alias("omitted_boundary_points"),
    )
    problem = (
        F.when(F.col("finite_points") == 0, F.lit("no finite positive-depth points"))
        .when(F.col("environment_points") < 128, F.lit("too few environment points"))
        .when(F.col("object_candidates") < 32, F.lit("too few finite object points"))
        .when(F.col("object_points") < 32, F.lit("too few object points after filtering"))
    )
    flags = out.select(*pixels.columns, "object_core", "environment", "reliable")
    return flags, report.withColumn("problem", problem)


def prepare_hole(pixels: DataFrame, key: str = "scene") -> tuple[DataFrame, DataFrame]:
    """Known-depth and hole pixels inside the content rectangle, and per-scene problems.

    ``pixels(scene, y, x, depth, requested, content)``.
    """
    valid = F.coalesce(K.finite(F.col("depth")) & (F.col("depth") > 0), F.lit(False))
    flagged = pixels.withColumn("_valid", valid).withColumn(
        "hole", F.col("content") & (F.col("requested") | ~F.col("_valid"))
    ).withColumn("known", F.col("content") & ~F.col("hole") & F.col("_valid"))
    report = flagged.groupBy(key).agg(
        F.count_if("hole").alias("hole_pixels"),
        F.count_if("known").alias("known_pixels"),
        F.count_if("content").alias("content_pixels"),
        F.min(F.when(F.col("content"), F.col("y"))).alias("y0"),
        (F.max(F.when(F.col("content"), F.col("y"))) + 1).alias("y1"),
        F.min(F.when(F.col("content"), F.col("x"))).alias("x0"),
        (F.max(F.when(F.col("content"), F.col("x"))) + 1).alias("x1"),
    )
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    problem = (
        F.when(F.col("hole_pixels") < 32, F.lit("fewer than 32 hole pixels"))
        .when(F.col("known_pixels") < 128, F.lit("fewer than 128 known pixels"))
        .when(F.col("content_pixels") == 0, F.lit("content mask is empty"))
        .when(F.col("content_pixels") != area, F.lit("content is not one rectangle"))
    )
    cropped = flagged.filter("content").withColumn(
        "known_depth", F.when(F.col("hole"), F.lit(0.0).cast("float")).otherwise(F.col("depth"))
    )
    return cropped.drop("_valid"), report.withColumn("problem", problem)


def merge_known(reference: DataFrame, prediction: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Predicted depth only where a hole has a finite positive prediction; all else untouched.

    ``prediction(keys, y, x, predicted, hole)``.
    """
    on = [*keys, "y", "x"]
    joined = reference.join(prediction.select(*on, "predicted", "hole"), on, "left")
    use = F.coalesce(F.col("hole") & K.finite(F.col("predicted")) & (F.col("predicted") > 0), F.lit(False))
    return joined.withColumn("filled", use).withColumn(
        "depth", F.when(F.col("filled"), F.col("predicted")).otherwise(F.col("depth"))
    ).drop("predicted", "hole")


def known_depth_error(pixels: DataFrame, key: str = "scene") -> DataFrame:
    """Relative error of a prediction on known pixels, and how much of the hole it filled.

    ``pixels(scene, known_depth, predicted, hole)``.
    """
    known = ~F.col("hole") & K.finite(F.col("known_depth")) & (F.col("known_depth") > 0)
    error = F.abs(F.col("predicted") - F.col("known_depth")) / F.greatest(F.col("known_depth"), F.lit(1e-8))
    filled = F.col("hole") & K.finite(F.col("predicted")) & (F.col("predicted") > 0)
    tagged = pixels.withColumn("_e", F.when(known, error)).withColumn("_f", filled)
    counts = tagged.groupBy(key).agg(
        F.count("_e").alias("known_pixel_count"),
        F.count_if("hole").alias("requested_pixel_count"),
        F.count_if("_f").alias("positive_pixel_count"),
    ).withColumn(
        "positive_completion_fraction", F.col("positive_pixel_count") / F.greatest("requested_pixel_count", F.lit(1))
    )
    ranks = percentiles(tagged, [key], "_e", [0.5, 0.9], ["median_relative_error", "p90_relative_error"])
    return counts.join(ranks, key, "left")


def neighbour_min(pixels: DataFrame, keys: Sequence[str], radius: int = 8, tile: int = 128) -> DataFrame:
    """Smallest relative depth error of each completed pixel to observed neighbours.

    ``pixels(keys, y, x, depth, completed, reference, observed)``.  Pixels are cut into
    tiles with a halo of ``radius``; a task sees at most (tile + 2 radius)^2 pixels and
    slides the window in numpy, so no pixel pairs are ever shuffled.  Completed pixels
    without an observed neighbour give no row.
    """
    keys = list(keys)

    def reach(c: Column) -> Column:
        return F.array_distinct(
            F.transform(F.array(c - radius, c, c + radius), lambda v: F.floor(v / F.lit(tile)).cast("int"))
        )

    home_y, home_x = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    rows = pixels.filter("completed or observed").select(
        *keys, "y", "x", F.col("depth").cast("float").alias("depth"), "completed", F.col("reference").cast("float").alias("reference"), "observed"
    )
    spread = (
        rows.withColumn("_ty", F.explode(F.when(F.col("observed"), reach(F.col("y"))).otherwise(F.array(home_y))))
        .withColumn("_tx", F.explode(F.when(F.col("observed"), reach(F.col("x"))).otherwise(F.array(home_x))))
        .filter((F.col("_ty") >= 0) & (F.col("_tx") >= 0))
    )
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, "y", "x"]) + ", relative_error float"

    def slide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key[len(keys)], key[len(keys) + 1]
        side = tile + 2 * radius
        field = np.full((side, side), np.nan, dtype=np.float32)
        seen = pdf[pdf["observed"]]
        field[seen["y"] - ty * tile + radius, seen["x"] - tx * tile + radius] = seen["reference"]
        inner = pdf["completed"] & (pdf["y"] // tile == ty) & (pdf["x"] // tile == tx)
        wanted = pdf[inner]
        row = (wanted["y"] - ty * tile + radius).to_numpy()
        col = (wanted["x"] - tx * tile + radius).to_numpy()
        depth = wanted["depth"].to_numpy(np.float32)
        best = np.full(len(wanted), np.inf, dtype=np.float32)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if dy or dx:
                    other = field[row + dy, col + dx]
                    error = np.abs(depth - other) / np.maximum(other, np.float32(1e-8))
                    best = np.fmin(best, error)
        out = wanted[[*keys, "y", "x"]].copy()
        out["relative_error"] = best
        return out[np.isfinite(best)]

    return spread.groupBy(*keys, "_ty", "_tx").applyInPandas(slide, schema)


def seam_report(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel count, median and 90th percentile of seam errors; under 32 pixels is a problem."""
    keys = list(keys)
    counts = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixel_count"))
    ranks = percentiles(errors, keys, "relative_error", [0.5, 0.9], ["median_relative_error", "p90_relative_error"])
    return counts.join(ranks, keys).withColumn("enough", F.col("pixel_count") >= 32)


def complete_environment(pixels: DataFrame, cameras: DataFrame, key: str = "scene") -> DataFrame:
    """Completed environment pixels with their world points.

    ``pixels(scene, y, x, object, content, observed, reliable, hole, predicted, r, g, b)``;
    ``cameras(scene, k 3x3, extrinsic 4x4)``.  Only pixels that are content, not observed
    and validly predicted are completed; observed pixels are never replaced.
    """
    content = F.col("content")
    observed = F.col("observed") & content
    valid = F.coalesce(F.col("hole") & content & K.finite(F.col("predicted")) & (F.col("predicted") > 0), F.lit(False))
    flagged = (
        pixels.withColumn("observed", observed)
        .withColumn("reliable", F.col("reliable") & F.col("observed"))
        .withColumn("completed", content & ~F.col("observed") & valid)
        .withColumn("dense", F.col("observed") | F.col("completed"))
        .withColumn("completed_depth", F.when(F.col("completed"), F.col("predicted")).otherwise(F.lit(0.0)).cast("float"))
    )
    world = G.depth_to_world(G.d("x"), G.d("y"), G.d("predicted"), F.col("k"), F.col("extrinsic"))
    joined = flagged.join(cameras, key)
    for name, value in zip(("wx", "wy", "wz"), world):
        joined = joined.withColumn(name, F.when(F.col("completed"), value.cast("float")))
    return joined.drop("k", "extrinsic")


def mesh_depth_error(pixels: DataFrame, key: str = "scene") -> DataFrame:
    """Median absolute depth difference on the overlap, relative to the median object depth.

    ``pixels(scene, rendered, rendered_depth, object, depth)``.
    """
    good = K.finite(F.col("depth")) & (F.col("depth") > 0)
    overlap = pixels.filter(F.col("rendered") & F.col("object") & good).withColumn(
        "_e", F.abs(G.d("rendered_depth") - G.d("depth"))
    )
    error = percentiles(overlap, [key], "_e", [0.5], ["depth_error"])
    middle = percentiles(pixels.filter(F.col("object") & good), [key], "depth", [0.5], ["object_depth"])
    return middle.join(error, key, "left").withColumn(
        "relative_depth_error", F.col("depth_error") / F.col("object_depth")
    )


def object_mask_video(
    cells: DataFrame, meta: DataFrame, grid: tuple[int, int], video: tuple[int, int], dilation: int = 8
) -> DataFrame:
    """Video-size object mask (sample_id, frame, y, x) from envelope cells (frame, cy, cx).

    Nearest-neighbour enlargement: a pixel shows cell floor(x * cells / pixels).
    """
    gw, gh = grid
    vw, vh = video

    def covered(cell: Column, cells_n: int, pixels_n: int) -> tuple[Column, Column]:
        low = F.ceil(cell * pixels_n / F.lit(cells_n)).cast("int")
        high = F.ceil((cell + 1) * pixels_n / F.lit(cells_n)).cast("int") - 1
        return low, high

    x0, x1 = covered(F.col("cx"), gw, vw)
    y0, y1 = covered(F.col("cy"), gh, vh)
    runs = cells.select("sample_id", "frame", F.explode(F.sequence(y0, y1)).alias("y"), x0.alias("x0"), x1.alias("x1"))
    keys = ["sample_id", "frame"]
    if dilation <= 0:
        return fill_runs(runs, keys)
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in square_spans(dilation)])
    return _grow(runs, keys, kernel, vw, vh)


def points_in_mask(points: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """Share of valid projected points whose rounded pixel lies in the mask, per frame."""
    placed = points.filter("valid").select(
        "sample_id", "frame", F.rint(G.d("u")).cast("int").alias("x"), F.rint(G.d("v")).cast("int").alias("y")
    ).filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    hit = mask.select("sample_id", "frame", "y", "x", F.lit(1).alias("_hit"))
    return placed.join(hit, ["sample_id", "frame", "y", "x"], "left").groupBy("sample_id", "frame").agg(
        F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("containment")
    )


def mask_consistency(
    points: DataFrame, cells: DataFrame, mask: DataFrame, image: tuple[int, int], preprocess: tuple[int, int] = (832, 480), grid: tuple[int, int] = (52, 30)
) -> DataFrame:
    """Per sample: worst containment, worst cell precision, worst centroid distance.

    ``points`` and ``cells`` are those of the first object. Where it is hidden in a frame no cell lies
    outside the mask, so that frame's precision is 1.
    """
    keys = ["sample_id", "frame"]
    width, height = image
    inside = points_in_mask(points, dilate(mask, keys, square_spans(3), width, height), width, height)
    cx, cy = G.cover_crop(G.d("x"), G.d("y"), (F.lit(width), F.lit(height)), preprocess)
    gx = F.floor((cx + 0.5) * grid[0] / preprocess[0]).cast("int")
    gy = F.floor((cy + 0.5) * grid[1] / preprocess[1]).cast("int")
    latent = mask.select(*keys, gy.alias("y"), gx.alias("x")).filter(
        (F.col("x") >= 0) & (F.col("x") < grid[0]) & (F.col("y") >= 0) & (F.col("y") < grid[1])
    ).distinct()
    grown = dilate(latent, keys, square_spans(1), *grid).withColumn("_hit", F.lit(1))
    occupied = cells.filter("visible > 0").select(*keys, F.col("cy").alias("y"), F.col("cx").alias("x"))
    precision = occupied.join(grown, [*keys, "y", "x"], "left").groupBy(*keys).agg(
        F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("precision")
    )
    centre = mask.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    # One object's points in one frame: 2048 values at most.
    middle = points.filter("valid").groupBy(*keys).agg(F.median("u").alias("_u"), F.median("v").alias("_v"))
    offset = centre.join(middle, keys).select(*keys, G.norm(F.col("_mx") - F.col("_u"), F.col("_my") - F.col("_v")).alias("offset"))
    return (
        inside.join(precision, keys, "full").join(offset, keys, "full").groupBy("sample_id").agg(
            F.min("containment").alias("containment_min"),
            F.min(F.coalesce("precision", F.lit(1.0))).alias("cell_precision_min"),
            F.max("offset").alias("centroid_error_max_px"),
        )
    )


def foreground_mask(frames: DataFrame, background: DataFrame, threshold: float = 18.0) -> DataFrame:
    """Pixels whose grey value differs from the background by more than the threshold.

    Grey uses the usual 0.299/0.587/0.114 weights, rounded half to even; the difference is smoothed
    by a separable 5-tap binomial filter with mirrored borders. A frame's grey is rounded exactly, in
    thousandths of whole numbers; the background's is a sum of doubles in which what lies within their
    precision of a half counts as one.
    """
    grey = F.rint((299.0 * G.d("r") + 587.0 * G.d("g") + 114.0 * G.d("b")) / 1000.0)
    blend = 0.299 * G.d("r") + 0.587 * G.d("g") + 0.114 * G.d("b")
    half = (F.abs(blend) * 10.0) % 10.0 == 5.0
    back = background.select("video", "y", "x", F.when(half, F.rint(blend / 2.0) * 2.0).otherwise(F.rint(blend)).alias("_bg"))
    diff = frames.select("video", "frame", "y", "x", grey.alias("_g")).join(back, ["video", "y", "x"]).select(
        "video", "frame", "y", "x", F.abs(F.col("_g") - F.col("_bg")).alias("v")
    )
    size = diff.groupBy("video").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    smooth = diff.join(size, "video")
    for axis, top, other in (("x", "_mx", "y"), ("y", "_my", "x")):
        taps = [(-2, 1.0), (-1, 4.0), (0, 6.0), (1, 4.0), (2, 1.0)]
        # A source pixel near the border also feeds its mirror position.
        spread = smooth.withColumn("_t", F.explode(_mirror(F.col(axis), F.col(top), taps)))
        smooth = (
            spread.groupBy("video", "frame", other, F.col("_t.p").alias(axis), "_mx", "_my")
            .agg(F.sum(F.col("v") * F.col("_t.w")).alias("v"))
        )
    return smooth.filter(F.rint("v") > threshold).select("video", "frame", "y", "x")


def _mirror(pos: Column, top: Column, taps: Sequence[tuple[int, float]]) -> Column:
    """(target position, weight) pairs a pixel contributes to under a reflected border."""
    entries = []
    for offset, weight in taps:
        # Positions p with p + offset == pos, directly or reflected at 0 or at the far side.
        direct = pos - offset
        low = -pos - offset
        high = 2 * top - pos - offset
        entries.append(F.when((direct >= 0) & (direct <= top), F.struct(direct.alias("p"), F.lit(weight / 16.0).alias("w"))))
        entries.append(F.when((pos > 0) & (low >= 0) & (low <= top) & (low + offset < 0), F.struct(low.alias("p"), F.lit(weight / 16.0).alias("w"))))
        entries.append(F.when((pos < top) & (high >= 0) & (high <= top) & (high + offset > top), F.struct(high.alias("p"), F.lit(weight / 16.0).alias("w"))))
    return F.array_compact(F.array(*entries))


def opened_closed(mask: DataFrame, keys: Sequence[str], width: int, height: int, open_radius: int = 1, close_radius: int = 3) -> DataFrame:
    """Opening by a 3x3 square, then closing by a 7x7 square."""
    opened = dilate(erode(mask, keys, open_radius, width, height), keys, square_spans(open_radius), width, height)
    grown = dilate(opened, keys, square_spans(close_radius), width, height)
    return erode(grown, keys, close_radius, width, height)
