"""Point tracks: contract checks, identity colours, z-buffer and grid maps.

Long form:
``points(sample_id, frame, slot, point_id, wx, wy, wz, cx, cy, cz, u, v, depth, valid)``
``cameras(sample_id, frame | NULL for static, m 4x4, k 3x3)``
``meta(sample_id, frames, object_ids, width, height, metadata VARIANT, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C
from trackloom.functions import checks as K
from trackloom.functions import geometry as G
from trackloom.functions.ordered import even_positions
from trackloom.functions.quantiles import bounded_percentiles
from trackloom.operators.records import violations_of
from trackloom.operators.sequence import occupancy_change

XYZ_W, XYZ_C = ("wx", "wy", "wz"), ("cx", "cy", "cz")


def camera_per_frame(cameras: DataFrame, meta: DataFrame) -> DataFrame:
    """A static camera (NULL frame) repeated over its sample's frames."""
    moving = cameras.filter("frame is not null")
    fixed = cameras.filter("frame is null").drop("frame").join(meta.select("sample_id", "frames"), "sample_id")
    spread = fixed.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1))).drop("frames")
    return moving.unionByName(spread.select(*moving.columns))


def clip_range(metadata: Column) -> tuple[Column, Column]:
    start = F.coalesce(F.try_variant_get(metadata, "$.clip_start_m", "double"), F.lit(C.CLIP_START_M))
    end = F.coalesce(F.try_variant_get(metadata, "$.clip_end_m", "double"), F.lit(C.CLIP_END_M))
    return start, end


def validate_tracks(points: DataFrame, cameras: DataFrame, meta: DataFrame, initial: DataFrame) -> DataFrame:
    """Violations (sample_id, rule_id, message) of the track contract.

    ``meta`` carries sample_id, fields ARRAY, frames, time_s ARRAY, object_ids, width,
    height, metadata VARIANT; ``initial(sample_id, slot, point_id, ix, iy, iz)``.
    Point rules are booleans folded per sample in one pass over the points. T03 needs the readers'
    ``points.valid_binary``; points without that column have flags already.
    """
    declared = F.coalesce(
        F.try_variant_get("metadata", "$.schema", "string").rlike(C.TRACK_SCHEMA_PATTERN), F.lit(False)
    )
    start, end = clip_range(F.col("metadata"))
    # Everything known per frame is joined first, so the points are shuffled once.
    views = camera_per_frame(cameras, meta).join(
        meta.select("sample_id", "width", "height", declared.alias("declared"), start.alias("clip_start"), end.alias("clip_end")),
        "sample_id",
    )
    joined = points.join(views, ["sample_id", "frame"])
    w = tuple(G.d(c) for c in XYZ_W)
    c = tuple(G.d(x) for x in XYZ_C)
    u, v, depth = G.d("u"), G.d("v"), G.d("depth")
    moved = G.apply_rigid(F.col("m"), w)
    pu, pv, _ = G.project(F.col("k"), c)
    everything = F.lit(True)
    for x in (*w, *c, u, v, depth):
        everything = everything & K.finite(x)
    start_ok = (
        K.close(G.d("ix"), c[0], 1e-5, 1e-6) & K.close(G.d("iy"), c[1], 1e-5, 1e-6) & K.close(G.d("iz"), c[2], 1e-5, 1e-6)
    )
    first_frame = (
        points.filter("frame = 0")
        .join(initial, ["sample_id", "slot", "point_id"], "left")
        .groupBy("sample_id")
        .agg(F.bool_and(F.coalesce(start_ok, F.lit(False))).alias("T09"))
    )
    camera_ok = K.close(c[0], moved[0], 1e-4, 1e-5) & K.close(c[1], moved[1], 1e-4, 1e-5) & K.close(c[2], moved[2], 1e-4, 1e-5)
    track_ok = (c[2] <= 1e-6) | (K.close(u, pu, 1e-4, 1e-3) & K.close(v, pv, 1e-4, 1e-3))
    in_view = (c[2] > F.col("clip_start")) & (c[2] < F.col("clip_end")) & (pu >= 0) & (pu < F.col("width")) & (pv >= 0) & (pv < F.col("height"))
    per_point = {
        "T03": F.col("valid_binary") if "valid_binary" in points.columns else F.lit(True),
        "T04": K.close(depth, c[2], 1e-5, 1e-6),
        "T05": ~F.col("valid") | (depth > 1e-6),
        "T07": everything,
        "T16": ~F.col("declared") | camera_ok,
        "T17": ~F.col("declared") | track_ok,
        "T19": ~F.col("declared") | (F.col("valid") == in_view),
    }
    folded = joined.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("point_rows"),
        F.min("point_id").alias("_pmin"),
        F.max("point_id").alias("_pmax"),
        *[F.bool_and(F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in per_point.items()],
    )
    rotations = [[F.col("m")[i][j].cast("double") for j in range(3)] for i in range(3)]
    gram = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            dot = sum((rotations[i][x] * rotations[j][x] for x in range(1, 3)), rotations[i][0] * rotations[j][0])
            gram = gram & K.close(dot, F.lit(1.0 if i == j else 0.0), 1e-4, 1e-4)
    det = K.determinant3(F.col("m"))
    k = F.col("k")
    finite_m = F.lit(True)
    for i in range(4):
        for j in range(4):
            finite_m = finite_m & K.finite(F.col("m")[i][j].cast("double"))
    bottom = [F.col("m")[3][j].cast("double") for j in range(4)]
    homogeneous = F.lit(True)
    for j in range(4):
        homogeneous = homogeneous & (F.abs(bottom[j] - (1.0 if j == 3 else 0.0)) <= 1e-5)
    focal = (k[0][0] > 0) & (k[1][1] > 0)
    for j in range(3):
        focal = focal & (F.abs(k[2][j].cast("double") - (1.0 if j == 2 else 0.0)) <= 1e-6)
    camera_rules = cameras.groupBy("sample_id").agg(
        F.bool_and(F.coalesce(finite_m & homogeneous, F.lit(False))).alias("T10"),
        F.bool_and(F.coalesce(gram & K.close(F.abs(det), F.lit(1.0), 1e-4, 1e-4), F.lit(False))).alias("T11"),
        F.bool_and(F.coalesce(focal, F.lit(False))).alias("T12"),
        F.max(det).alias("_det"),
    )
    table = (
        meta.join(folded, "sample_id", "left").join(first_frame, "sample_id", "left").join(camera_rules, "sample_id", "left")
    )
    ids, times = F.col("object_ids"), F.col("time_s")
    n = F.size(ids)
    frames = F.col("frames")
    increasing = F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))),
        lambda i: F.coalesce(F.get(times, i) > F.get(times, i - 1), F.size(times) <= 1),
    )

    def meta_text(path: str) -> Column:
        return F.try_variant_get("metadata", path, "string")

    described = (
        (F.try_variant_get("metadata", "$.point_count", "int") == C.POINTS_PER_OBJECT)
        & (F.try_variant_get("metadata", "$.object_count", "int") == n)
        & (F.try_variant_get("metadata", "$.object_ids", "array<string>") == ids)
        & (meta_text("$.coordinate_frame_world") == C.WORLD_FRAME)
        & (meta_text("$.track_definition") == C.TRACK_DEFINITION)
        & (meta_text("$.visibility_definition") == C.VISIBILITY_DEFINITION)
    )
    frame_name = F.coalesce(meta_text("$.coordinate_frame_camera"), F.lit(C.CAMERA_FRAME)) == C.CAMERA_FRAME
    version = F.coalesce(meta_text("$.schema").rlike(C.TRACK_SCHEMA_PATTERN), F.lit(True))
    fields = F.size(F.array_except(F.array(*[F.lit(x) for x in C.TRACK_FIELDS]), F.col("fields"))) == 0
    shape = (
        (F.col("point_rows") == n * C.POINTS_PER_OBJECT * frames)
        & (F.col("_pmin") == 0)
        & (F.col("_pmax") == C.POINTS_PER_OBJECT - 1)
    )
    rules = [
        ("T01", fields, "required fields are missing"),
        ("T02", shape, "exactly 2048 points per object and frame are required"),
        ("T03", F.col("T03"), "a flag is neither 0 nor 1"),
        ("T04", F.col("T04"), "depth must equal camera z"),
        ("T05", F.col("T05"), "flagged point at or behind the camera"),
        ("T06", n.between(1, C.MAX_OBJECTS) & (F.size(F.array_distinct(ids)) == n), "object ids must be 1..3 and unique"),
        ("T07", F.col("T07") & F.forall(times, K.finite), "non-finite coordinates or times"),
        ("T08", (F.size(times) == frames) & increasing, "one rising time stamp per frame expected"),
        ("T09", F.col("T09"), "initial points must equal frame 0"),
        ("T10", F.col("T10"), "camera matrices must be finite homogeneous transforms"),
        ("T11", F.col("T11"), "camera rotations must be orthonormal"),
        ("T12", F.col("T12"), "focal lengths must be positive"),
        ("T13", (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") == F.rint("width")) & (F.col("height") == F.rint("height")), "image size must be integer and positive"),
        ("T14", F.col("metadata").isNotNull() & version & frame_name & (~declared | F.coalesce(described, F.lit(False))), "metadata does not describe the payload"),
        ("T15", ~declared | (F.col("_det") < 0), "camera handedness does not match"),
        ("T16", F.col("T16"), "camera points do not match the transform"),
        ("T17", F.col("T17"), "tracks do not match the projection"),
        ("T18", ~declared | ((start >= 0) & (start < end)), "clip range is invalid"),
        ("T19", F.col("T19"), "valid does not match view and clip"),
    ]
    return violations_of(table, ["sample_id"], rules)


def identity_scale(initial: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: x and y range and the 2nd/98th percentile of 1/z over positive depths.

    A sample has at most three objects of 2048 points, so the percentile is bounded.
    """
    good = initial.filter(K.finite(G.d("ix")) & K.finite(G.d("iy")) & K.finite(G.d("iz")) & (G.d("iz") > 1e-6))
    inverse = F.lit(1.0) / G.d("iz")
    q = bounded_percentiles(inverse, [0.02, 0.98])
    return good.groupBy(key).agg(
        F.min(G.d("ix")).alias("x_low"),
        F.max(G.d("ix")).alias("x_high"),
        F.min(G.d("iy")).alias("y_low"),
        F.max(G.d("iy")).alias("y_high"),
        q[0].alias("q_low"),
        q[1].alias("q_high"),
    )


def identity_colour(initial: DataFrame, scale: DataFrame, key: str = "sample_id") -> DataFrame:
    """Fixed colour of every point from its frame-0 (x, y, 1/z); zero when not anchored."""
    anchored = F.coalesce(
        K.finite(G.d("ix")) & K.finite(G.d("iy")) & K.finite(G.d("iz")) & (G.d("iz") > 1e-6), F.lit(False)
    )
    inverse = F.lit(1.0) / F.greatest(G.d("iz"), F.lit(1e-6))

    def channel(value: Column, low: str, high: str) -> Column:
        span = F.col(high) - F.col(low)
        unit = F.least(F.greatest((value - F.col(low)) / F.when(span > 1e-6, span), F.lit(0.0)), F.lit(1.0))
        return F.when(anchored, F.coalesce(unit, F.lit(0.5))).otherwise(F.lit(0.0)).cast("float")

    return (
        initial.join(scale, key, "left")
        .withColumn("anchored", anchored)
        .withColumn("r", channel(G.d("ix"), "x_low", "x_high"))
        .withColumn("g", channel(G.d("iy"), "y_low", "y_high"))
        .withColumn("b", channel(inverse, "q_low", "q_high"))
        .drop("x_low", "x_high", "y_low", "y_high", "q_low", "q_high")
    )


def track_centroid(points: DataFrame, how: str = "mean") -> DataFrame:
    """Per (sample, frame, slot) centre of track positions.

    ``mean`` ignores NaN positions, ``median`` takes valid points only (2048 at most).
    """
    keys = ["sample_id", "frame", "slot"]
    if how == "median":
        return points.filter("valid").groupBy(*keys).agg(F.median("u").alias("u"), F.median("v").alias("v"))
    def clean(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    return points.groupBy(*keys).agg(F.avg(clean("u")).alias("u"), F.avg(clean("v")).alias("v"))


def depth_scale(points: DataFrame, per_frame: bool = False) -> DataFrame:
    """1st percentile and span of valid depths per sample, or per (sample, slot, frame).

    Groups are one sample's contract size at most (frames x objects x 2048).
    """
    keys = ["sample_id", "slot", "frame"] if per_frame else ["sample_id"]
    good = points.filter(F.col("valid") & K.finite(G.d("depth")))
    q = bounded_percentiles(G.d("depth"), [0.01, 0.99])
    return good.groupBy(*keys).agg(
        q[0].alias("depth_low"), F.greatest(q[1] - q[0], F.lit(1e-6)).alias("depth_span")
    )


def splat(points: DataFrame, keys: Sequence[str], x: str, y: str, values: Sequence[str], width: int, height: int, how: str) -> DataFrame:
    """Round positions to cells, drop what falls outside, then mean or max per cell."""
    cell_x, cell_y = F.rint(x).cast("int"), F.rint(y).cast("int")
    inside = (cell_x >= 0) & (cell_x < width) & (cell_y >= 0) & (cell_y < height)
    fold = F.avg if how == "mean" else F.max
    return (
        points.filter(inside)
        .groupBy(*keys, cell_y.alias("cy"), cell_x.alias("cx"))
        .agg(*[fold(G.d(v)).cast("float").alias(v) for v in values])
    )


def splat_candidates(points: DataFrame, radius: int, width: int, height: int, x: str = "px", y: str = "py") -> DataFrame:
    """Each in-image pixel becomes its (2r+1)^2 neighbours that are still in the image."""
    offsets = F.array(
        *[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    )
    def inside(px: Column, py: Column) -> Column:
        return (px >= 0) & (px < width) & (py >= 0) & (py < height)

    spread = points.filter(inside(F.col(x), F.col(y))).withColumn("_o", F.explode(offsets))
    moved = spread.withColumn(x, F.col(x) + F.col("_o.dx")).withColumn(y, F.col(y) + F.col("_o.dy")).drop("_o")
    return moved.filter(inside(F.col(x), F.col(y)))


def zbuffer(candidates: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Nearest candidate per key by (depth, slot, point).

    One map-side combining aggregation; a static point uses slot -1 and wins exact ties.
    """
    order = F.struct(F.col("depth"), F.col("slot"), F.col("point_id"), *[F.col(c) for c in carry])
    best = candidates.groupBy(*keys).agg(F.min(order).alias("_w"))
    return best.select(*keys, "_w.depth", "_w.slot", "_w.point_id", *[f"_w.{c}" for c in carry])


def render_frames(
    pixels: DataFrame, radius: int, grid: tuple[int, int], preprocess: tuple[int, int]
) -> DataFrame:
    """Splat, z-buffer and cell means of whole frames, one Arrow call per (sample, frame).

    Same result as splat + ``zbuffer`` + ``cell_mean``.  A frame holds at most 3 x 2048
    dynamic and 8192 static points, so a group is small; splats and winning pixels stay
    inside the task and only the few occupied cells leave it.  ``px``/``py`` are rounded
    in-image pixels; ``r, g, b`` ride along.
    """
    width, height = preprocess
    gw, gh = grid
    offsets = np.arange(-radius, radius + 1)
    ox, oy = (a.ravel() for a in np.meshgrid(offsets, offsets))
    names = ("px", "py", "depth", "slot", "point_id", "r", "g", "b")
    schema = "sample_id string, slot int, frame int, cy int, cx int, r float, g float, b float, visible float"

    def render(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_numpy(zero_copy_only=False) for n in names}
        px = (cols["px"][:, None] + ox).ravel()
        py = (cols["py"][:, None] + oy).ravel()
        source = np.repeat(np.arange(len(cols["px"])), ox.size)
        keep = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        pixel, source = py[keep].astype(np.int64) * width + px[keep], source[keep]
        rank = np.lexsort((cols["point_id"][source], cols["slot"][source], cols["depth"][source], pixel))
        first = rank[np.unique(pixel[rank], return_index=True)[1]]
        first = first[cols["slot"][source[first]] >= 0]
        pixel, source = pixel[first], source[first]
        cy = np.clip(np.floor((pixel // width + 0.5) * gh / height), 0, gh - 1).astype(np.int64)
        cx = np.clip(np.floor((pixel % width + 0.5) * gw / width), 0, gw - 1).astype(np.int64)
        key, group = np.unique((cols["slot"][source] * gh + cy) * gw + cx, return_inverse=True)
        count = np.bincount(group, minlength=len(key))
        means = {c: np.bincount(group, cols[c][source].astype(np.float64), len(key)) / np.maximum(count, 1) for c in "rgb"}
        sample, frame = table.column("sample_id")[0].as_py(), table.column("frame")[0].as_py()
        return pa.table(
            {
                "sample_id": pa.array([sample] * len(key), pa.string()),
                "slot": pa.array(key // (gh * gw), pa.int32()),
                "frame": pa.array([frame] * len(key), pa.int32()),
                "cy": pa.array(key // gw % gh, pa.int32()),
                "cx": pa.array(key % gw, pa.int32()),
                **{c: pa.array(means[c], pa.float32()) for c in "rgb"},
                "visible": pa.array(np.ones(len(key)), pa.float32()),
            }
        )

    rows = pixels.select(
        "sample_id", F.col("frame").cast("int").alias("frame"), F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"),
        G.d("depth").alias("depth"), F.col("slot").cast("int").alias("slot"), F.col("point_id").cast("int").alias("point_id"), "r", "g", "b",
    )
    return rows.groupBy("sample_id", "frame").applyInArrow(render, schema)


def cell_mean(visible: DataFrame, keys: Sequence[str], colours: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean colour per occupied cell, visibility 1."""
    return (
        visible.groupBy(*keys)
        .agg(*[F.avg(G.d(c)).cast("float").alias(c) for c in colours])
        .withColumn("visible", F.lit(1.0).cast("float"))
    )


def project_static(static: DataFrame, cameras: DataFrame, meta: DataFrame) -> DataFrame:
    """Scene points given in the first camera, seen from every frame's camera.

    The join is on the sample, cameras being one row per frame.
    """
    per_frame = camera_per_frame(cameras, meta)
    first = per_frame.filter("frame = 0").select("sample_id", F.col("m").alias("_m0"))
    start, end = clip_range(F.col("metadata"))
    p = (G.d("x"), G.d("y"), G.d("z"))
    world = static.join(first, "sample_id").select(
        "sample_id", "point_id", *[c.alias(n) for c, n in zip(G.invert_rigid(F.col("_m0"), p), XYZ_W)]
    )
    cam = (
        world.join(per_frame, "sample_id")
        .join(meta.select("sample_id", "metadata"), "sample_id")
        .select("sample_id", "frame", "point_id", "k", "metadata", *[c.alias(n) for c, n in zip(G.apply_rigid(F.col("m"), tuple(F.col(c) for c in XYZ_W)), XYZ_C)])
    )
    u, v, _ = G.project(F.col("k"), tuple(F.col(c) for c in XYZ_C))
    z = F.col("cz")
    finite = K.finite(F.col("cx")) & K.finite(F.col("cy")) & K.finite(z)
    return cam.select(
        "sample_id", "frame", "point_id", u.alias("u"), v.alias("v"), z.alias("depth"), (finite & (z > start) & (z < end)).alias("valid")
    )


def pixel_position(preprocess: tuple[int, int], transform: str) -> tuple[Column, Column]:
    """Position of (u, v) in the preprocessed image; rows carry width and height."""
    if transform == "source_image":
        return G.d("u"), G.d("v")
    return G.cover_crop(G.d("u"), G.d("v"), (F.col("width"), F.col("height")), preprocess)


def selected_frames(points: DataFrame, frames: int, keep: int | None) -> DataFrame:
    """Evenly spread frames renumbered from zero; all frames when ``keep`` is None."""
    if keep is None:
        return points
    wanted = even_positions(F.lit(frames), keep)
    return points.withColumn("frame", F.array_position(wanted, F.col("frame").cast("long")).cast("int") - 1).filter("frame >= 0")


def identity_tracks(
    points: DataFrame,
    initial: DataFrame,
    meta: DataFrame,
    grid: tuple[int, int],
    preprocess: tuple[int, int],
    static: DataFrame | None = None,
    radius: int = 1,
    transform: str = "cover_center_crop",
    method: str = "arrow",
) -> DataFrame:
    """Identity map cells (sample_id, slot, frame, cy, cx, r, g, b, visible).

    All objects and static points compete at full preprocess resolution; only then
    are visible dynamic pixels averaged onto the grid.  ``static`` is the output of
    ``project_static``.  ``method`` is ``arrow`` (group per frame) or ``sql``.
    """
    pw, ph = preprocess
    # One join brings colour, anchor and image size to the points; colours then ride
    # through the z-buffer instead of being looked up afterwards.
    colours = (
        identity_colour(initial, identity_scale(initial))
        .filter("anchored")
        .select("sample_id", "slot", "point_id", "r", "g", "b")
        .join(meta.select("sample_id", "width", "height"), "sample_id")
    )
    usable = points.filter(F.col("valid") & K.finite(G.d("depth")) & (G.d("depth") > 1e-6))
    cols = ["sample_id", "frame", "slot", "point_id", "depth", "px", "py", "r", "g", "b"]

    def rounded(df: DataFrame) -> DataFrame:
        x, y = pixel_position(preprocess, transform)
        return (
            df.withColumn("depth", G.d("depth"))
            .withColumn("px", F.rint(x).cast("long"))
            .withColumn("py", F.rint(y).cast("long"))
            .filter((F.col("px") >= 0) & (F.col("px") < pw) & (F.col("py") >= 0) & (F.col("py") < ph))
            .select(*cols)
        )

    pixels = rounded(usable.join(colours, ["sample_id", "slot", "point_id"]))
    if static is not None:
        none = F.lit(None).cast("float")
        background = static.filter("valid").withColumns(
            {"slot": F.lit(-1), "point_id": F.lit(-1), "r": none, "g": none, "b": none}
        )
        pixels = pixels.unionByName(rounded(background.join(meta.select("sample_id", "width", "height"), "sample_id")))
    if method == "arrow":
        return render_frames(pixels, radius, grid, preprocess)
    # A point hidden at its own centre is hidden over its whole splat by the same
    # winner, so resolving centres first shrinks what the splats multiply.
    keys = ["sample_id", "frame", "py", "px"]
    centres = zbuffer(pixels, keys, ["r", "g", "b"])
    winners = zbuffer(splat_candidates(centres, radius, pw, ph), keys, ["r", "g", "b"])
    placed = winners.filter("slot >= 0").withColumns(
        {"cy": G.pixel_cell(F.col("py"), ph, grid[1]), "cx": G.pixel_cell(F.col("px"), pw, grid[0])}
    )
    return cell_mean(placed, ["sample_id", "slot", "frame", "cy", "cx"])


def dense_tracks(
    points: DataFrame,
    meta: DataFrame,
    grid: tuple[int, int],
    preprocess: tuple[int, int],
    depth_mode: str = "sequence",
    transform: str = "cover_center_crop",
    frames_keep: tuple[int, int] | None = None,
) -> DataFrame:
    """Sparse six-channel cells (sample_id, slot, frame, cy, cx, source, current, dx, dy, depth, valid).

    ``frames_keep`` is (frame count, frames to keep); depth is scaled over all frames.
    """
    gw, gh = grid
    pw, ph = preprocess
    keys = ["sample_id", "slot", "frame"]
    x, y = pixel_position(preprocess, transform)
    per_frame = depth_mode == "per_frame"
    scale = depth_scale(points, per_frame)
    known = meta.select("sample_id", "width", "height")
    if not per_frame:
        known = known.join(scale, "sample_id", "left")
    scaled = points.join(known, "sample_id").withColumn("x", x).withColumn("y", y)
    origin = scaled.filter("frame = 0").select(
        "sample_id", "slot", "point_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("valid").alias("valid0")
    )
    joined = scaled.join(origin, ["sample_id", "slot", "point_id"])
    if per_frame:
        joined = joined.join(scale, keys, "left")
    if frames_keep:
        joined = selected_frames(joined, *frames_keep)
    gx, gy = gw / pw, gh / ph
    prepared = (
        joined.withColumn("gx", F.col("x") * gx)
        .withColumn("gy", F.col("y") * gy)
        .withColumn("g0x", F.col("x0") * gx)
        .withColumn("g0y", F.col("y0") * gy)
        .withColumn("dx", (F.col("x") - F.col("x0")) / max(float(pw), 1.0))
        .withColumn("dy", (F.col("y") - F.col("y0")) / max(float(ph), 1.0))
        .withColumn("depth_n", F.lit(1.0) - F.least(F.greatest((G.d("depth") - F.col("depth_low")) / F.col("depth_span"), F.lit(0.0)), F.lit(1.0)))
        .withColumn("one", F.lit(1.0))
    )
    null = F.lit(None).cast("double")
    at_source = prepared.filter("valid0").select(
        *keys, F.col("g0x").alias("_x"), F.col("g0y").alias("_y"), F.col("one").alias("source"), null.alias("current"),
        F.when(F.col("valid"), F.col("dx")).alias("dx"), F.when(F.col("valid"), F.col("dy")).alias("dy"), null.alias("depth"),
    )
    at_current = prepared.filter("valid").select(
        *keys, F.col("gx").alias("_x"), F.col("gy").alias("_y"), null.alias("source"), F.col("one").alias("current"),
        null.alias("dx"), null.alias("dy"), F.col("depth_n").alias("depth"),
    )
    both = at_source.unionByName(at_current)
    cx, cy = F.rint("_x").cast("int"), F.rint("_y").cast("int")
    inside = (cx >= 0) & (cx < gw) & (cy >= 0) & (cy < gh)
    zero = F.lit(0.0)
    return (
        both.filter(inside)
        .groupBy(*keys, cy.alias("cy"), cx.alias("cx"))
        .agg(
            F.coalesce(F.max("source"), zero).cast("float").alias("source"),
            F.coalesce(F.max("current"), zero).cast("float").alias("current"),
            F.coalesce(F.avg("dx"), zero).cast("float").alias("dx"),
            F.coalesce(F.avg("dy"), zero).cast("float").alias("dy"),
            F.coalesce(F.avg("depth"), zero).cast("float").alias("depth"),
        )
        .withColumn("valid", F.col("current"))
    )


def validate_track_cells(cells: DataFrame, object_count: DataFrame) -> DataFrame:
    """Violations of identity-map cells: finiteness, range, binary visibility, clean background, empty slots."""
    tol = 1e-6
    values = [F.col(c) for c in ("r", "g", "b", "visible")]
    finite = F.lit(True)
    ranged = F.lit(True)
    for x in values:
        finite = finite & K.finite(x)
        ranged = ranged & (x >= -tol) & (x <= 1 + tol)
    binary = F.col("visible").isin(0.0, 1.0)
    clean = (F.col("visible") != 0) | ((F.abs("r") <= tol) & (F.abs("g") <= tol) & (F.abs("b") <= tol))
    empty = F.lit(True)
    for x in values:
        empty = empty & (F.abs(x) <= tol)
    joined = cells.join(object_count, "sample_id", "left")
    known = F.col("object_count").isNotNull()
    slots = ~known | (F.col("slot") < F.col("object_count")) | empty
    names = {
        "C00": (known, "no object count for the sample"),
        "C01": (finite, "non-finite values"),
        "C02": (ranged, "values must lie in [0, 1]"),
        "C03": (binary, "visibility must be binary"),
        "C04": (clean, "RGB must be zero outside visible cells"),
        "C05": (slots, "unused slots must be zero"),
    }
    folded = joined.groupBy("sample_id").agg(
        *[F.bool_and(F.coalesce(ok, F.lit(False))).alias(rule) for rule, (ok, _) in names.items()]
    )
    return violations_of(folded, ["sample_id"], [(r, F.col(r), m) for r, (_, m) in names.items()])


def motion_envelope(cells: DataFrame, meta: DataFrame, pool: bool = True) -> DataFrame:
    """Occupied cells of the source (frame 0) or the current frame, all slots merged.

    ``pool`` folds frames into latent windows of four.  ``meta(sample_id, frames)``.
    """
    seen = cells.filter("visible > 0").select("sample_id", "frame", "cy", "cx")
    source = seen.filter("frame = 0").drop("frame").join(meta.select("sample_id", "frames"), "sample_id")
    steps = F.sequence(F.lit(0), F.col("frames").cast("int") - 1)
    if pool:
        seen = seen.withColumn("frame", G.latent_frame(F.col("frame")))
        steps = F.sequence(F.lit(0), G.latent_frame(F.col("frames") - 1))
    everywhere = source.withColumn("frame", F.explode(steps)).select("sample_id", "frame", "cy", "cx")
    return everywhere.unionByName(seen).distinct()


def union_masks(masks: Sequence[DataFrame], keys: Sequence[str] = ("frame", "y", "x")) -> DataFrame:
    """Logical or of sparse masks on the same grid."""
    out = masks[0].select(*keys)
    for mask in masks[1:]:
        out = out.unionByName(mask.select(*keys))
    return out.distinct()


def object_cells(cells: DataFrame, meta: DataFrame, representation: str = "identity") -> DataFrame:
    """Per (sample, slot): active cells per frame, flip rate, IoU and identity range.

    ``meta(sample_id, slot, frames, cells_total)`` supplies the slots and the dense grid,
    so frames without any cell count as zero.
    """
    active = F.col("visible" if representation == "identity" else "current") > 0
    keys = ["sample_id", "slot"]
    on = cells.filter(active)
    per_frame = on.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_frame.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.max("_n").alias("_max"), F.min("_n").alias("_min"), F.count(F.lit(1)).alias("_seen")
    )
    change = occupancy_change(on, keys, ["cy", "cx"], meta)
    moves = change.groupBy(*keys).agg(
        F.avg("flip_rate").alias("_flip"), F.max("flip_rate").alias("_flipmax"), F.avg("iou").alias("_iou")
    )
    out = meta.join(counts, keys, "left").join(moves, keys, "left")
    zero = F.lit(0)
    result = [
        "sample_id",
        "slot",
        F.coalesce(F.col("_max") > 0, F.lit(False)).alias("slot_active"),
        (F.coalesce("_total", zero) / F.col("frames")).alias("active_cells_mean"),
        F.when(F.col("_seen") == F.col("frames"), F.col("_min")).otherwise(zero).alias("active_cells_min"),
        F.coalesce("_max", zero).alias("active_cells_max"),
        F.coalesce("_flip", F.lit(0.0)).alias("target_flip_rate_mean"),
        F.coalesce("_flipmax", F.lit(0.0)).alias("target_flip_rate_max"),
        F.coalesce("_iou", F.lit(1.0)).alias("target_iou_mean"),
    ]
    if representation == "identity":
        rgb = on.groupBy(*keys).agg(
            F.min(F.least("r", "g", "b")).alias("_lo"), F.max(F.greatest("r", "g", "b")).alias("_hi")
        )
        out = out.join(rgb, keys, "left")
        result += [
            F.coalesce("_lo", F.lit(0.0)).alias("identity_rgb_min"),
            F.coalesce("_hi", F.lit(0.0)).alias("identity_rgb_max"),
        ]
    return out.select(*result)
