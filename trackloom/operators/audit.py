"""Round-trip audit of a track payload against its cached identity map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions import geometry as G
from trackloom.operators import raster


def unprojection_error(points: DataFrame, cameras: DataFrame, meta: DataFrame) -> DataFrame:
    """Largest distance after pixel -> camera and camera -> world, per sample."""
    joined = points.join(raster.camera_per_frame(cameras, meta), ["sample_id", "frame"])
    back = G.unproject(G.d("u"), G.d("v"), G.d("depth"), F.col("k"))
    back = tuple(c.cast("double") for c in back)
    camera = joined.withColumns({n: c for n, c in zip(("bx", "by", "bz"), back)})
    world = G.invert_rigid(F.col("m"), (F.col("bx"), F.col("by"), F.col("bz")))
    return camera.groupBy("sample_id").agg(
        F.max(G.norm(F.col("bx") - G.d("cx"), F.col("by") - G.d("cy"), F.col("bz") - G.d("cz"))).alias("unprojection_error"),
        F.max(G.norm(world[0] - G.d("wx"), world[1] - G.d("wy"), world[2] - G.d("wz"))).alias("world_error"),
    )


def rigid_drift(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Largest drift of body-frame coordinates from frame 0, and quaternion norm error.

    ``poses(sample_id, slot, frame, px..pz, qw..qz)``; the frame-0 side joins per point.
    """
    q = tuple(G.d(c) for c in ("qw", "qx", "qy", "qz"))
    rows = G.quaternion_matrix(q)
    joined = points.join(poses, ["sample_id", "slot", "frame"])
    delta = tuple(G.d(w) - G.d(p) for w, p in (("wx", "px"), ("wy", "py"), ("wz", "pz")))
    local = [rows[0][i] * delta[0] + rows[1][i] * delta[1] + rows[2][i] * delta[2] for i in range(3)]
    body = joined.select(
        "sample_id", "slot", "frame", "point_id", *[c.alias(f"l{i}") for i, c in enumerate(local)],
        F.abs(G.norm(*q) - 1.0).alias("_q"),
    )
    start = body.filter("frame = 0").select("sample_id", "slot", "point_id", *[F.col(f"l{i}").alias(f"s{i}") for i in range(3)])
    moved = body.join(start, ["sample_id", "slot", "point_id"])
    return moved.groupBy("sample_id").agg(
        F.max(G.norm(*[F.col(f"l{i}") - F.col(f"s{i}") for i in range(3)])).alias("rigid_drift"),
        F.max("_q").alias("quaternion_norm_error"),
    )


def colour_inverse_error(initial: DataFrame) -> DataFrame:
    """Largest error when colours are mapped back to coordinates inside the scale range."""
    scale = raster.identity_scale(initial)
    colours = raster.identity_colour(initial, scale).join(scale, "sample_id")
    inverse = F.lit(1.0) / F.greatest(G.d("iz"), F.lit(1e-6))
    errors = []
    for value, colour, low, high in (
        (G.d("ix"), "r", "x_low", "x_high"), (G.d("iy"), "g", "y_low", "y_high"), (inverse, "b", "q_low", "q_high")
    ):
        back = F.col(low) + G.d(colour) * (F.col(high) - F.col(low))
        errors.append(F.when((value >= F.col(low)) & (value <= F.col(high)), F.abs(back - value)))
    return colours.filter("anchored").groupBy("sample_id").agg(
        F.max(F.greatest(*[F.coalesce(e, F.lit(0.0)) for e in errors])).alias("colour_inverse_error")
    )


def cell_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample_id", "slot", "frame", "cy", "cx")) -> DataFrame:
    """Largest value difference and occupancy mismatches of two sparse maps per sample."""
    names = ("r", "g", "b", "visible")
    left = a.select(*keys, *[G.d(n).alias(f"_a{n}") for n in names])
    right = b.select(*keys, *[G.d(n).alias(f"_b{n}") for n in names])
    both = left.join(right, list(keys), "full")
    gaps = [F.abs(F.coalesce(f"_a{n}", F.lit(0.0)) - F.coalesce(f"_b{n}", F.lit(0.0))) for n in names]
    return both.groupBy("sample_id").agg(F.max(F.greatest(*gaps)).alias("map_error"), F.count_if(gaps[3] > 0).alias("occupancy_mismatch"))


def initial_error(scene_points: DataFrame, initial: DataFrame) -> DataFrame:
    """Largest distance between the scene's object points and the track's frame-0 points.

    ``scene_points(sample_id, slot, point_id, x, y, z)``.
    """
    joined = scene_points.join(initial, ["sample_id", "slot", "point_id"])
    gap = G.norm(G.d("x") - G.d("ix"), G.d("y") - G.d("iy"), G.d("z") - G.d("iz"))
    return joined.groupBy("sample_id").agg(F.max(gap).alias("initial_error"))


def occlusion_probe(
    points: DataFrame, initial: DataFrame, cameras: DataFrame, meta: DataFrame, grid: tuple[int, int], preprocess: tuple[int, int]
) -> DataFrame:
    """Frame 0 with a copy of the object in front (all must vanish) and behind (nothing may change)."""
    first = points.filter("frame = 0")

    def render(scale: float | None) -> DataFrame:
        static = None
        if scale is not None:
            copy = initial.select(
                "sample_id", (F.col("slot") * 100000 + F.col("point_id")).alias("point_id"),
                *[(G.d(c) * scale).alias(n) for c, n in (("ix", "x"), ("iy", "y"), ("iz", "z"))],
            )
            static = raster.project_static(copy, cameras, meta).filter("frame = 0")
        return raster.identity_tracks(first, initial, meta, grid, preprocess, static)

    base, near, far = render(None), render(0.5), render(2.0)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))

    changed = cell_difference(base, far).withColumnRenamed("map_error", "far_map_error").drop("occupancy_mismatch")
    return (
        meta.select("sample_id").join(count(base, "base_cells"), "sample_id", "left").join(count(near, "near_cells"), "sample_id", "left")
        .join(changed, "sample_id", "left").na.fill(0)
    )


def clock_error(meta: DataFrame, clock: DataFrame) -> DataFrame:
    """Largest gap between the stated times of a track and ``clock(sample_id, frame, t)``, as ``time_error``.

    A frame that only one of them has, or a time that is no number, is an infinite gap.
    """
    stated = meta.select("sample_id", F.posexplode("time_s").alias("frame", "_t"))
    both = stated.join(clock.select("sample_id", F.col("frame").cast("int").alias("frame"), F.col("t").cast("double").alias("_c")), ["sample_id", "frame"], "full")
    gap = F.abs(F.col("_t") - F.col("_c"))
    return both.groupBy("sample_id").agg(F.max(F.when(gap.isNull() | F.isnan(gap), F.lit(float("inf"))).otherwise(gap)).alias("time_error"))


def window_error(cells: DataFrame, pooled: DataFrame, values: Sequence[str] = ("r", "g", "b", "visible")) -> DataFrame:
    """Largest gap between a pooled map and the frames it stands for, as ``pool_error``.

    ``pooled`` has a ``latent`` index where ``cells`` have a frame: 0 is frame 0, l > 0 the mean of frames
    4 l - 3 to 4 l, absent cells being zero. Frames add their share of a window and the pooled cell is taken
    off; what is left is the error, in one aggregation and no join.
    """
    keys = ["sample_id", "slot", "latent", "cy", "cx"]
    latent = F.col("latent")
    own = cells.withColumn("latent", F.when(F.col("frame") == 0, 0).otherwise(F.floor((F.col("frame") + 3) / 4)).cast("int"))
    share = F.when(latent == 0, F.lit(1.0)).otherwise(F.lit(0.25))
    both = own.select(*keys, *[(G.d(v) * share).alias(v) for v in values]).unionByName(pooled.select(*keys[:2], latent.cast("int").alias("latent"), *keys[3:], *[(-G.d(v)).alias(v) for v in values]))
    left = both.groupBy(*keys).agg(*[F.abs(F.sum(v)).alias(v) for v in values])
    return left.groupBy("sample_id").agg(F.max(F.greatest(*values)).alias("pool_error"))


# check name, metric column, relation, limit
CHECKS = (
    ("raw_time", "time_error", "<", 1e-7),
    ("quaternion_norm", "quaternion_norm_error", "<", 1e-10),
    ("rigid_identity", "rigid_drift", "<", 5e-6),
    ("pixel_depth_inverse", "unprojection_error", "<", 1e-5),
    ("camera_inverse", "world_error", "<", 1e-5),
    ("scene_initial_identity", "initial_error", "<", 1e-6),
    ("unit_normals", "normal_unit_max_error", "<", 1e-4),
    ("environment_material_range", "materials_in_range", "true", None),
    ("identity_color_inverse", "colour_inverse_error", "<", 1e-5),
    ("independent_reference_raster", "map_error", "<", 2e-6),
    ("independent_reference_occupancy", "occupancy_mismatch", "<=", 0),
    ("source_mask_containment", "containment_min", ">=", 0.98),
    ("source_mask_centroid", "centroid_error_max_px", "<=", 16.0),
    ("latent_mask_alignment", "cell_precision_min", ">=", 0.95),
    ("temporal_window_semantics", "pool_error", "<", 1e-7),
    ("static_in_front_hides", "near_cells", "<=", 0),
    ("static_behind_changes_nothing", "far_map_error", "<=", 0.0),
)


def roundtrip_audit(samples: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """(sample_id, failures ARRAY, skipped ARRAY, passed) over all checks.

    ``parts`` are per-sample metric tables; all joins are on the sample. A check whose metric no
    part brings is listed as skipped, and a sample with skipped checks does not pass.
    """
    out = samples.select("sample_id")
    for part in parts:
        out = out.join(part, "sample_id", "left")
    tests: list[Column] = []
    skipped = [name for name, metric, _, _ in CHECKS if metric not in out.columns]
    for name, metric, relation, limit in CHECKS:
        if name not in skipped:
            value = F.col(metric)
            ok = value if relation == "true" else {"<": value < limit, "<=": value <= limit, ">=": value >= limit}[relation]
            tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return out.withColumns(
        {
            "failures": F.array_compact(F.array(*tests)),
            "skipped": F.array(*[F.lit(name) for name in skipped]).cast("array<string>"),
            "passed": (F.size(F.array_compact(F.array(*tests))) == 0) & F.lit(not skipped),
        }
    )
