"""Point clouds: layers, nearest neighbour, planes, support, components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom.functions import geometry as G
from trackloom.functions.quantiles import percentiles
from trackloom.operators.masks import dilate, disc_spans
from trackloom.operators.selection import permuted
from trackloom.session import cut_lineage

OBSERVED, COMPLETED, OBJECT = 0, 1, 2
LEAF_POINTS, MAX_LEVEL = 64, 30
SCORED = 4096
SHARD = 16


def compose_scene(observed: DataFrame, completed: DataFrame, objects: DataFrame) -> DataFrame:
    """Layers (scene, x, y, z, r, g, b) joined into one cloud with source and body ids."""
    def layer(df: DataFrame, source: int, body: int) -> DataFrame:
        return df.select(
            "scene", "x", "y", "z", "r", "g", "b", F.lit(source).alias("source"), F.lit(body).alias("body_id")
        )

    return (
        layer(observed, OBSERVED, 0).unionByName(layer(completed, COMPLETED, 0)).unionByName(layer(objects, OBJECT, 1))
    )


def layer_counts(cloud: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    return cloud.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("points"))


def scene_stats(points: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Material ranges and means, bounds, and points per body."""
    aggs = []
    for c in ("friction", "restitution"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    for c in ("x", "y", "z"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return points.groupBy(*keys, "body").agg(F.count(F.lit(1)).alias("points"), *aggs)


def normals_and_materials(points: DataFrame, key: str = "scene") -> DataFrame:
    """Largest deviation from unit normals, material ranges, and the verdicts."""
    off = F.abs(G.norm(G.d("nx"), G.d("ny"), G.d("nz")) - 1.0)
    env = F.col("body") == 0
    return points.groupBy(key).agg(
        F.max(off).alias("normal_unit_max_error"),
        F.min(F.when(env, F.col("friction"))).alias("friction_min"),
        F.min(F.when(env, F.col("restitution"))).alias("restitution_min"),
        F.max(F.when(env, F.col("restitution"))).alias("restitution_max"),
    ).withColumn("unit_normals", F.col("normal_unit_max_error") < 1e-4).withColumn(
        "materials_in_range", (F.col("friction_min") >= 0) & (F.col("restitution_min") >= 0) & (F.col("restitution_max") <= 1)
    )


def robust_ranges(points: DataFrame, keys: Sequence[str], axes: Sequence[str], low: float, high: float, pad: float = 0.0) -> DataFrame:
    """Equal-aspect display ranges: quantile centre, widest half-range on every axis."""
    keys = list(keys)
    # One row per axis value lets a single quantile pass serve all axes.
    long = points.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), G.d(a).alias("v")) for a in axes])).alias("_e")
    ).select(*keys, "_e.axis", "_e.v")
    q = percentiles(long, [*keys, "axis"], "v", [low, high], ["_l", "_h"])
    edges = []
    for a in axes:
        on = F.col("axis") == a
        edges += [F.max(F.when(on, F.col("_l"))).alias(f"_{a}l"), F.max(F.when(on, F.col("_h"))).alias(f"_{a}h")]
    out = q.groupBy(*keys).agg(*edges)
    radius = F.greatest(*[(F.col(f"_{a}h") - F.col(f"_{a}l")) / 2 for a in axes]) * (1.0 + pad)
    result = out.withColumn("_r", radius)
    ranges = []
    for a in axes:
        centre = (F.col(f"_{a}l") + F.col(f"_{a}h")) / 2
        ranges += [(centre - F.col("_r")).alias(f"{a}_from"), (centre + F.col("_r")).alias(f"{a}_to")]
    return result.select(*keys, *ranges)


def plane_distance(points: DataFrame, planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed distance of each point to each plane of its scene.

    ``planes(keys, plane, a, b, c, d)`` holds a handful per scene; the join is on the
    scene and normals are scaled to unit length.
    """
    size = F.greatest(G.norm(F.col("a"), F.col("b"), F.col("c")), F.lit(1e-12))
    unit = planes.select(*keys, "plane", *[(F.col(c) / size).alias(c) for c in ("a", "b", "c", "d")])
    distance = F.col("a") * G.d("x") + F.col("b") * G.d("y") + F.col("c") * G.d("z") + F.col("d")
    return points.join(unit, list(keys)).withColumn("distance", distance)


def extent_of(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Diagonal of the bounding box."""
    span = [F.max(G.d(c)) - F.min(G.d(c)) for c in ("x", "y", "z")]
    return points.groupBy(*keys).agg(F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]).alias("extent"))


def support_relation(points: DataFrame, planes: DataFrame, keys: Sequence[str], support: DataFrame | None = None) -> DataFrame:
    """The plane an object rests on, per scene.

    Distances are oriented so that the mesh median is positive.  The nearest plane
    wins, planes cutting the bulk being pushed back by the object's extent.
    ``support`` (at least 64 points) replaces the mesh for the contact distances.
    """
    keys = list(keys)
    on = [*keys, "plane"]
    extent = extent_of(points, keys)
    mesh = plane_distance(points, planes, keys)
    mesh_q = percentiles(mesh, on, "distance", [0.005, 0.5, 0.995], ["_m_lo", "_m_mid", "_m_hi"])
    basis = mesh_q
    contact = mesh
    if support is not None:
        sizes = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 64").select(*keys)
        chosen = support.join(sizes, keys, "left_semi").select(*keys, "x", "y", "z")
        rest = points.join(sizes, keys, "left_anti").select(*keys, "x", "y", "z")
        contact = plane_distance(chosen.unionByName(rest), planes, keys)
    q = percentiles(
        contact, on, "distance", [0.005, 0.05, 0.5, 0.95, 0.995], ["_lo", "_near_lo", "_mid", "_near_hi", "_hi"]
    )
    joined = basis.join(q, on).join(extent, keys).join(planes, on)
    side = F.when(F.col("_m_mid") >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    up = F.col("side") > 0
    size = F.greatest(G.norm(F.col("a"), F.col("b"), F.col("c")), F.lit(1e-12))
    measured = (
        joined.withColumn("side", side)
        .withColumn("lower", F.when(up, F.col("_lo")).otherwise(-F.col("_hi")))
        .withColumn("near", F.when(up, F.col("_near_lo")).otherwise(-F.col("_near_hi")))
        .withColumn("middle", F.col("_mid") * F.col("side"))
        .withColumn("mesh_lower", F.when(up, F.col("_m_lo")).otherwise(-F.col("_m_hi")))
        .withColumn("cuts", F.col("middle") < F.col("extent") * 0.03)
        .withColumn("cost", F.abs("near") + F.when(F.col("cuts"), F.col("extent")).otherwise(0.0))
    )
    fields = F.struct(
        "plane", "lower", "near", "middle", "mesh_lower", "cuts", "extent",
        *[(F.col(c) / size * F.col("side")).alias(f"n{c}") for c in ("a", "b", "c", "d")],
    )
    best = measured.groupBy(*keys).agg(F.min_by(fields, F.struct("cost", "plane")).alias("_b")).select(*keys, "_b.*")
    tolerance = F.greatest(F.col("extent") * 0.004, F.lit(1e-6))
    status = (
        F.when(F.col("cuts"), F.lit("support_plane_intersects_object_bulk"))
        .when(F.col("lower") >= -F.col("tolerance"), F.lit("observed_clear"))
        .otherwise(F.lit("observed_depth_boundary_uncertain"))
    )
    resolved = best.withColumn("tolerance", tolerance).withColumn("status", status).withColumn("resolved", ~F.col("cuts")).drop("cuts")
    scenes = points.select(*keys).distinct()
    return scenes.join(resolved, keys, "left").withColumn(
        "status", F.coalesce("status", F.lit("no_environment_plane"))
    ).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def shift_to_support(points: DataFrame, relation: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rigid shift along the oriented normal until the object clears the plane.

    Returns (shifted points, per-scene report); safe when the shift is at most a tenth
    of the extent.  Scenes without a plane stay as they are and are not safe.
    """
    keys = list(keys)
    plane = relation.select(*keys, "na", "nb", "nc", "nd", "tolerance")
    joined = points.join(plane, keys, "left")
    distance = F.col("na") * G.d("x") + F.col("nb") * G.d("y") + F.col("nc") * G.d("z") + F.col("nd")
    lower = percentiles(joined.withColumn("_d", distance), keys, "_d", [0.005], ["lower"])
    extent = extent_of(points, keys)
    report = extent.join(plane, keys, "left").join(lower, keys, "left")
    required = F.greatest(F.col("tolerance") - F.col("lower"), F.lit(0.0))
    size = F.greatest("extent", F.lit(1e-8))
    report = (
        report.withColumn("translation", F.coalesce(required, F.lit(0.0)))
        .withColumn("safe", F.coalesce(F.col("translation") <= size * 0.10, F.lit(False)) & F.col("na").isNotNull())
        .withColumn("fraction_of_extent", F.col("translation") / size)
        .withColumn(
            "status",
            F.when(F.col("na").isNull(), F.lit("unmodified_no_support_plane"))
            .when(F.col("translation") > 0, F.lit("support_translated"))
            .otherwise(F.lit("unmodified_clear")),
        )
    )
    move = report.select(*keys, "translation", "na", "nb", "nc")
    shifted = points.join(move, keys)
    for axis, n in (("x", "na"), ("y", "nb"), ("z", "nc")):
        shifted = shifted.withColumn(axis, G.d(axis) + F.coalesce(F.col(n), F.lit(0.0)) * F.col("translation"))
    return shifted.select(*points.columns), report.drop("na", "nb", "nc", "nd", "tolerance")


def local_band(pixels: DataFrame, width: int, height: int, key: str = "scene") -> DataFrame:
    """Reliable environment pixels in a ring around the object (2 px to 7.5 % of the short side)."""
    outer = max(18, int(round(min(height, width) * 0.075)))
    mask = pixels.filter("object").select(key, "y", "x")
    ring = dilate(mask, [key], disc_spans(outer), width, height).join(
        dilate(mask, [key], disc_spans(2), width, height), [key, "y", "x"], "left_anti"
    )
    return pixels.filter("reliable").join(ring, [key, "y", "x"], "left_semi")


def fit_planes(points: DataFrame, key: str, ident: str, planes: int = 3, seed: int = 0, trials: int = 1600, minimum: int = 160, least: int = 100) -> DataFrame:
    """Up to ``planes`` dominant planes per scene by seeded triples, each refitted to its inliers.

    Every scene gets all ``trials``, however few points it has: a corner of a trial is the point at a
    place that is a hash of (seed, trial, corner) modulo the number of points, in a numbering that no task
    sorts whole. Trials whose corners lie on a line give no plane. A scene's points are dealt over blocks of
    ``SCORED`` points, each scored against all planes in one array call, and the blocks' counts are added up.
    The planes are copied once for every ``SHARD`` blocks and a scene's few numbers are broadcast (at most a row
    for every ``minimum`` points), so no step gathers a scene by its key.
    ``inliers`` are those of the best trial; they are taken out before the next plane, and the equation
    given is the least-squares plane through them. A scene with fewer than ``least`` points left gets no
    further plane. ``ident`` is unique in a scene. The only driver loop is over the plane number, with a
    checkpoint per round.
    """
    sizes = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_total"), *[(F.max(G.d(c)) - F.min(G.d(c))).alias(f"_s{c}") for c in ("x", "y", "z")]
    ).filter(F.col("_total") >= minimum)
    # 80 % quantile of the three spans, linearly interpolated.
    spans = F.array_sort(F.array("_sx", "_sy", "_sz"))
    extent = spans[1] + (spans[2] - spans[1]) * 0.6
    sizes = sizes.select(key, "_total", F.greatest(extent * 0.006, F.lit(1e-5)).alias("_tol"))
    left = points.select(key, F.col(ident).alias("_id"), G.d("x").alias("x"), G.d("y").alias("y"), G.d("z").alias("z")).join(F.broadcast(sizes), key)
    found: DataFrame | None = None
    for index in range(planes):
        enough = left.groupBy(key).agg(F.count(F.lit(1)).alias("_left")).filter(F.col("_left") >= least)
        candidates = cut_lineage(_trial_planes(left, enough, key, seed + index, trials).join(enough, key))
        blocks = F.ceil(F.col("_left") / F.lit(SCORED))
        copies = candidates.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((blocks - 1) / F.lit(SHARD))))).drop("_left")
        counts = (
            left.join(F.broadcast(enough), key).withColumn("_block", F.pmod(F.xxhash64("_id"), blocks)).groupBy(key, "_total", "_tol", "_block")
            .agg(F.collect_list(F.struct("x", "y", "z")).alias("_points")).withColumn("_shard", F.floor(F.col("_block") / F.lit(SHARD))).join(copies, [key, "_shard"])
            .select(key, "_total", "_tol", F.posexplode(F.arrow_udf(_near_counts, "array<long>")("_points", "_planes", "_tol")).alias("_i", "_near"))
            .groupBy(key, "_total", "_tol", "_i").agg(F.sum("_near").alias("_n")).filter("_n > 0")
        )
        scored = counts.join(candidates, key).select(key, "_total", "_tol", "_n", F.get("_planes", "_i").alias("_p"))
        best = scored.groupBy(key).agg(
            F.max_by(F.struct("_p", "_n", "_total", "_tol"), F.struct("_n", (-F.col("_p.trial")).alias("_t"))).alias("_b")
        )
        trial = best.filter(F.col("_b._n") >= F.greatest(F.lit(80), F.floor(F.col("_b._total") * 0.07))).select(
            key, *[F.col(f"_b._p.{n}").alias(f"_{n}") for n in "abcd"], F.col("_b._n").alias("inliers"), F.col("_b._tol").alias("tolerance")
        )
        trial = cut_lineage(trial)
        off = F.abs(F.col("_a") * F.col("x") + F.col("_b") * F.col("y") + F.col("_c") * F.col("z") + F.col("_d"))
        near = left.join(F.broadcast(trial), key)
        accepted = cut_lineage(trial.join(_refit(near.filter(off <= F.col("tolerance")), key), key).select(
            key, F.lit(index).alias("plane"), *[F.coalesce(n, f"_{n}").alias(n) for n in "abcd"], "inliers", "tolerance"
        ))
        found = accepted if found is None else found.unionByName(accepted)
        if index + 1 < planes:
            left = cut_lineage(near.filter(off > F.col("tolerance")).select(*left.columns))
    return found


def _refit(points: DataFrame, key: str) -> DataFrame:
    """Plane through the mean of the points whose normal follows from their covariance; NULL for points on a line.

    The two slopes are regressed on the axis for which the other two spread most.
    """
    x, y, z = (F.col(c) for c in "xyz")
    m = points.groupBy(key).agg(
        *[F.avg(c).alias(f"_m{n}") for c, n in ((x, "x"), (y, "y"), (z, "z"))],
        *[F.covar_pop(a, b).alias(f"_{n}") for a, b, n in ((x, x, "xx"), (y, y, "yy"), (z, z, "zz"), (x, y, "xy"), (x, z, "xz"), (y, z, "yz"))],
    )
    xx, yy, zz, xy, xz, yz = (F.col(f"_{n}") for n in ("xx", "yy", "zz", "xy", "xz", "yz"))
    along = {"x": yy * zz - yz * yz, "y": xx * zz - xz * xz, "z": xx * yy - xy * xy}
    top = F.greatest(*along.values())
    p, q, r = xz * yz - xy * zz, xy * yz - xz * yy, xy * xz - yz * xx
    normal = F.when(along["x"] == top, F.array(along["x"], p, q)).when(along["y"] == top, F.array(p, along["y"], r)).otherwise(F.array(q, r, along["z"]))
    m = m.withColumn("_v", F.when(top > 1e-24, normal))
    size = G.norm(*[F.col("_v")[i] for i in range(3)])
    m = m.select(key, "_mx", "_my", "_mz", *[(F.col("_v")[i] / size).alias(n) for i, n in enumerate("abc")])
    return m.select(key, "a", "b", "c", (-(F.col("a") * F.col("_mx") + F.col("b") * F.col("_my") + F.col("c") * F.col("_mz"))).alias("d"))


def _near_counts(points: pa.Array, planes: pa.Array, tolerance: pa.Array) -> pa.Array:
    """For each row, how many of its points lie within the tolerance of each of its planes."""
    out = []
    for p, q, t in zip(points, planes, tolerance.to_pylist()):
        x, y, z = (p.values.field(c).to_numpy(zero_copy_only=False) for c in "xyz")
        a, b, c, d = (q.values.field(n).to_numpy(zero_copy_only=False) for n in "abcd")
        out.append([int((np.abs(a[i] * x + b[i] * y + c[i] * z + d[i]) <= t).sum()) for i in range(len(a))])
    return pa.array(out, pa.list_(pa.int64()))


def _trial_planes(points: DataFrame, sizes: DataFrame, key: str, seed: int, trials: int) -> DataFrame:
    """Array of candidate unit planes per scene of ``sizes(key, _left)``, at most one per trial."""
    placed = permuted(points.join(F.broadcast(sizes.select(key)), key, "left_semi"), "_id", seed, keys=[key])
    corner = F.explode(F.sequence(F.lit(0), F.lit(2)))
    drawn = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("corner", corner)
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "trial", "corner"), 256), 1, 12)
    drawn = drawn.withColumn("offset", F.conv(digits, 16, 10).cast("long") % F.col("_left"))
    listed = drawn.join(placed.select(key, "offset", "x", "y", "z"), [key, "offset"]).groupBy(key, "trial").agg(
        *[F.max(F.when(F.col("corner") == j, F.struct("x", "y", "z"))).alias(f"_{n}") for j, n in enumerate("pqr")]
    )
    p, q, r = (F.col(f"_{n}") for n in "pqr")
    e = [q[c] - p[c] for c in "xyz"]
    f = [r[c] - p[c] for c in "xyz"]
    n = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    size = G.norm(*n)
    flat = listed.withColumns({f"_n{i}": x / size for i, x in enumerate(n)} | {"_size": size}).filter("_size > 1e-12")
    unit = [F.col(f"_n{i}") for i in range(3)]
    plane = F.struct(
        "trial", unit[0].alias("a"), unit[1].alias("b"), unit[2].alias("c"), (-(unit[0] * p["x"] + unit[1] * p["y"] + unit[2] * p["z"])).alias("d")
    )
    return flat.groupBy(key).agg(F.array_sort(F.collect_list(plane)).alias("_planes"))


def nearest(queries: DataFrame, cloud: DataFrame, query_id: str, cloud_id: str, axes: Sequence[str] = ("x", "y", "z"), depth: int | None = None) -> DataFrame:
    """Exact nearest cloud point of every query: (query_id, cloud_id, distance).

    A level-by-level descent of an implicit octree.  Each level keeps, per query, only
    the cells that can still hold something nearer than the best representative seen,
    so neither a dense cell nor the whole cloud is ever paired with a query.  A query
    with a NULL or NaN coordinate, or an empty cloud, gives NULL id and distance.  Equal
    coordinates collapse to their smallest id first; ties go to the smaller id.  The
    tree is deep enough that its fullest leaf holds at most ``LEAF_POINTS`` points.
    """
    # Read once per level, so it is written out once instead of being recomputed.
    c_pts = cut_lineage(
        cloud.groupBy(*[G.d(a).alias(f"p{i}") for i, a in enumerate(axes)])
        .agg(F.min(cloud_id).alias("cid"))
    )
    q_pts = queries.select(F.col(query_id).alias("qid"), *[G.d(a).alias(f"q{i}") for i, a in enumerate(axes)])
    stats = c_pts.agg(
        F.count(F.lit(1)).alias("n"), *[F.min(f"p{i}").alias(f"lo{i}") for i in range(3)], *[F.max(f"p{i}").alias(f"hi{i}") for i in range(3)]
    ).first()
    if not stats["n"]:
        return q_pts.select(F.col("qid").alias(query_id), F.lit(None).cast(cloud.schema[cloud_id].dataType).alias(cloud_id), F.lit(None).cast("double").alias("distance"))
    low = [stats[f"lo{i}"] for i in range(3)]
    side = max(max(stats[f"hi{i}"] - low[i] for i in range(3)), 1e-12) * (1 + 1e-9)

    def cell(value: Column, i: int, level: int) -> Column:
        step = side / (1 << level)
        return F.least(F.floor((value - F.lit(low[i])) / F.lit(step)), F.lit((1 << level) - 1)).cast("int")

    levels = depth or max(2, math.ceil(math.log(max(stats["n"], 2), 8)))
    while depth is None and levels < MAX_LEVEL:
        fullest = c_pts.groupBy(*[cell(F.col(f"p{i}"), i, levels) for i in range(3)]).count().agg(F.max("count")).first()[0]
        if fullest <= LEAF_POINTS:
            break
        # A crowded leaf needs about log8 more levels; clustered points need further rounds.
        levels = min(MAX_LEVEL, levels + max(1, math.ceil(math.log(fullest / LEAF_POINTS, 8))))

    def gap(i: int, level: int) -> Column:
        """Distance along one axis from the query to the cell box (slightly underestimated)."""
        step = side / (1 << level)
        start = F.lit(low[i]) + F.col(f"k{i}") * F.lit(step)
        out = F.greatest(start - F.col(f"q{i}"), F.col(f"q{i}") - (start + F.lit(step)), F.lit(0.0))
        return F.greatest(out - F.lit(side * 1e-9), F.lit(0.0))

    # Two levels per round: a cell's children are its up to 64 grandchildren.
    schedule = list(range(min(2, levels), levels + 1, 2))
    if schedule[-1] != levels:
        schedule.append(levels)
    placed = F.lit(True)
    for i in range(3):
        placed = placed & F.col(f"q{i}").isNotNull() & ~F.isnan(f"q{i}")
    frontier = q_pts.filter(placed).withColumn("ub", F.lit(float("inf")))
    for i in range(3):
        frontier = frontier.withColumn(f"k{i}", F.lit(0))
    parent = 0
    for level in schedule:
        reps = c_pts.withColumns({f"k{i}": cell(F.col(f"p{i}"), i, level) for i in range(3)}).groupBy("k0", "k1", "k2").agg(
            F.min_by(F.struct("p0", "p1", "p2"), "cid").alias("rep")
        )
        shift = level - parent
        children = reps.select(
            *[F.shiftright(f"k{i}", shift).alias(f"_u{i}") for i in range(3)], "k0", "k1", "k2", "rep"
        )
        if parent == 0:
            # The first round has 64 cells at most, so they travel as a literal array.
            met = frontier.drop("k0", "k1", "k2").withColumn("_c", F.explode(_literal_cells(reps.collect()))).select("*", "_c.*").drop("_c")
        else:
            up = frontier.select("qid", "q0", "q1", "q2", "ub", *[F.col(f"k{i}").alias(f"_u{i}") for i in range(3)])
            met = up.join(children, [f"_u{i}" for i in range(3)])
        far = sum((F.pow(F.col(f"rep.p{i}") - F.col(f"q{i}"), F.lit(2.0)) for i in range(1, 3)), F.pow(F.col("rep.p0") - F.col("q0"), F.lit(2.0)))
        near = sum((F.pow(gap(i, level), F.lit(2.0)) for i in range(1, 3)), F.pow(gap(0, level), F.lit(2.0)))
        w = W.partitionBy("qid")
        met = met.withColumn("_near", near).withColumn("_far", far)
        met = met.filter(F.col("_near") <= F.col("ub"))
        bound = F.least(F.col("ub"), F.min("_far").over(w))
        frontier = met.withColumn("ub", bound).filter(F.col("_near") <= F.col("ub")).select(
            "qid", "q0", "q1", "q2", "ub", "k0", "k1", "k2"
        )
        parent = level
    leaves = c_pts.withColumns({f"k{i}": cell(F.col(f"p{i}"), i, levels) for i in range(3)})
    d2 = sum((F.pow(F.col(f"p{i}") - F.col(f"q{i}"), F.lit(2.0)) for i in range(1, 3)), F.pow(F.col("p0") - F.col("q0"), F.lit(2.0)))
    best = (
        frontier.join(leaves, ["k0", "k1", "k2"])
        .withColumn("_d", d2)
        .groupBy("qid")
        .agg(F.min(F.struct("_d", "cid")).alias("_b"))
    )
    # a query without a place (NULL or NaN coordinate) met no cell and has no nearest point
    met_any = best.withColumnRenamed("qid", "_q")
    every = q_pts.select("qid").distinct().join(met_any, F.col("qid") == F.col("_q"), "left")
    return every.select(F.col("qid").alias(query_id), F.col("_b.cid").alias(cloud_id), F.sqrt("_b._d").alias("distance"))


def _literal_cells(rows) -> Column:
    """Array literal of (k0, k1, k2, rep) structs."""
    def point(r) -> Column:
        return F.struct(*[F.lit(r["rep"][f"p{i}"]).alias(f"p{i}") for i in range(3)]).alias("rep")

    return F.array(*[F.struct(*[F.lit(r[f"k{i}"]).alias(f"k{i}") for i in range(3)], point(r)) for r in rows])


def components(mask: DataFrame, keys: Sequence[str], tile: int = 64, max_rounds: int = 40) -> DataFrame:
    """8-connected component label of every mask pixel (smallest pixel code inside it).

    Tiles (at most tile^2 pixels) are labelled inside a task.  Only pairs of tile labels
    that touch across tile edges form a graph, which is closed by alternating
    neighbour-minimum hops with a checkpoint per round.
    """
    keys = list(keys)
    coded = mask.select(*keys, "y", "x").withColumn("_ty", F.floor(F.col("y") / tile).cast("int")).withColumn(
        "_tx", F.floor(F.col("x") / tile).cast("int")
    )
    fields = {f.name: f.dataType.simpleString() for f in mask.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, "y", "x"]) + ", local long"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        y0, x0 = y.min(), x.min()
        field = np.full((y.max() - y0 + 3, x.max() - x0 + 3), np.iinfo(np.int64).max)
        code = (y << 32) | x
        r, c = y - y0 + 1, x - x0 + 1
        field[r, c] = code
        while True:
            near = np.min([field[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
            if np.array_equal(near, field[r, c]):
                break
            field[r, c] = near
        return pdf[[*keys, "y", "x"]].assign(local=field[r, c])

    local = cut_lineage(coded.groupBy(*keys, "_ty", "_tx").applyInPandas(label, schema))
    edge = local.filter(
        (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    )
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    reached = edge.withColumn("_s", F.explode(steps)).select(
        *keys, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("local").alias("a")
    )
    links = reached.join(edge, [*keys, "y", "x"]).select(*keys, "a", F.col("local").alias("b")).filter("a <> b").distinct()
    names = _close_labels(cut_lineage(links), keys, max_rounds)
    return local.join(names, [*keys, "local"], "left").select(
        *keys, "y", "x", F.coalesce("label", F.col("local")).alias("label")
    )


def _close_labels(links: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """Smallest label reachable over symmetric links: alternate large-star and small-star.

    Both stars keep connectivity and point nodes at smaller ones, so edges end up as one
    star per component after a logarithmic number of rounds.
    """
    edges = links.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    previous = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).select(*keys, "u", F.least("u", "_m").alias("_m"))
        large = both.join(low, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        hops = large.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v")
        small = hops.unionByName(least.select(*keys, "u", F.col("_m").alias("v"))).distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if previous == state:
            break
        previous = state
    else:
        raise RuntimeError("component labels did not settle; raise max_rounds")
    return edges.groupBy(*keys, F.col("u").alias("local")).agg(F.min("v").alias("label"))


def component_boxes(labels: DataFrame, keys: Sequence[str], low: int = 50, high: int = 12000) -> DataFrame:
    """Blobs inside the area limits with centre of mass and larger box side.

    Area and moments count pixels.
    """
    size = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) + 1
    return (
        labels.groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), size.alias("size"))
        .filter(F.col("area").between(low, high))
    )
