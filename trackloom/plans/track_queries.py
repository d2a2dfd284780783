"""Track geometry and raster operators over the embedding tracks and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import condition, geometry as G
from trackloom.operators import audit, clouds, masks, raster, sequence
from trackloom.plans.spec import query
from trackloom.plans.tables import FRAMES, GRID_SQL, SIDE, TRACK_SQL, grid_points, load, track_initial, track_meta, track_points
from trackloom.session import cut_lineage

GRID, PREPROCESS = (8, 8), (32, 32)

COLOUR_SQL = """
initial AS (SELECT sample_id, slot, point_id, cx AS ix, cy AS iy, cz AS iz FROM points WHERE frame = 0),
scale AS (
  SELECT sample_id, min(ix) AS xl, max(ix) AS xh, min(iy) AS yl, max(iy) AS yh,
         quantile_cont(1.0 / iz, 0.02) AS ql, quantile_cont(1.0 / iz, 0.98) AS qh
  FROM initial WHERE iz > 1e-6 GROUP BY sample_id),
colour AS (
  SELECT i.sample_id, slot, point_id,
    CAST(CASE WHEN xh - xl > 1e-6 THEN least(greatest((ix - xl) / (xh - xl), 0), 1) ELSE 0.5 END AS FLOAT) AS r,
    CAST(CASE WHEN yh - yl > 1e-6 THEN least(greatest((iy - yl) / (yh - yl), 0), 1) ELSE 0.5 END AS FLOAT) AS g,
    CAST(CASE WHEN qh - ql > 1e-6 THEN least(greatest((1.0 / iz - ql) / (qh - ql), 0), 1) ELSE 0.5 END AS FLOAT) AS b
  FROM initial i JOIN scale s ON i.sample_id = s.sample_id)
"""

PIXEL_SQL = """
placed AS (
  SELECT sample_id, frame, slot, point_id, depth,
         CAST(round_even((u + 0.5) * (CAST(43 AS DOUBLE) / CAST(40 AS DOUBLE)) - 0.5 - 5, 0) AS BIGINT) AS px,
         CAST(round_even((v + 0.5) * (CAST(32 AS DOUBLE) / CAST(30 AS DOUBLE)) - 0.5 - 0, 0) AS BIGINT) AS py
  FROM points WHERE valid AND depth > 1e-6),
inside AS (SELECT * FROM placed WHERE px >= 0 AND px < 32 AND py >= 0 AND py < 32)
"""

SPLAT_SQL = """
splats AS (
  SELECT sample_id, frame, slot, point_id, depth, px + dx AS px, py + dy AS py
  FROM candidates, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy)
  WHERE px + dx BETWEEN 0 AND 31 AND py + dy BETWEEN 0 AND 31),
winners AS (
  SELECT * FROM splats
  QUALIFY row_number() OVER (PARTITION BY sample_id, frame, py, px ORDER BY depth, slot, point_id) = 1),
cells AS (
  SELECT w.sample_id, w.slot, w.frame, CAST(floor((py + 0.5) * 8.0 / 32.0) AS INTEGER) AS cy,
         CAST(floor((px + 0.5) * 8.0 / 32.0) AS INTEGER) AS cx,
         CAST(avg(CAST(r AS DOUBLE)) AS FLOAT) AS r, CAST(avg(CAST(g AS DOUBLE)) AS FLOAT) AS g,
         CAST(avg(CAST(b AS DOUBLE)) AS FLOAT) AS b, 1.0 AS visible
  FROM winners w JOIN colour c ON w.sample_id = c.sample_id AND w.slot = c.slot AND w.point_id = c.point_id
  WHERE w.slot >= 0 GROUP BY 1, 2, 3, 4, 5)
"""

CELLS_SQL = f"{TRACK_SQL}, {COLOUR_SQL}, {PIXEL_SQL}, candidates AS (SELECT * FROM inside), {SPLAT_SQL}"
CELL_COLUMNS = "sample_id:s slot:i frame:i cy:i cx:i r:f4 g:f4 b:f4 visible:f4"


def identity_cells(spark, folder, method="arrow", static=None):
    points = track_points(spark, folder)
    return raster.identity_tracks(points, track_initial(points), track_meta(points), GRID, PREPROCESS, static, method=method)


@query(CELL_COLUMNS, f"WITH {CELLS_SQL} SELECT * FROM cells")
def identity_tracks(spark, folder):
    """Identity map: crop, z-buffer at full resolution, then cell means (one Arrow call per frame)."""
    return identity_cells(spark, folder)


@query(CELL_COLUMNS, f"WITH {CELLS_SQL} SELECT * FROM cells")
def identity_tracks_sql(spark, folder):
    """The same map by aggregation only."""
    return identity_cells(spark, folder, "sql")


CAMERA = "array(array(20D, 0D, 20D), array(0D, 20D, 15D), array(0D, 0D, 1D))"


def _pose(angle: float):
    """A camera that slides sideways by ``angle`` per frame; left-handed like the contract."""
    shift = F.col("frame") * F.lit(angle)
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(
        F.array(one, zero, zero, shift.cast("double")),
        F.array(zero, -one, zero, zero),
        F.array(zero, zero, one, zero),
        F.array(zero, zero, zero, one),
    )


def _cameras(points):
    return points.select("sample_id", "frame").distinct().select("sample_id", "frame", _pose(0.05).alias("m"), F.expr(CAMERA).alias("k"))


def _static_points(points):
    """Scene points a little behind each sample's first-frame points."""
    return track_initial(points).select(
        "sample_id", F.col("point_id"), (F.col("iy") * 2).alias("x"), (F.col("ix") * 2).alias("y"), (F.col("iz") - 0.05).alias("z")
    )


def _meta_with_clip(points):
    return track_meta(points).withColumn("metadata", F.parse_json(F.lit('{"clip_start_m": 0.03, "clip_end_m": 2.05}')))


STATIC_SQL = """
static AS (
  SELECT p.sample_id, f AS frame, -1 AS slot, -1 AS point_id, id, cz - 0.05 AS depth,
         2 * cy + f * 0.05 - 0 * 0.05 AS sx, 2 * cx AS sy
  FROM (SELECT sample_id, point_id AS id, cx, cy, cz FROM points WHERE frame = 0) p, range(4) AS t(f)),
static_uv AS (
  SELECT *, depth > 0.03 AND depth < 2.05 AS ok, (20.0 * sx + 20.0 * depth) / depth AS u,
         (20.0 * -sy + 15.0 * depth) / depth AS v FROM static)
"""


@query(
    "sample_id:s frame:i point_id:i u:f4 v:f4 depth:f6 valid:b",
    f"""WITH {TRACK_SQL}, {STATIC_SQL}
SELECT sample_id, frame, id AS point_id, u, v, depth, ok AS valid FROM static_uv""",
)
def project_static(spark, folder):
    """Scene points of the first camera seen from every frame's camera."""
    points = track_points(spark, folder)
    return raster.project_static(_static_points(points), _cameras(points), _meta_with_clip(points))


STATIC_CELLS_SQL = f"""{TRACK_SQL}, {COLOUR_SQL}, {PIXEL_SQL}, {STATIC_SQL},
static_placed AS (
  SELECT sample_id, frame, slot, point_id, depth,
         CAST(round_even((u + 0.5) * (CAST(43 AS DOUBLE) / CAST(40 AS DOUBLE)) - 0.5 - 5, 0) AS BIGINT) AS px,
         CAST(round_even((v + 0.5) * (CAST(32 AS DOUBLE) / CAST(30 AS DOUBLE)) - 0.5 - 0, 0) AS BIGINT) AS py
  FROM static_uv WHERE ok),
candidates AS (
  SELECT sample_id, frame, slot, point_id, depth, px, py FROM inside
  UNION ALL SELECT * FROM static_placed WHERE px >= 0 AND px < 32 AND py >= 0 AND py < 32), {SPLAT_SQL}"""


@query(CELL_COLUMNS, f"WITH {STATIC_CELLS_SQL} SELECT * FROM cells")
def identity_tracks_static(spark, folder):
    """Identity map with a static scene that occludes."""
    points = track_points(spark, folder)
    static = raster.project_static(_static_points(points), _cameras(points), _meta_with_clip(points))
    return identity_cells(spark, folder, "arrow", static)


@query(
    "sample_id:s slot:i point_id:i r:f6 g:f6 b:f6",
    f"WITH {TRACK_SQL}, {COLOUR_SQL} SELECT * FROM colour",
)
def identity_colour(spark, folder):
    """Fixed colour of every point from its first-frame position."""
    initial = track_initial(track_points(spark, folder))
    return raster.identity_colour(initial, raster.identity_scale(initial))


@query(
    "sample_id:s depth_low:f6 depth_span:f6",
    f"""WITH {TRACK_SQL}
SELECT sample_id, quantile_cont(depth, 0.01) AS depth_low,
       greatest(quantile_cont(depth, 0.99) - quantile_cont(depth, 0.01), 1e-6) AS depth_span
FROM points WHERE valid GROUP BY sample_id""",
)
def depth_scale(spark, folder):
    """Robust depth range per sample."""
    return raster.depth_scale(track_points(spark, folder))


DENSE_SQL = """
scaled AS (
  SELECT *, (u + 0.5) * (CAST(43 AS DOUBLE) / CAST(40 AS DOUBLE)) - 0.5 - 5 AS x,
         (v + 0.5) * (CAST(32 AS DOUBLE) / CAST(30 AS DOUBLE)) - 0.5 - 0 AS y FROM points),
span AS (
  SELECT sample_id, quantile_cont(depth, 0.01) AS low,
         greatest(quantile_cont(depth, 0.99) - quantile_cont(depth, 0.01), 1e-6) AS span
  FROM points WHERE valid GROUP BY sample_id),
joined AS (
  SELECT s.*, o.x AS x0, o.y AS y0, o.valid AS valid0, (s.x - o.x) / 32.0 AS dx, (s.y - o.y) / 32.0 AS dy,
         1.0 - least(greatest((s.depth - low) / span, 0), 1) AS dn
  FROM scaled s JOIN scaled o ON s.sample_id = o.sample_id AND s.slot = o.slot AND s.point_id = o.point_id AND o.frame = 0
  JOIN span ON s.sample_id = span.sample_id),
both_sides AS (
  SELECT sample_id, slot, frame, CAST(round_even(y0 * 0.25, 0) AS INTEGER) AS cy, CAST(round_even(x0 * 0.25, 0) AS INTEGER) AS cx,
         1.0 AS source, NULL AS current, CASE WHEN valid THEN dx END AS dx, CASE WHEN valid THEN dy END AS dy, NULL AS dn
  FROM joined WHERE valid0
  UNION ALL
  SELECT sample_id, slot, frame, CAST(round_even(y * 0.25, 0) AS INTEGER), CAST(round_even(x * 0.25, 0) AS INTEGER),
         NULL, 1.0, NULL, NULL, dn FROM joined WHERE valid),
dense AS (
  SELECT sample_id, slot, frame, cy, cx, coalesce(max(source), 0) AS source, coalesce(max(current), 0) AS current,
         CAST(coalesce(avg(dx), 0) AS FLOAT) AS dx, CAST(coalesce(avg(dy), 0) AS FLOAT) AS dy,
         CAST(coalesce(avg(dn), 0) AS FLOAT) AS depth, coalesce(max(current), 0) AS valid
  FROM both_sides WHERE cx BETWEEN 0 AND 7 AND cy BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4, 5)
"""


def dense_cells(spark, folder):
    points = track_points(spark, folder)
    return raster.dense_tracks(points, track_meta(points), GRID, PREPROCESS)


@query(
    "sample_id:s slot:i frame:i cy:i cx:i source:f4 current:f4 dx:f4 dy:f4 depth:f4 valid:f4",
    f"WITH {TRACK_SQL}, {DENSE_SQL} SELECT * FROM dense",
)
def dense_tracks(spark, folder):
    """Six-channel map: source and current occupancy, displacement, depth, validity."""
    return dense_cells(spark, folder)


@query(
    "sample_id:s slot:i displacement_step_abs_mean:f5 displacement_step_abs_p95:f5 per_cell_displacement_abs_p95:f5",
    f"""
WITH {TRACK_SQL}, {DENSE_SQL},
usable AS (SELECT * FROM dense WHERE source > 0 AND valid > 0),
pairs AS (
  SELECT a.sample_id, a.slot, a.frame, abs(CAST(a.dx AS DOUBLE) - CAST(b.dx AS DOUBLE)) AS x, abs(CAST(a.dy AS DOUBLE) - CAST(b.dy AS DOUBLE)) AS y
  FROM usable a JOIN usable b ON a.sample_id = b.sample_id AND a.slot = b.slot AND a.cy = b.cy AND a.cx = b.cx AND a.frame = b.frame + 1),
steps AS (SELECT sample_id, slot, frame, x AS s FROM pairs UNION ALL SELECT sample_id, slot, frame, y FROM pairs),
frames AS (SELECT sample_id, slot, frame, avg(s) AS m, quantile_cont(s, 0.95) AS p FROM steps GROUP BY 1, 2, 3)
SELECT sample_id, slot, avg(m) AS displacement_step_abs_mean, quantile_cont(m, 0.95) AS displacement_step_abs_p95,
       quantile_cont(p, 0.95) AS per_cell_displacement_abs_p95 FROM frames GROUP BY 1, 2""",
)
def displacement_step(spark, folder):
    """Change of cell displacement between adjacent frames."""
    return sequence.displacement_step(dense_cells(spark, folder))


def _slot_meta(cells):
    return cells.select("sample_id").distinct().select(
        "sample_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("slot"), F.lit(FRAMES).alias("frames"), F.lit(64).alias("cells_total")
    )


@query(
    "sample_id:s slot:i slot_active:b active_cells_mean:f6 active_cells_min:i active_cells_max:i target_flip_rate_mean:f6 "
    "target_flip_rate_max:f6 target_iou_mean:f6 identity_rgb_min:f4 identity_rgb_max:f4",
    f"""
WITH {CELLS_SQL},
meta AS (SELECT DISTINCT sample_id, slot FROM (SELECT DISTINCT sample_id FROM cells) s, range(3) AS t(slot)),
full_frames AS (
  SELECT m.sample_id, m.slot, f AS frame, count(c.cx) AS n FROM meta m CROSS JOIN range(4) AS t(f)
  LEFT JOIN cells c ON c.sample_id = m.sample_id AND c.slot = m.slot AND c.frame = f GROUP BY 1, 2, 3),
cur AS (SELECT sample_id, slot, frame, cy, cx FROM cells),
pairs AS (
  SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.slot, b.slot) AS slot, coalesce(a.frame, b.frame) AS frame,
         a.cx IS NOT NULL AND b.cx IS NOT NULL AS shared
  FROM cur a FULL JOIN (SELECT sample_id, slot, frame + 1 AS frame, cy, cx FROM cells) b
  ON a.sample_id = b.sample_id AND a.slot = b.slot AND a.frame = b.frame AND a.cy = b.cy AND a.cx = b.cx),
change AS (
  SELECT m.sample_id, m.slot, f AS frame, count(p.shared) AS u, count(*) FILTER (p.shared) AS i
  FROM meta m CROSS JOIN range(1, 4) AS t(f) LEFT JOIN pairs p ON p.sample_id = m.sample_id AND p.slot = m.slot AND p.frame = f GROUP BY 1, 2, 3),
moves AS (
  SELECT sample_id, slot, avg((u - i) / 64.0) AS fm, max((u - i) / 64.0) AS fx, avg(CASE WHEN u > 0 THEN i / u ELSE 1.0 END) AS iou
  FROM change GROUP BY 1, 2),
rgb AS (SELECT sample_id, slot, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM cells GROUP BY 1, 2),
counts AS (SELECT sample_id, slot, avg(n) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM full_frames GROUP BY 1, 2)
SELECT c.sample_id, c.slot, max_n > 0 AS slot_active, mean_n AS active_cells_mean, min_n AS active_cells_min, max_n AS active_cells_max,
       fm AS target_flip_rate_mean, fx AS target_flip_rate_max, iou AS target_iou_mean,
       coalesce(lo, 0) AS identity_rgb_min, coalesce(hi, 0) AS identity_rgb_max
FROM counts c JOIN moves v ON c.sample_id = v.sample_id AND c.slot = v.slot
LEFT JOIN rgb ON c.sample_id = rgb.sample_id AND c.slot = rgb.slot""",
)
def object_cells(spark, folder):
    """Active cells, flip rate, IoU and colour range per object slot."""
    cells = identity_cells(spark, folder)
    return raster.object_cells(cells, _slot_meta(cells))


@query(
    "sample_id:s frame:i cy:i cx:i",
    f"""
WITH {CELLS_SQL},
source AS (SELECT DISTINCT sample_id, cy, cx FROM cells WHERE frame = 0)
SELECT sample_id, l AS frame, cy, cx FROM source, range(2) AS t(l)
UNION SELECT sample_id, CASE WHEN frame = 0 THEN 0 ELSE (frame - 1) // 4 + 1 END, cy, cx FROM cells""",
)
def motion_envelope(spark, folder):
    """Cells of the source or the current frame, folded into latent windows."""
    cells = identity_cells(spark, folder)
    return raster.motion_envelope(cells, cells.select("sample_id").distinct().withColumn("frames", F.lit(FRAMES)))


@query(
    "sample_id:s rule_id:s",
    f"""
WITH {CELLS_SQL},
edited AS (
  SELECT sample_id, slot, CASE WHEN CAST(sample_id AS INTEGER) % 3 = 1 THEN r + 1.5 ELSE r END AS r,
         CASE WHEN CAST(sample_id AS INTEGER) % 4 = 1 THEN 0.5 ELSE visible END AS visible FROM cells)
SELECT DISTINCT sample_id, 'C02' AS rule_id FROM edited WHERE r > 1 + 1e-6
UNION ALL SELECT DISTINCT sample_id, 'C03' FROM edited WHERE visible NOT IN (0, 1)
UNION ALL SELECT DISTINCT sample_id, 'C05' FROM edited WHERE slot >= 2 AND CAST(sample_id AS INTEGER) % 5 <> 2
UNION ALL SELECT DISTINCT sample_id, 'C00' FROM edited WHERE CAST(sample_id AS INTEGER) % 5 = 2""",
)
def track_cell_checks(spark, folder):
    """Map rules on edited cells: range, binary visibility, unused slots, samples without an object count."""
    number = F.col("sample_id").cast("int")
    cells = identity_cells(spark, folder)
    edited = cells.withColumn("r", F.when(number % 3 == 1, F.col("r") + 1.5).otherwise(F.col("r"))).withColumn(
        "visible", F.when(number % 4 == 1, F.lit(0.5)).otherwise(F.col("visible"))
    )
    counts = cells.select("sample_id").distinct().filter(number % 5 != 2).withColumn("object_count", F.lit(2))
    return raster.validate_track_cells(edited, counts)


@query(
    "sample_id:s rule_id:s",
    f"""
WITH {TRACK_SQL},
s AS (SELECT DISTINCT sample_id, CAST(sample_id AS INTEGER) AS n FROM points)
SELECT sample_id, 'T02' AS rule_id FROM s
UNION ALL SELECT sample_id, 'T04' FROM s WHERE n % 3 = 1
UNION ALL SELECT sample_id, 'T14' FROM s WHERE n % 2 = 1
UNION ALL SELECT sample_id, 'T16' FROM s WHERE n % 2 = 1 AND n % 5 = 3
UNION ALL SELECT sample_id, 'T08' FROM s WHERE n % 4 = 2""",
)
def validate_tracks(spark, folder):
    """Track contract on payloads with shifted depths, cameras, times and descriptions."""
    points = track_points(spark, folder)
    n = F.col("sample_id").cast("int")
    world = points.withColumn("wx", F.col("cx")).withColumn("wy", -F.col("cy")).withColumn("wz", F.col("cz") + F.when(n % 5 == 3, 1.0).otherwise(0.0))
    world = world.withColumn("depth", F.col("depth") + F.when(n % 3 == 1, 1.0).otherwise(0.0))
    cameras = points.select("sample_id").distinct().select(
        "sample_id", F.lit(None).cast("int").alias("frame"),
        F.expr("array(array(1D,0D,0D,0D), array(0D,-1D,0D,0D), array(0D,0D,1D,0D), array(0D,0D,0D,1D))").alias("m"), F.expr(CAMERA).alias("k"),
    )
    described = F.parse_json(F.when(n % 2 == 1, F.lit('{"schema": "x.point_trajectories.v1", "point_count": 64}')).otherwise(F.lit("{}")))
    times = F.when(n % 4 == 2, F.expr("array(0D, 1D, 1D, 2D)")).otherwise(F.expr("array(0D, 1D, 2D, 3D)"))
    meta = track_meta(points).select(
        "sample_id", F.array(*[F.lit(x) for x in raster.C.TRACK_FIELDS]).alias("fields"), "frames", times.alias("time_s"),
        F.expr("array('a', 'b', 'c')").alias("object_ids"), "width", "height", described.alias("metadata"),
    )
    return raster.validate_tracks(world, cameras, meta, track_initial(points))


@query(
    "sample_id:s slot:i max_center_displacement_m:f6 valid_ratio:f6 max_rigid_shape_error_m:f6 min_depth_m:f6 max_depth_m:f6 duration_s:f6",
    f"""
WITH {TRACK_SQL},
centre AS (SELECT sample_id, slot, frame, avg(cx) AS x, avg(cy) AS y, avg(cz) AS z FROM points GROUP BY 1, 2, 3),
moved AS (
  SELECT a.sample_id, a.slot, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS m
  FROM centre a JOIN centre b ON a.sample_id = b.sample_id AND a.slot = b.slot AND b.frame = 0 GROUP BY 1, 2),
radius AS (
  SELECT p.sample_id, p.slot, p.frame, p.point_id, sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2) AS r
  FROM points p JOIN centre c ON p.sample_id = c.sample_id AND p.slot = c.slot AND p.frame = c.frame),
drift AS (
  SELECT a.sample_id, a.slot, max(abs(a.r - b.r)) AS d FROM radius a JOIN radius b
  ON a.sample_id = b.sample_id AND a.slot = b.slot AND a.point_id = b.point_id AND b.frame = 0 GROUP BY 1, 2),
simple AS (
  SELECT sample_id, slot, avg(CAST(valid AS INTEGER)) AS v, min(cz) FILTER (valid) AS lo, max(cz) FILTER (valid) AS hi FROM points GROUP BY 1, 2)
SELECT m.sample_id, m.slot, m AS max_center_displacement_m, v AS valid_ratio, d AS max_rigid_shape_error_m,
       lo AS min_depth_m, hi AS max_depth_m, 0.75 AS duration_s
FROM moved m JOIN drift d ON m.sample_id = d.sample_id AND m.slot = d.slot JOIN simple s ON m.sample_id = s.sample_id AND m.slot = s.slot""",
)
def track_metrics(spark, folder):
    """Displacement, validity, shape drift, depth range and duration per object."""
    points = track_points(spark, folder).withColumns({"wx": F.col("cx"), "wy": F.col("cy"), "wz": F.col("cz")})
    times = points.select("sample_id", "frame").distinct().withColumn("time_s", F.col("frame") * 0.25)
    return sequence.track_metrics(points, times)


@query(
    "label:i point_id:i drift:f6",
    """
WITH p AS (
  SELECT label, vec_id AS point_id, f AS frame, CAST(embedding[f * 3 + 1] AS DOUBLE) AS x, CAST(embedding[f * 3 + 2] AS DOUBLE) AS y,
         CAST(embedding[f * 3 + 3] AS DOUBLE) AS z FROM embeddings, range(2) AS t(f)),
c AS (SELECT label, frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY 1, 2),
r AS (SELECT p.label, p.frame, point_id, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS r FROM p JOIN c ON p.label = c.label AND p.frame = c.frame)
SELECT a.label, a.point_id, abs(a.r - b.r) AS drift FROM r a JOIN r b ON a.label = b.label AND a.point_id = b.point_id AND b.frame = 0 WHERE a.frame = 1""",
)
def radius_drift(spark, folder):
    """Change of each vector's distance to its label's centroid between two frames."""
    base = load(spark, folder, "embeddings").select("label", F.col("vec_id").alias("point_id"), "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"))
    points = base.select("label", "point_id", "frame", *[F.get("embedding", F.col("frame") * 3 + i).alias(n) for i, n in enumerate(("wx", "wy", "wz"))])
    return sequence.radius_drift(points, ["label"]).filter("frame = 1")


@query(
    "frame:i y:i x:i depth:f6 slot:i point_id:i",
    f"""WITH {GRID_SQL}
SELECT frame, y, x, e3 AS depth, 0 AS slot, point_id FROM grid
QUALIFY row_number() OVER (PARTITION BY frame, y, x ORDER BY e3, point_id) = 1""",
)
def zbuffer(spark, folder):
    """Nearest vector per pixel of each label's image."""
    points = grid_points(spark, folder).withColumn("slot", F.lit(0)).withColumnRenamed("e3", "depth")
    return raster.zbuffer(points, ["frame", "y", "x"])


@query(
    "frame:i py:i px:i depth:f6 point_id:i",
    f"""WITH {GRID_SQL},
s AS (
  SELECT frame, y + dy AS py, x + dx AS px, e3, point_id FROM grid, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy)
  WHERE x + dx BETWEEN 0 AND 31 AND y + dy BETWEEN 0 AND 31)
SELECT frame, py, px, e3 AS depth, point_id FROM s QUALIFY row_number() OVER (PARTITION BY frame, py, px ORDER BY e3, point_id) = 1""",
)
def splat_zbuffer(spark, folder):
    """The same with every vector covering its 3 x 3 neighbourhood."""
    points = grid_points(spark, folder).select("frame", F.col("y").alias("py"), F.col("x").alias("px"), F.col("e3").alias("depth"), F.lit(0).alias("slot"), "point_id")
    centres = raster.zbuffer(points, ["frame", "py", "px"])
    return raster.zbuffer(raster.splat_candidates(centres, 1, SIDE, SIDE), ["frame", "py", "px"])


@query(
    "frame:i cy:i cx:i r:f4 g:f4 b:f4 visible:f4",
    f"""WITH {GRID_SQL}
SELECT frame, y // 4 AS cy, x // 4 AS cx, CAST(avg(e1) AS FLOAT) AS r, CAST(avg(e2) AS FLOAT) AS g, CAST(avg(e3) AS FLOAT) AS b, 1 AS visible
FROM grid GROUP BY 1, 2, 3""",
)
def cell_mean(spark, folder):
    """Mean values and occupancy per 8 x 8 cell."""
    points = grid_points(spark, folder).withColumns(
        {"cy": G.pixel_cell(F.col("y"), SIDE, 8), "cx": G.pixel_cell(F.col("x"), SIDE, 8), "r": F.col("e1"), "g": F.col("e2"), "b": F.col("e3")}
    )
    return raster.cell_mean(points, ["frame", "cy", "cx"])


@query(
    "frame:i cy:i cx:i mean_value:f4 max_value:f4",
    f"""WITH {GRID_SQL},
s AS (SELECT frame, CAST(round_even((e2 + 1.0) * 8.0, 0) AS INTEGER) AS cy, CAST(round_even((e1 + 1.0) * 8.0, 0) AS INTEGER) AS cx, e3 FROM grid)
SELECT frame, cy, cx, CAST(avg(e3) AS FLOAT) AS mean_value, CAST(max(e3) AS FLOAT) AS max_value
FROM s WHERE cy BETWEEN 0 AND 15 AND cx BETWEEN 0 AND 15 GROUP BY 1, 2, 3""",
)
def splat_max(spark, folder):
    """Mean and maximum per rounded cell."""
    points = grid_points(spark, folder).withColumn("px", (F.col("e1") + 1.0) * 8.0).withColumn("py", (F.col("e2") + 1.0) * 8.0)
    mean = raster.splat(points.withColumn("mean_value", F.col("e3")), ["frame"], "px", "py", ["mean_value"], 16, 16, "mean")
    top = raster.splat(points.withColumn("max_value", F.col("e3")), ["frame"], "px", "py", ["max_value"], 16, 16, "max")
    return mean.join(top, ["frame", "cy", "cx"])


@query(
    "frame:i flip_rate:f6 iou:f6",
    f"""WITH {GRID_SQL},
p AS (SELECT DISTINCT frame, y, x FROM grid),
j AS (
  SELECT coalesce(a.frame, b.frame + 1) AS frame, a.x IS NOT NULL AND b.x IS NOT NULL AS shared
  FROM p a FULL JOIN p b ON a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x),
g AS (SELECT f AS frame FROM range(1, 10) AS t(f))
SELECT g.frame, (count(j.shared) - count(*) FILTER (j.shared)) / 1024.0 AS flip_rate,
       CASE WHEN count(j.shared) > 0 THEN count(*) FILTER (j.shared) / count(j.shared) ELSE 1.0 END AS iou
FROM g LEFT JOIN j ON g.frame = j.frame GROUP BY g.frame""",
)
def occupancy_iou(spark, folder):
    """Flip rate and IoU of adjacent labels' pixel sets."""
    cells = grid_points(spark, folder).select(F.lit(0).alias("video"), "frame", "y", "x")
    meta = spark.createDataFrame([(0, 10, SIDE * SIDE)], "video int, frames int, cells_total int")
    return sequence.occupancy_change(cells, ["video"], ["y", "x"], meta)


@query(
    "vec_id:i u:f4 v:f4 w:f6 recovered:b",
    """
WITH p AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) + 2.0 AS z FROM embeddings)
SELECT vec_id, (20.0 * x + 16.0 * z) / z AS u, (-20.0 * y + 12.0 * z) / z AS v, z AS w, TRUE AS recovered FROM p""",
)
def project_points(spark, folder):
    """Camera projection and its inverse."""
    k = F.expr("array(array(20D, 0D, 16D), array(0D, 20D, 12D), array(0D, 0D, 1D))")
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    p = (e[0], e[1], e[2] + 2.0)
    u, v, w = G.project(k, p)
    base = load(spark, folder, "embeddings").select(
        "vec_id", u.alias("u"), v.alias("v"), w.alias("w"), k.alias("k"), *[c.alias(n) for c, n in zip(p, "xyz")]
    )
    back = G.unproject(F.col("u"), F.col("v"), F.col("w"), F.col("k"))
    miss = G.norm(*[b.cast("double") - F.col(n) for b, n in zip(back, "xyz")])
    return base.select("vec_id", "u", "v", "w", (miss < 1e-6).alias("recovered"))


@query(
    "vec_id:i wx:f6 wy:f6 wz:f6 rx:f6 ry:f6 rz:f6",
    """
WITH p AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) + 2.0 AS d,
         CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings),
q AS (SELECT *, sqrt(1 + a * a + b * b + c * c) AS n FROM p),
r AS (SELECT vec_id, x, y, d, 1 / n AS w, a / n AS i, b / n AS j, c / n AS k FROM q)
SELECT vec_id, (x - 16.0) / 20.0 * d - 1.0 AS wx, (y - 12.0) / 20.0 * d - 2.0 AS wy, d - 3.0 AS wz,
       (1 - 2 * (j * j + k * k)) * x + 2 * (i * j - w * k) * y + 2 * (i * k + w * j) * d AS rx,
       2 * (i * j + w * k) * x + (1 - 2 * (i * i + k * k)) * y + 2 * (j * k - w * i) * d AS ry,
       2 * (i * k - w * j) * x + 2 * (j * k + w * i) * y + (1 - 2 * (i * i + j * j)) * d AS rz FROM r""",
)
def depth_to_world(spark, folder):
    """World point of a pixel ray, and a rotation by a quaternion."""
    k = F.expr("array(array(20D, 0D, 16D), array(0D, 20D, 12D), array(0D, 0D, 1D))")
    m = F.expr("array(array(1D, 0D, 0D, 1D), array(0D, 1D, 0D, 2D), array(0D, 0D, 1D, 3D))")
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    depth = e[2] + 2.0
    world = G.depth_to_world(e[0], e[1], depth, k, m)
    rows = G.quaternion_matrix((F.lit(1.0), e[3], e[4], e[5]))
    p = (e[0], e[1], depth)
    turned = [rows[i][0] * p[0] + rows[i][1] * p[1] + rows[i][2] * p[2] for i in range(3)]
    return load(spark, folder, "embeddings").select(
        "vec_id", *[c.alias(n) for c, n in zip(world, ("wx", "wy", "wz"))], *[c.alias(n) for c, n in zip(turned, ("rx", "ry", "rz"))]
    )


@query(
    "l_orderkey:i l_linenumber:i hx:f6 hy:f6 kx:f6 ky:f6 cell:i nx:f6 ox:f6",
    """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS u, l_discount * 100 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber,
  (u + 0.5) * (CAST(43 AS DOUBLE) / 40) - 0.5 - 5 AS hx, (v + 0.5) * (CAST(32 AS DOUBLE) / 30) - 0.5 - 0 AS hy,
  u * (CAST(32 AS DOUBLE) / 30) - (40 * (CAST(32 AS DOUBLE) / 30) - 32.0) / 2 AS kx, v * (CAST(32 AS DOUBLE) / 30) - (30 * (CAST(32 AS DOUBLE) / 30) - 32.0) / 2 AS ky,
  least(greatest(CAST(floor((u + 0.5) * 8.0 / 32.0) AS INTEGER), 0), 7) AS cell,
  CASE WHEN u < 40 THEN u / 40 END AS nx, 3 + u / 50.0 * 7 AS ox FROM p""",
)
def cover_crop(spark, folder):
    """Both resize-and-crop conventions, grid cell, image-relative and crop coordinates."""
    u, v = F.col("l_quantity"), F.col("l_discount") * 100
    size = (F.lit(40), F.lit(30))
    hx, hy = G.cover_crop(u, v, size, (32, 32))
    kx, ky = G.cover_crop_corner(u, v, size, (32, 32))
    nx, _ = G.normalise_point(u, v, F.lit(40), F.lit(30), u < 40)
    ox, _ = G.crop_to_image(u, v, (F.lit(3), F.lit(4), F.lit(10), F.lit(12)), F.lit(50.0))
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", hx.alias("hx"), hy.alias("hy"), kx.alias("kx"), ky.alias("ky"),
        G.pixel_cell(u, 32, 8).alias("cell"), nx.alias("nx"), ox.alias("ox"),
    )


@query(
    "vec_id:i body:i f0:f6 f3:f6 f6:f6 f7:f6 f8:f6 dx:f5 dz:f5",
    """
SELECT vec_id, label % 2 AS body, asinh(CAST(embedding[1] AS DOUBLE)) AS f0, CAST(embedding[4] AS DOUBLE) AS f3,
  CASE WHEN label % 2 = 0 THEN ln(1 + greatest(CAST(embedding[7] AS DOUBLE), 0)) ELSE 0 END AS f6,
  CASE WHEN label % 2 = 0 THEN least(greatest(CAST(embedding[8] AS DOUBLE), 0), 1) ELSE 0 END AS f7,
  0.5 AS f8, round_even(CAST(embedding[1] AS DOUBLE), 5) AS dx, round_even(-CAST(embedding[2] AS DOUBLE), 5) AS dz FROM embeddings""",
)
def scene_features(spark, folder):
    """Numeric features of scene points and their viewer orientation."""
    e = [F.col("embedding")[i].cast("double") for i in range(8)]
    body = F.col("label") % 2
    f = condition.scene_features((e[0], e[1], e[2]), (e[3], e[4], e[5]), body, e[6], e[7], F.array_repeat(F.lit(0.5), 4))
    shown = G.display_axes(e[0], e[1], e[2])
    points = load(spark, folder, "embeddings").select("vec_id", body.alias("body"), f.alias("f"), shown[0].alias("dx"), shown[2].alias("dz"))
    return points.select("vec_id", "body", *[F.col("f")[i].alias(f"f{i}") for i in (0, 3, 6, 7, 8)], "dx", "dz")


@query(
    "sample_id:s passed:b skipped:i failures:s",
    f"""WITH {TRACK_SQL}, s AS (SELECT DISTINCT sample_id FROM points)
SELECT sample_id, false AS passed, 9 AS skipped,
       CASE WHEN CAST(sample_id AS INTEGER) % 4 = 1 THEN 'scene_initial_identity' ELSE '' END AS failures FROM s""",
)
def roundtrip_audit(spark, folder):
    """Inverse projection, colours, both raster paths, pooling and occlusion probes per sample."""
    points = track_points(spark, folder).withColumns({"wx": F.col("cx"), "wy": -F.col("cy"), "wz": F.col("cz")})
    cameras = points.select("sample_id").distinct().select(
        "sample_id", F.lit(None).cast("int").alias("frame"),
        F.expr("array(array(1D,0D,0D,0D), array(0D,-1D,0D,0D), array(0D,0D,1D,0D), array(0D,0D,0D,1D))").alias("m"), F.expr(CAMERA).alias("k"),
    )
    meta = track_meta(points).withColumn("metadata", F.parse_json(F.lit("{}")))
    initial = track_initial(points)
    shift = F.when(F.col("sample_id").cast("int") % 4 == 1, 0.01).otherwise(0.0)
    scene = initial.select("sample_id", "slot", "point_id", (F.col("ix") + shift).alias("x"), F.col("iy").alias("y"), F.col("iz").alias("z"))
    arrow = raster.identity_tracks(points, initial, meta, GRID, PREPROCESS)
    direct = raster.identity_tracks(points, initial, meta, GRID, PREPROCESS, method="sql")
    parts = [
        audit.unprojection_error(points, cameras, meta),
        audit.colour_inverse_error(initial),
        audit.initial_error(scene, initial),
        audit.cell_difference(arrow, direct),
        audit.occlusion_probe(points, initial, cameras, meta, GRID, PREPROCESS),
    ]
    out = audit.roundtrip_audit(track_meta(points), parts)
    return out.withColumns({"failures": F.array_join("failures", ","), "skipped": F.size("skipped")})


#: Faults of every eighth sample, in order: none, scene points, clock, pose, normals, material, pooled map, mask.
RIGID_SQL = """
v AS (SELECT vec_id // 64 AS s, (vec_id // 64) % 8 AS kind, vec_id % 64 AS point_id, label % 3 AS slot, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT *, 0.5 * e[1] + 0.02 * f AS x, 0.5 * e[2] AS y, 0.5 * e[3] + 2 AS z FROM v, range(5) t(f)),
t AS (SELECT *, (20 * x + 20 * z) / z AS u, (-20 * y + 15 * z) / z AS w FROM p),
m AS (SELECT DISTINCT s, f, CAST(round_even(u, 0) AS BIGINT) + CASE kind WHEN 7 THEN 18 ELSE 0 END AS mx, CAST(round_even(w, 0) AS BIGINT) AS my FROM t WHERE slot = 0),
centre AS (
  SELECT a.s, max(sqrt(power(a.mx - b.u, 2) + power(a.my - b.w, 2))) AS c FROM (SELECT s, f, avg(mx) AS mx, avg(my) AS my FROM m GROUP BY s, f) a
  JOIN (SELECT s, f, median(u) AS u, median(w) AS w FROM t WHERE slot = 0 GROUP BY s, f) b ON a.s = b.s AND a.f = b.f GROUP BY a.s)"""


@query(
    "sample_id:i passed:b skipped:i failures:s time_error:f6 quaternion_norm_error:f6 normal_unit_max_error:f6 containment_min:f6 centroid_error_max_px:f4",
    f"""WITH {RIGID_SQL}
SELECT v.s AS sample_id, kind = 0 AS passed, 0 AS skipped,
  CASE kind WHEN 0 THEN '' WHEN 1 THEN 'scene_initial_identity' WHEN 2 THEN 'raw_time' WHEN 3 THEN 'quaternion_norm' WHEN 4 THEN 'unit_normals' WHEN 5 THEN 'environment_material_range'
    WHEN 6 THEN 'temporal_window_semantics' ELSE 'source_mask_containment,source_mask_centroid,latent_mask_alignment' END AS failures,
  CASE kind WHEN 2 THEN 0.001 ELSE 0 END AS time_error, CASE kind WHEN 3 THEN 0.001 ELSE 0 END AS quaternion_norm_error, CASE kind WHEN 4 THEN 0.01 ELSE 0 END AS normal_unit_max_error,
  CASE kind WHEN 7 THEN 0 ELSE 1 END AS containment_min, any_value(c) AS centroid_error_max_px
FROM v JOIN centre ON v.s = centre.s GROUP BY v.s, kind""",
)
def roundtrip_verdict(spark, folder):
    """All checks over rigid tracks; every kind of fault is planted in one sample of eight."""
    frame = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("frame")
    base = load(spark, folder, "embeddings").select("vec_id", "label", "embedding", frame)
    e = [F.col("embedding")[i].cast("double") for i in range(9)]
    kind = F.col("sample_id").cast("long") % 8
    x, y, z = 0.5 * e[0] + 0.02 * F.col("frame"), 0.5 * e[1], 0.5 * e[2] + 2.0
    u, v = (20.0 * x + 20.0 * z) / z, (-20.0 * y + 15.0 * z) / z
    length = G.norm(*e[3:6])
    every = base.select(
        F.floor(F.col("vec_id") / 64).cast("string").alias("sample_id"), "frame", (F.col("label") % 3).cast("int").alias("slot"), (F.col("vec_id") % 64).cast("int").alias("point_id"),
        x.alias("cx"), y.alias("cy"), z.alias("cz"), x.alias("wx"), (-y).alias("wy"), z.alias("wz"), u.alias("u"), v.alias("v"), z.alias("depth"), F.lit(True).alias("valid"),
        *[(n / length).alias(f"n{a}") for n, a in zip(e[3:6], "xyz")], F.abs(e[6]).alias("friction"), F.abs(e[7]).alias("restitution"),
    )
    points = every.drop("nx", "ny", "nz", "friction", "restitution")
    samples = points.select("sample_id").distinct()
    frames = samples.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(4))))
    meta = samples.select(
        "sample_id", F.lit(5).alias("frames"), F.lit(40).alias("width"), F.lit(30).alias("height"), F.parse_json(F.lit("{}")).alias("metadata"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i / F.lit(24.0)).alias("time_s"),
    )
    cameras = samples.select(
        "sample_id", F.lit(None).cast("int").alias("frame"),
        F.expr("array(array(1D,0D,0D,0D), array(0D,-1D,0D,0D), array(0D,0D,1D,0D), array(0D,0D,0D,1D))").alias("m"), F.expr(CAMERA).alias("k"),
    )
    slots = frames.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2))))
    poses = slots.select(
        "sample_id", "slot", "frame", (0.02 * F.col("frame")).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"),
        F.when(kind == 3, 1.001).otherwise(1.0).alias("qw"), *[F.lit(0.0).alias(q) for q in ("qx", "qy", "qz")],
    )
    clock = frames.select("sample_id", "frame", (F.col("frame") / 24.0 + F.when((kind == 2) & (F.col("frame") == 3), 0.001).otherwise(0.0)).alias("t"))
    initial = track_initial(points)
    scene = every.where("frame = 0").select(
        "sample_id", "slot", "point_id", (F.col("cx") + F.when(kind == 1, 0.01).otherwise(0.0)).alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"),
        *[(F.col(n) * F.when(kind == 4, 1.01).otherwise(1.0)).alias(n) for n in ("nx", "ny", "nz")], F.lit(0).alias("body"), "friction",
        (F.col("restitution") + F.when((kind == 5) & (F.col("point_id") == 7), 1.5).otherwise(0.0)).alias("restitution"),
    )
    # every raster is used by several checks, so it is drawn once
    drawn = cut_lineage(raster.identity_tracks(points, initial, meta, GRID, PREPROCESS))
    pooled = sequence.temporal_pool4(drawn, ["sample_id", "slot", "cy", "cx"], ["r", "g", "b", "visible"])
    pooled = pooled.withColumn("r", F.col("r") + F.when((kind == 6) & (F.col("latent") == 1), 0.01).otherwise(0.0))
    first = F.col("slot") == 0
    mask = points.where(first).select("sample_id", "frame", (F.rint("u") + F.when(kind == 7, 18).otherwise(0)).cast("int").alias("x"), F.rint("v").cast("int").alias("y")).distinct()
    parts = [
        audit.unprojection_error(points, cameras, meta),
        audit.colour_inverse_error(initial),
        audit.initial_error(scene, initial),
        audit.cell_difference(drawn, raster.identity_tracks(points, initial, meta, GRID, PREPROCESS, method="sql")),
        audit.occlusion_probe(points, initial, cameras, meta, GRID, PREPROCESS),
        audit.clock_error(meta, clock),
        audit.rigid_drift(points, poses),
        clouds.normals_and_materials(scene, "sample_id"),
        masks.mask_consistency(points.where(first), drawn.where(first), mask, (40, 30), PREPROCESS, GRID),
        audit.window_error(drawn, pooled),
    ]
    out = audit.roundtrip_audit(meta, parts)
    return out.withColumns({"failures": F.array_join("failures", ","), "skipped": F.size("skipped")})


@query(
    "scene:i normal_unit_max_error:f6 unit_normals:b materials_in_range:b",
    """
WITH p AS (
  SELECT label AS scene, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
         abs(CAST(embedding[4] AS DOUBLE)) AS f, abs(CAST(embedding[5] AS DOUBLE)) + CASE WHEN label = 3 THEN 1 ELSE 0 END AS r FROM embeddings)
SELECT scene, max(abs(sqrt(x * x + y * y + z * z) - 1)) AS normal_unit_max_error,
       max(abs(sqrt(x * x + y * y + z * z) - 1)) < 1e-4 AS unit_normals, min(f) >= 0 AND min(r) >= 0 AND max(r) <= 1 AS materials_in_range
FROM p GROUP BY scene""",
)
def normals_and_materials(spark, folder):
    """Unit-normal and material range checks per label."""
    e = [F.col("embedding")[i].cast("double") for i in range(5)]
    points = load(spark, folder, "embeddings").select(
        F.col("label").alias("scene"), e[0].alias("nx"), e[1].alias("ny"), e[2].alias("nz"), F.lit(0).alias("body"),
        F.abs(e[3]).alias("friction"), (F.abs(e[4]) + F.when(F.col("label") == 3, 1).otherwise(0)).alias("restitution"),
    )
    return clouds.normals_and_materials(points)
