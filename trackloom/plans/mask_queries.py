"""Mask, hole and gate operators over pixel sets and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import quantiles
from trackloom.operators import gates, masks, raster
from trackloom.plans.spec import query
from trackloom.plans.tables import GRID_SQL, SIDE, grid_points, load

PIXELS_SQL = f"{GRID_SQL}, p AS (SELECT DISTINCT frame, y, x FROM grid)"


def pixel_set(spark, folder):
    return grid_points(spark, folder).select("frame", "y", "x").distinct()


@query(
    "frame:i y:i x:i",
    f"""WITH {PIXELS_SQL}
SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM p, range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)
WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31""",
)
def dilate(spark, folder):
    """Square dilation by two pixels of each label's pixel set."""
    return masks.dilate(pixel_set(spark, folder), ["frame"], masks.square_spans(2), SIDE, SIDE)


@query(
    "frame:i y:i x:i",
    f"""WITH {PIXELS_SQL},
big AS (SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM p, range(-3, 4) AS a(dy), range(-3, 4) AS b(dx)
        WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31),
kernel AS (SELECT frame, y, x, y + dy AS ny, x + dx AS nx FROM big, range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)
           WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31)
SELECT k.frame, k.y, k.x FROM kernel k LEFT JOIN big ON big.frame = k.frame AND big.y = k.ny AND big.x = k.nx
GROUP BY k.frame, k.y, k.x HAVING count(*) = count(big.x)""",
)
def erode(spark, folder):
    """Erosion of a dilated set; the image border does not erode."""
    big = masks.dilate(pixel_set(spark, folder), ["frame"], masks.square_spans(3), SIDE, SIDE)
    return masks.erode(big, ["frame"], 1, SIDE, SIDE)


@query(
    "frame:i y:i x:i",
    f"""WITH {PIXELS_SQL},
b AS (SELECT frame, greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) AS extent FROM p GROUP BY frame),
r AS (SELECT frame, least(greatest(CAST(round_even(extent * 0.15, 0) AS INTEGER), 3), 32) AS r FROM b),
k AS (SELECT frame, r, dy, CAST(round_even(r * sqrt((r * r - dy * dy) / CAST(r * r AS DOUBLE)), 0) AS INTEGER) AS hw
      FROM r, range(-32, 33) AS t(dy) WHERE abs(dy) <= r),
grown AS (
  SELECT DISTINCT p.frame, p.y + k.dy AS y, p.x + dx AS x FROM p JOIN k ON p.frame = k.frame, range(-32, 33) AS u(dx)
  WHERE abs(dx) <= hw AND p.y + k.dy BETWEEN 0 AND 31 AND p.x + dx BETWEEN 0 AND 31)
SELECT * FROM grown WHERE y >= 4 AND y < 28""",
)
def expand_hole(spark, folder):
    """Elliptic growth by fifteen percent of the extent, inside the content rows."""
    mask = pixel_set(spark, folder)
    content = mask.select("frame").distinct().withColumn("y", F.explode(F.sequence(F.lit(4), F.lit(27)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    )
    return masks.expand_hole(mask, content, ["frame"], SIDE, SIDE)


@query(
    "frame:i y_min:i y_max:i x_min:i x_max:i x0:i y0:i x1:i y1:i",
    f"""WITH {PIXELS_SQL},
b AS (SELECT frame, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM p GROUP BY frame),
q AS (SELECT *, greatest(8, CAST(round_even(greatest(x_max - x_min + 1, y_max - y_min + 1) * 0.12, 0) AS INTEGER)) AS pad FROM b)
SELECT *, greatest(x_min - pad, 0) AS x0, greatest(y_min - pad, 0) AS y0, least(x_max + pad + 1, 32) AS x1, least(y_max + pad + 1, 32) AS y1 FROM q""",
)
def padded_box(spark, folder):
    """Bounds and padded crop box of each label's pixel set."""
    return masks.padded_box(masks.mask_bounds(pixel_set(spark, folder), ["frame"]), SIDE, SIDE)


@query(
    "frame:i intersection:i union_pixels:i iou:f6",
    f"""WITH {PIXELS_SQL},
j AS (
  SELECT coalesce(a.frame, b.frame - 1) AS frame, a.x IS NOT NULL AND b.x IS NOT NULL AS shared
  FROM p a FULL JOIN p b ON a.frame = b.frame - 1 AND a.y = b.y AND a.x = b.x)
SELECT frame, count(*) FILTER (shared) AS intersection, count(*) AS union_pixels,
       count(*) FILTER (shared) / greatest(count(*), 1) AS iou FROM j GROUP BY frame""",
)
def mask_iou(spark, folder):
    """Overlap of each label's pixel set with the next label's."""
    a = pixel_set(spark, folder)
    b = a.withColumn("frame", F.col("frame") - 1)
    return masks.mask_iou(a, b, ["frame"]).withColumnRenamed("union", "union_pixels")


@query("frame:i y:i x:i", f"WITH {PIXELS_SQL} SELECT frame, y, x FROM p UNION SELECT frame - 1, y, x FROM p")
def union_masks(spark, folder):
    """Logical or of each label's mask with the next one's."""
    a = pixel_set(spark, folder)
    return raster.union_masks([a, a.withColumn("frame", F.col("frame") - 1)])


@query(
    "frame:i y:i x:i relative_error:f5",
    f"""WITH {GRID_SQL},
d AS (SELECT frame, y, x, CAST(min(e3) + 2.0 AS FLOAT) AS depth, min(point_id) % 2 = 0 AS completed FROM grid GROUP BY 1, 2, 3)
SELECT a.frame, a.y, a.x, min(abs(a.depth - b.depth) / greatest(b.depth, CAST(1e-8 AS FLOAT))) AS relative_error
FROM d a JOIN d b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)
WHERE a.completed AND NOT b.completed GROUP BY 1, 2, 3""",
)
def neighbour_min(spark, folder):
    """Best relative depth error of completed pixels against observed neighbours, radius 1."""
    return masks.neighbour_min(_seam_pixels(spark, folder), ["frame"], radius=1, tile=8)


def _seam_pixels(spark, folder):
    return grid_points(spark, folder).groupBy("frame", "y", "x").agg(
        (F.min("e3") + 2.0).cast("float").alias("depth"), (F.min("point_id") % 2 == 0).alias("completed")
    ).withColumn("reference", F.col("depth")).withColumn("observed", ~F.col("completed"))


@query(
    "frame:i pixel_count:i median_relative_error:f5 p90_relative_error:f5 enough:b",
    f"""WITH {GRID_SQL},
d AS (SELECT frame, y, x, CAST(min(e3) + 2.0 AS FLOAT) AS depth, min(point_id) % 2 = 0 AS completed FROM grid GROUP BY 1, 2, 3),
e AS (
  SELECT a.frame, a.y, a.x, min(abs(a.depth - b.depth) / greatest(b.depth, CAST(1e-8 AS FLOAT))) AS r
  FROM d a JOIN d b ON a.frame = b.frame AND abs(a.y - b.y) <= 8 AND abs(a.x - b.x) <= 8 AND (a.y <> b.y OR a.x <> b.x)
  WHERE a.completed AND NOT b.completed GROUP BY 1, 2, 3)
SELECT frame, count(*) AS pixel_count, quantile_cont(CAST(r AS DOUBLE), 0.5) AS median_relative_error,
       quantile_cont(CAST(r AS DOUBLE), 0.9) AS p90_relative_error, count(*) >= 32 AS enough FROM e GROUP BY frame""",
)
def seam_report(spark, folder):
    """Depth-seam statistics within eight pixels."""
    return masks.seam_report(masks.neighbour_min(_seam_pixels(spark, folder), ["frame"]), ["frame"])


@query(
    "scene:s completion_replaces_observed:i dense_is_not_union:i dense_outside_content:i hole_outside_content:i "
    "completion_outside_hole:i reliable_not_observed:i completed_depth_not_positive:i depth_outside_completion:i",
    """
WITH m AS (
  SELECT l_returnflag AS scene, l_quantity > 10 AS o, l_linestatus = 'F' AS c, l_discount > 0.02 AS d, l_tax > 0.01 AS h,
         l_quantity < 48 AS n, l_quantity > 12 AND l_tax < 0.08 AS r, l_extendedprice - 2000 AS depth FROM lineitem)
SELECT scene, count(*) FILTER (o AND c) AS completion_replaces_observed, count(*) FILTER (d <> (o OR c)) AS dense_is_not_union,
  count(*) FILTER (d AND NOT n) AS dense_outside_content, count(*) FILTER (h AND NOT n) AS hole_outside_content,
  count(*) FILTER (c AND NOT h) AS completion_outside_hole, count(*) FILTER (r AND NOT o) AS reliable_not_observed,
  count(*) FILTER (c AND NOT depth > 0) AS completed_depth_not_positive, count(*) FILTER (NOT c AND depth <> 0) AS depth_outside_completion
FROM m GROUP BY scene""",
)
def mask_algebra(spark, folder):
    """Violations of the set rules between boolean masks."""
    pixels = load(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("scene"),
        (F.col("l_quantity") > 10).alias("observed"),
        (F.col("l_linestatus") == "F").alias("completed"),
        (F.col("l_discount") > 0.02).alias("dense"),
        (F.col("l_tax") > 0.01).alias("hole"),
        (F.col("l_quantity") < 48).alias("content"),
        ((F.col("l_quantity") > 12) & (F.col("l_tax") < 0.08)).alias("reliable"),
        (F.col("l_extendedprice") - 2000).alias("depth"),
        F.lit(0.0).alias("raw_depth"),
    )
    return masks.mask_algebra(pixels)


@query(
    "scene:s object_mask_completion_fraction:f6 missing_environment_completion_fraction:f6 content_surface_coverage:f6 "
    "observed_pixel_count:i reliable_observed_pixel_count:i completed_pixel_count:i content_pixel_count:i",
    """
WITH m AS (
  SELECT l_returnflag AS scene, l_tax > 0.04 AS o, l_quantity < 48 AS c, l_quantity > 10 AS s, l_quantity > 12 AS r,
         l_quantity <= 10 AND l_discount > 0.02 AS m FROM lineitem)
SELECT scene, count(*) FILTER (m AND o) / greatest(count(*) FILTER (o), 1) AS object_mask_completion_fraction,
  count(*) FILTER (m) / greatest(count(*) FILTER (c AND NOT s), 1) AS missing_environment_completion_fraction,
  count(*) FILTER (s OR m) / greatest(count(*) FILTER (c), 1) AS content_surface_coverage,
  count(*) FILTER (s) AS observed_pixel_count, count(*) FILTER (r) AS reliable_observed_pixel_count,
  count(*) FILTER (m) AS completed_pixel_count, count(*) FILTER (c) AS content_pixel_count FROM m GROUP BY scene""",
)
def completion_stats(spark, folder):
    """Completion and coverage fractions per scene."""
    q = F.col("l_quantity")
    return gates.completion_stats(
        load(spark, folder, "lineitem").select(
            F.col("l_returnflag").alias("scene"), (F.col("l_tax") > 0.04).alias("object"), (q < 48).alias("content"),
            (q > 10).alias("observed"), (q > 12).alias("reliable"), ((q <= 10) & (F.col("l_discount") > 0.02)).alias("completed"),
        )
    )


@query(
    "scene:s known_pixel_count:i requested_pixel_count:i positive_pixel_count:i positive_completion_fraction:f6 "
    "median_relative_error:f6 p90_relative_error:f6",
    """
WITH m AS (
  SELECT l_linestatus AS scene, l_quantity AS k, l_quantity * (1 + l_discount - l_tax) AS p, l_returnflag = 'R' AS h FROM lineitem),
e AS (SELECT *, CASE WHEN NOT h AND k > 0 THEN abs(p - k) / greatest(k, 1e-8) END AS e FROM m)
SELECT scene, count(e) AS known_pixel_count, count(*) FILTER (h) AS requested_pixel_count, count(*) FILTER (h AND p > 0) AS positive_pixel_count,
       count(*) FILTER (h AND p > 0) / greatest(count(*) FILTER (h), 1) AS positive_completion_fraction,
       quantile_cont(e, 0.5) AS median_relative_error, quantile_cont(e, 0.9) AS p90_relative_error FROM e GROUP BY scene""",
)
def known_depth_error(spark, folder):
    """Relative error on known values and completion of the requested ones."""
    q = F.col("l_quantity")
    return masks.known_depth_error(
        load(spark, folder, "lineitem").select(
            F.col("l_linestatus").alias("scene"), q.alias("known_depth"),
            (q * (F.lit(1) + F.col("l_discount") - F.col("l_tax"))).alias("predicted"), (F.col("l_returnflag") == "R").alias("hole"),
        )
    )


@query(
    "scene:s object_depth:f6 depth_error:f6 relative_depth_error:f6",
    """
WITH m AS (SELECT l_returnflag AS scene, l_quantity AS d, l_quantity * (1 + l_tax) AS rd, l_linestatus = 'O' AS o, l_discount > 0.03 AS r FROM lineitem),
a AS (SELECT scene, quantile_cont(d, 0.5) AS object_depth FROM m WHERE o GROUP BY scene),
b AS (SELECT scene, quantile_cont(abs(rd - d), 0.5) AS depth_error FROM m WHERE o AND r GROUP BY scene)
SELECT a.scene, object_depth, depth_error, depth_error / object_depth AS relative_depth_error FROM a LEFT JOIN b ON a.scene = b.scene""",
)
def mesh_depth_error(spark, folder):
    """Median depth difference on the overlap, relative to the object's median depth."""
    q = F.col("l_quantity")
    return masks.mesh_depth_error(
        load(spark, folder, "lineitem").select(
            F.col("l_returnflag").alias("scene"), (F.col("l_discount") > 0.03).alias("rendered"), (q * (F.lit(1) + F.col("l_tax"))).alias("rendered_depth"),
            (F.col("l_linestatus") == "O").alias("object"), q.alias("depth"),
        )
    )


@query(
    "frame:i y:i x:i depth:f6 filled:b",
    f"""WITH {GRID_SQL},
d AS (SELECT frame, y, x, CAST(min(e3) + 2.0 AS FLOAT) AS depth, min(point_id) % 3 = 0 AS hole, CAST(max(e2) AS FLOAT) AS predicted FROM grid GROUP BY 1, 2, 3)
SELECT frame, y, x, CASE WHEN hole AND predicted > 0 THEN predicted ELSE depth END AS depth, hole AND predicted > 0 AS filled FROM d""",
)
def merge_known(spark, folder):
    """Predicted depth inside holes, everything else bit-exact."""
    d = grid_points(spark, folder).groupBy("frame", "y", "x").agg(
        (F.min("e3") + 2.0).cast("float").alias("depth"), (F.min("point_id") % 3 == 0).alias("hole"), F.max("e2").cast("float").alias("predicted")
    )
    return masks.merge_known(d.select("frame", "y", "x", "depth"), d.select("frame", "y", "x", "predicted", "hole"), ["frame"])


def _dense_pixels(spark, folder):
    """All 32 x 32 pixels of every label, with a depth where a vector falls."""
    grid = grid_points(spark, folder)
    frames = grid.select("frame").distinct()
    canvas = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    known = grid.groupBy("frame", "y", "x").agg((F.min("e3") + 2.0).alias("depth"), F.min("point_id").alias("id"))
    return canvas.join(known, ["frame", "y", "x"], "left")


DENSE_SQL = f"""{GRID_SQL},
known AS (SELECT frame, y, x, min(e3) + 2.0 AS depth, min(point_id) AS id FROM grid GROUP BY 1, 2, 3),
dense AS (
  SELECT f.frame, b.y, c.x, depth, id FROM (SELECT DISTINCT frame FROM grid) f, range(32) AS b(y), range(32) AS c(x)
  LEFT JOIN known k ON k.frame = f.frame AND k.y = b.y AND k.x = c.x)"""


@query(
    "scene:i hole_pixels:i known_pixels:i content_pixels:i y0:i y1:i x0:i x1:i problem:s",
    f"""WITH {DENSE_SQL},
f AS (SELECT *, y BETWEEN 2 AND 29 AND NOT (frame = 4 AND y = 5 AND x = 5) AS content, (y + x) % 7 = 0 AS req FROM dense),
h AS (SELECT *, content AND (req OR depth IS NULL OR frame = 1) AS hole FROM f),
k AS (SELECT *, content AND NOT hole AS known FROM h),
r AS (
  SELECT frame AS scene, count(*) FILTER (hole) AS hole_pixels, count(*) FILTER (known) AS known_pixels, count(*) FILTER (content) AS content_pixels,
    min(y) FILTER (content) AS y0, max(y) FILTER (content) + 1 AS y1, min(x) FILTER (content) AS x0, max(x) FILTER (content) + 1 AS x1 FROM k GROUP BY frame)
SELECT *, CASE WHEN hole_pixels < 32 THEN 'fewer than 32 hole pixels' WHEN known_pixels < 20 THEN 'fewer than 128 known pixels'
  WHEN content_pixels <> (y1 - y0) * (x1 - x0) THEN 'content is not one rectangle' END AS problem FROM r""",
)
def prepare_hole(spark, folder):
    """Hole and known pixels and the content rectangle of each image."""
    pixels = _dense_pixels(spark, folder).select(
        F.col("frame").alias("scene"), "y", "x",
        F.when(F.col("frame") != 1, F.col("depth")).alias("depth"),
        ((F.col("y") + F.col("x")) % 7 == 0).alias("requested"),
        (F.col("y").between(2, 29) & ~((F.col("frame") == 4) & (F.col("y") == 5) & (F.col("x") == 5))).alias("content"),
    )
    report = masks.prepare_hole(pixels)[1]
    # These images are far smaller than real ones, so the known-pixel floor is restated.
    low = F.when(F.col("known_pixels") < 20, F.lit("fewer than 128 known pixels")).when(
        F.col("content_pixels") != (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")), F.lit("content is not one rectangle")
    )
    return report.withColumn("problem", F.when(F.col("hole_pixels") < 32, F.col("problem")).otherwise(low))


@query(
    "scene:i finite_points:i environment_points:i object_points:i object_candidates:i omitted_boundary_points:i "
    "confidence_threshold:f6 object_confidence_threshold:f6",
    f"""WITH {GRID_SQL},
pix AS (SELECT frame, y, x, min(e3) + 2.0 AS depth, abs(min(e2)) AS conf, y BETWEEN 8 AND 19 AND x BETWEEN 8 AND 19 AS object FROM grid GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT frame, y, x FROM pix WHERE object),
near AS (SELECT DISTINCT frame, y + a.d AS y, x + b.d AS x FROM m, range(-2, 3) AS a(d), range(-2, 3) AS b(d)),
f AS (SELECT p.*, n.x IS NULL AS env FROM pix p LEFT JOIN near n ON p.frame = n.frame AND p.y = n.y AND p.x = n.x),
t AS (SELECT frame, quantile_cont(conf, 0.25) FILTER (env) AS ct, quantile_cont(conf, 0.25) FILTER (object) AS ot FROM f GROUP BY frame)
SELECT f.frame AS scene, count(*) AS finite_points, count(*) FILTER (env) AS environment_points, count(*) FILTER (object AND conf >= ot) AS object_points,
  count(*) FILTER (object) AS object_candidates, count(*) FILTER (NOT env AND NOT (object AND conf >= ot)) AS omitted_boundary_points,
  any_value(ct) AS confidence_threshold, any_value(ot) AS object_confidence_threshold
FROM f JOIN t ON f.frame = t.frame GROUP BY f.frame""",
)
def split_scene(spark, folder):
    """Object core and environment pixels with separate confidence cuts."""
    pixels = grid_points(spark, folder).groupBy(F.col("frame").alias("scene"), "y", "x").agg(
        (F.min("e3") + 2.0).alias("depth"), F.abs(F.min("e2")).alias("confidence")
    ).select(
        "*", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.col("depth").alias("pz"),
        (F.col("y").between(8, 19) & F.col("x").between(8, 19)).alias("object"), F.lit(True).alias("content"),
    )
    return masks.split_scene(pixels, SIDE, SIDE, 0.25)[1]


@query(
    "scene:i y:i x:i completed:b dense:b completed_depth:f6 wz:f6",
    f"""WITH {DENSE_SQL},
f AS (SELECT frame AS scene, y, x, y < 30 AS content, depth IS NOT NULL AND id % 2 = 0 AND y < 30 AS observed, id % 3 = 0 AND y < 30 AS hole, depth FROM dense WHERE depth IS NOT NULL)
SELECT scene, y, x, content AND NOT observed AND hole AS completed, observed OR (content AND NOT observed AND hole) AS dense,
  CASE WHEN content AND NOT observed AND hole THEN CAST(depth AS FLOAT) ELSE 0 END AS completed_depth,
  CASE WHEN content AND NOT observed AND hole THEN CAST(depth - 3.0 AS FLOAT) END AS wz FROM f""",
)
def complete_environment(spark, folder):
    """Completed pixels and their world points; observed pixels stay."""
    known = _dense_pixels(spark, folder).filter("depth is not null")
    pixels = known.select(
        F.col("frame").alias("scene"), "y", "x", F.lit(False).alias("object"), (F.col("y") < 30).alias("content"),
        (F.col("id") % 2 == 0).alias("observed"), F.lit(True).alias("reliable"), (F.col("id") % 3 == 0).alias("hole"), F.col("depth").alias("predicted"),
    )
    cameras = pixels.select("scene").distinct().select(
        "scene", F.expr("array(array(20D, 0D, 16D), array(0D, 20D, 16D), array(0D, 0D, 1D))").alias("k"),
        F.expr("array(array(1D,0D,0D,0D), array(0D,1D,0D,0D), array(0D,0D,1D,3D), array(0D,0D,0D,1D))").alias("extrinsic"),
    )
    return masks.complete_environment(pixels, cameras)


@query(
    "sample_id:i frame:i y:i x:i",
    f"""WITH {GRID_SQL},
c AS (SELECT DISTINCT frame AS sample_id, 0 AS frame, y // 4 AS cy, x // 4 AS cx FROM grid),
p AS (SELECT sample_id, frame, py AS y, px AS x FROM c JOIN range(24) AS a(py) ON py * 8 // 24 = cy JOIN range(40) AS b(px) ON px * 8 // 40 = cx)
SELECT DISTINCT sample_id, frame, y + dy AS y, x + dx AS x FROM p, range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)
WHERE y + dy BETWEEN 0 AND 23 AND x + dx BETWEEN 0 AND 39""",
)
def object_mask_video(spark, folder):
    """Cells enlarged to 40 x 24 video pixels and dilated by one."""
    cells = grid_points(spark, folder).select(
        F.col("frame").alias("sample_id"), F.lit(0).alias("frame"), F.floor(F.col("y") / 4).cast("int").alias("cy"), F.floor(F.col("x") / 4).cast("int").alias("cx")
    ).distinct()
    return masks.object_mask_video(cells, None, (8, 8), (40, 24), 1)


@query(
    "sample_id:i frame:i containment:f6",
    f"""WITH {PIXELS_SQL}, g AS (SELECT * FROM grid),
placed AS (SELECT frame, CAST(round_even((e1 + 1.0) * 16.0, 0) AS INTEGER) AS x, CAST(round_even((e2 + 1.0) * 16.0, 0) AS INTEGER) AS y FROM g)
SELECT a.frame AS sample_id, 0 AS frame, avg(CASE WHEN p.x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS containment
FROM placed a LEFT JOIN p ON p.frame = a.frame AND p.x = a.x AND p.y = a.y WHERE a.x BETWEEN 0 AND 31 AND a.y BETWEEN 0 AND 31 GROUP BY a.frame""",
)
def points_in_mask(spark, folder):
    """Share of rounded points that fall into the floor-pixel mask."""
    grid = grid_points(spark, folder)
    points = grid.select(
        F.col("frame").alias("sample_id"), F.lit(0).alias("frame"), ((F.col("e1") + 1.0) * 16.0).alias("u"), ((F.col("e2") + 1.0) * 16.0).alias("v"), F.lit(True).alias("valid")
    )
    mask = grid.select(F.col("frame").alias("sample_id"), F.lit(0).alias("frame"), "y", "x").distinct()
    return masks.points_in_mask(points, mask, SIDE, SIDE)


GATE_SQL = """
scenes AS (
  SELECT s_suppkey AS scene, abs(s_acctbal) % 100 / 100.0 AS iou, CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE abs(s_acctbal) % 10 / 200.0 END AS depth,
         abs(s_acctbal) % 50 / 50.0 AS hole, 0.9 + s_nationkey / 250.0 AS coverage, 0.98 + s_suppkey % 10 / 500.0 AS positive,
         s_nationkey / 200.0 AS known, abs(s_acctbal) % 20 / 100.0 AS seam, s_acctbal > 0 AS proxy FROM supplier),
reasons AS (
  SELECT scene, list_filter([CASE WHEN iou < 0.65 THEN 'mesh-mask' END, CASE WHEN depth IS NULL OR depth > 0.03 THEN 'depth' END,
    CASE WHEN hole < 0.8 THEN 'environment-hole' END, CASE WHEN coverage < 0.95 THEN 'environment-coverage' END,
    CASE WHEN positive < 0.99 THEN 'depthlab-missing' END, CASE WHEN known > 0.08 THEN 'depthlab-scale' END,
    CASE WHEN seam > 0.1 THEN 'environment-seam' END, CASE WHEN NOT proxy THEN 'support' END], lambda x: x IS NOT NULL) AS reasons FROM scenes)
"""


def _gate_scenes(spark, folder):
    bal, nation = F.abs("s_acctbal"), F.col("s_nationkey")
    return load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("scene"),
        (bal % 100 / 100.0).alias("aligned_mask_iou"),
        F.when(nation % 7 != 0, bal % 10 / 200.0).alias("relative_depth_error"),
        (bal % 50 / 50.0).alias("environment_completion_fraction"),
        (F.lit(0.9) + nation / 250.0).alias("environment_surface_coverage"),
        (F.lit(0.98) + F.col("s_suppkey") % 10 / 500.0).alias("positive_completion_fraction"),
        (nation / 200.0).alias("known_depth_error"),
        (bal % 20 / 100.0).alias("seam_p90_error"),
        (F.col("s_acctbal") > 0).alias("physical_proxy_verified"),
    )


@query(
    "scene:i passed:b reasons:s",
    f"WITH {GATE_SQL} SELECT scene, len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS reasons FROM reasons",
)
def quality_gate(spark, folder):
    """Pass flag and ordered failure reasons per scene."""
    scenes = gates.quality_gate(gates.failure_reasons(_gate_scenes(spark, folder)))
    return scenes.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "reason:s n:i",
    f"""WITH {GATE_SQL},
domain AS (SELECT unnest(['mesh-mask', 'depth', 'environment-hole', 'environment-coverage', 'depthlab-missing', 'depthlab-scale', 'environment-seam', 'support']) AS reason),
hits AS (SELECT unnest(reasons) AS reason FROM reasons)
SELECT d.reason, count(h.reason) AS n FROM domain d LEFT JOIN hits h ON d.reason = h.reason GROUP BY d.reason""",
)
def failure_counts(spark, folder):
    """Count per failure reason over the fixed list."""
    return gates.failure_counts(gates.failure_reasons(_gate_scenes(spark, folder)))


@query(
    "scene_count:i quality_pass_count:i environment_quality_pass_count:i",
    f"""WITH {GATE_SQL}
SELECT count(*) AS scene_count, count(*) FILTER (len(reasons) = 0) AS quality_pass_count,
  count(*) FILTER (NOT list_has_any(reasons, ['environment-hole', 'environment-coverage', 'depthlab-missing', 'depthlab-scale', 'environment-seam'])) AS environment_quality_pass_count
FROM reasons""",
)
def pass_counts(spark, folder):
    """Scenes that pass all gates and all environment gates."""
    return gates.pass_counts(gates.failure_reasons(_gate_scenes(spark, folder)))


@query(
    "p_brand:s p_partkey:i rank:i score:f6",
    """
WITH c AS (
  SELECT p_brand, p_partkey, p_size / 50.0 AS iou, p_retailprice % 100 / 100.0 AS stab, p_size / 250.0 AS area,
         p_size * 0.5 AS bx, p_size * 0.25 AS byy, 10.0 + p_size AS bw, 30.0 AS bh,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 3.0 + p_size / 25.0 END AS om FROM part),
s AS (
  SELECT p_brand, p_partkey, 1.6 * iou + 1.2 * stab + 0.6 * (area / greatest(bw * bh / (100.0 * 80.0), 1e-6))
    + 0.45 * (CASE WHEN om IS NOT NULL THEN tanh(greatest((5.0 - om) / 0.5, -2.0)) ELSE -1.0 END)
    + 0.35 * (CASE WHEN om IS NOT NULL THEN exp(-0.2 / greatest(abs(om), 1e-6)) ELSE 0.0 END)
    + (CASE WHEN NOT area BETWEEN 0.001 AND 0.22 THEN -4.0 ELSE -abs(ln(greatest(area, 1e-6) / 0.025)) * 0.35 END)
    - 1.2 * (sqrt(((bx + bw * 0.5) / 100.0 - 0.5) ** 2 + ((byy + bh * 0.5) / 80.0 - 0.5) ** 2) / sqrt(0.5))
    - 0.55 * greatest(ln(greatest(greatest(bw / greatest(bh, 1.0), bh / greatest(bw, 1.0)), 1.0) / 2.0), 0.0)
    - 2.0 * 0.01 AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s)
SELECT p_brand, p_partkey, rank, score FROM r WHERE rank <= 20""",
)
def candidate_ranking(spark, folder):
    """Twenty best-scored candidates per brand."""
    size = F.col("p_size").cast("double")
    scored = gates.candidate_score(
        load(spark, folder, "part").select(
            "p_brand", "p_partkey", (size / 50.0).alias("predicted_iou"), (F.col("p_retailprice") % 100 / 100.0).alias("stability_score"),
            (size / 250.0).alias("area_fraction"), (size * 0.5).alias("box_x"), (size * 0.25).alias("box_y"), (size + 10.0).alias("box_width"),
            F.lit(30.0).alias("box_height"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"), F.lit(0.01).alias("border_fraction"),
            F.lit(5.0).alias("scene_median"), F.lit(0.5).alias("scene_scale"),
            F.when(F.col("p_partkey") % 5 != 0, F.lit(3.0) + size / 25.0).alias("object_median"), F.lit(0.2).alias("object_scale"),
        )
    )
    return gates.rank_candidates(scored, "p_brand", "p_partkey")


@query(
    "p_brand:s view:i inliers:i error:f2",
    """
WITH views AS (SELECT p_brand, p_partkey AS v, p_size AS matches, p_type AS shape FROM part),
kept AS (SELECT * FROM views QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY matches DESC, shape, v) <= 10),
solved AS (SELECT p.p_brand, p_partkey AS v, p_size // 10 AS inliers, p_retailprice AS error FROM part p JOIN kept k ON p.p_brand = k.p_brand AND p.p_partkey = k.v)
SELECT p_brand, v AS view, inliers, error FROM solved QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY inliers DESC, error, v DESC) = 1""",
)
def best_solution(spark, folder):
    """Best pose per brand among the ten views with most matches."""
    part = load(spark, folder, "part")
    views = part.select("p_brand", F.col("p_partkey").alias("view"), F.col("p_size").alias("matches"), F.col("p_type").alias("shape"))
    solved = part.select("p_brand", F.col("p_partkey").alias("view"), F.floor(F.col("p_size") / 10).alias("inliers"), F.col("p_retailprice").alias("error"))
    return gates.best_solution(views, solved, "p_brand")


@query(
    "p_brand:s median:f4 scale:f4",
    """
WITH v AS (SELECT p_brand, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand, quantile_cont(x, 0.5) AS med FROM v GROUP BY p_brand),
d AS (SELECT v.p_brand, quantile_cont(abs(x - med), 0.5) AS mad FROM v JOIN m ON v.p_brand = m.p_brand GROUP BY v.p_brand)
SELECT m.p_brand, med AS median, greatest(1.4826 * mad, abs(med) * 1e-3, 1e-6) AS scale FROM m JOIN d ON m.p_brand = d.p_brand""",
)
def robust_scale(spark, folder):
    """Median and scaled MAD of prices per brand."""
    items = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return quantiles.robust_scale(items.select("p_brand", "l_extendedprice"), ["p_brand"], "l_extendedprice")


@query(
    "p_brand:s scale:f6 kept:i",
    """
WITH v AS (SELECT p_brand, l_extendedprice / l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_extendedprice > 0),
e AS (SELECT p_brand, quantile_cont(x, 0.15) AS lo, quantile_cont(x, 0.85) AS hi FROM v GROUP BY p_brand)
SELECT v.p_brand, quantile_cont(x, 0.5) AS scale, count(*) AS kept FROM v JOIN e ON v.p_brand = e.p_brand WHERE x >= lo AND x <= hi GROUP BY v.p_brand""",
)
def trimmed_median(spark, folder):
    """Trimmed median of unit prices per brand."""
    items = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ratio = F.try_divide("l_extendedprice", "l_quantity")
    return quantiles.trimmed_median(items.select("p_brand", ratio.alias("ratio")), ["p_brand"], "ratio")
