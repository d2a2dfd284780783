"""Point-cloud operators over the embedding values and streaming forms over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import clouds
from trackloom.plans.mask_queries import pixel_set
from trackloom.plans.spec import query
from trackloom.plans.tables import GRID_SQL, load
from trackloom.streaming.live import live_metrics

XYZ_SQL = """
v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
"""


def vectors(spark, folder):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return load(spark, folder, "embeddings").select("vec_id", "label", e[0].alias("x"), e[1].alias("y"), e[2].alias("z"))


@query(
    "vec_id:i nearest_id:i distance:f6",
    f"""WITH {XYZ_SQL},
d AS (SELECT a.vec_id, b.vec_id AS nearest_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance
      FROM v a JOIN v b ON a.label % 2 = 0 AND b.label % 2 = 1)
SELECT vec_id, nearest_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest_id) = 1""",
)
def nearest_neighbour(spark, folder):
    """Nearest visible vector (odd labels) of every hidden one (even labels)."""
    v = vectors(spark, folder)
    hidden, visible = v.filter("label % 2 = 0"), v.filter("label % 2 = 1").withColumnRenamed("vec_id", "nearest_id")
    return clouds.nearest(hidden, visible, "vec_id", "nearest_id")


@query(
    "vec_id:i nearest_id:i distance:f6",
    f"""WITH {XYZ_SQL},
d AS (SELECT a.vec_id, b.vec_id AS nearest_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance
      FROM v a JOIN v b ON a.label % 2 = 0 AND b.label % 2 = 1 AND a.vec_id % 5 > 1),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest_id) = 1)
SELECT v.vec_id, n.nearest_id, n.distance FROM v LEFT JOIN n ON v.vec_id = n.vec_id WHERE v.label % 2 = 0""",
)
def nearest_missing(spark, folder):
    """As nearest_neighbour, but a fifth of the queries has a NaN coordinate and a fifth a NULL one."""
    v = vectors(spark, folder)
    part = F.col("vec_id") % 5
    hidden = v.filter("label % 2 = 0").withColumn("x", F.when(part == 0, F.lit(float("nan"))).when(part != 1, F.col("x")))
    visible = v.filter("label % 2 = 1").withColumnRenamed("vec_id", "nearest_id")
    return clouds.nearest(hidden, visible, "vec_id", "nearest_id")


@query(
    "scene:i vec_id:i plane:i distance:f6",
    f"""WITH {XYZ_SQL},
planes AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 2.0, 0.5), (1, 1.0, 1.0, 0.0, 0.0), (2, 0.0, -3.0, 4.0, 5.0)) AS t(plane, a, b, c, d))
SELECT label AS scene, vec_id, plane, a / sqrt(a * a + b * b + c * c) * x + b / sqrt(a * a + b * b + c * c) * y
  + c / sqrt(a * a + b * b + c * c) * z + d / sqrt(a * a + b * b + c * c) AS distance FROM v, planes""",
)
def plane_distance(spark, folder):
    """Signed distance to three planes of every scene."""
    v = vectors(spark, folder).withColumnRenamed("label", "scene")
    return clouds.plane_distance(v, _planes(v), ["scene"])


def _planes(v):
    rows = ((0, 0.0, 0.0, 2.0, 0.5), (1, 1.0, 1.0, 0.0, 0.0), (2, 0.0, -3.0, 4.0, 5.0))
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("plane", "a", "b", "c", "d"), r)]) for r in rows])
    return v.select("scene").distinct().select("scene", F.explode(listed).alias("_p")).select("scene", "_p.*")


SUPPORT_SQL = f"""{XYZ_SQL},
planes AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 2.0, 0.5), (1, 1.0, 1.0, 0.0, 0.0), (2, 0.0, -3.0, 4.0, 5.0)) AS t(plane, a, b, c, d)),
d AS (
  SELECT label AS scene, plane, a / sqrt(a * a + b * b + c * c) * x + b / sqrt(a * a + b * b + c * c) * y
    + c / sqrt(a * a + b * b + c * c) * z + d / sqrt(a * a + b * b + c * c) AS dist FROM v, planes),
side AS (SELECT scene, plane, CASE WHEN quantile_cont(dist, 0.5) >= 0 THEN 1.0 ELSE -1.0 END AS side FROM d GROUP BY 1, 2),
e AS (SELECT label AS scene, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS extent FROM v GROUP BY label),
q AS (
  SELECT d.scene, d.plane, side, quantile_cont(dist * side, 0.005) AS lower, quantile_cont(dist * side, 0.05) AS near,
         quantile_cont(dist * side, 0.5) AS middle FROM d JOIN side s ON d.scene = s.scene AND d.plane = s.plane GROUP BY 1, 2, 3),
best AS (
  SELECT q.*, extent FROM q JOIN e ON q.scene = e.scene
  QUALIFY row_number() OVER (PARTITION BY q.scene ORDER BY abs(near) + CASE WHEN middle < extent * 0.03 THEN extent ELSE 0 END, plane) = 1)
"""


@query(
    "scene:i plane:i lower:f6 near:f6 middle:f6 status:s resolved:b",
    f"""WITH {SUPPORT_SQL}
SELECT scene, plane, lower, near, middle, CASE WHEN middle < extent * 0.03 THEN 'support_plane_intersects_object_bulk'
  WHEN lower >= -greatest(extent * 0.004, 1e-6) THEN 'observed_clear' ELSE 'observed_depth_boundary_uncertain' END AS status,
  NOT middle < extent * 0.03 AS resolved FROM best""",
)
def support_relation(spark, folder):
    """Plane that carries each label's points."""
    v = vectors(spark, folder).withColumnRenamed("label", "scene")
    return clouds.support_relation(v, _planes(v), ["scene"])


@query(
    "scene:i translation:f6 safe:b status:s fraction_of_extent:f6",
    f"""WITH {SUPPORT_SQL},
m AS (SELECT scene, extent, greatest(greatest(extent * 0.004, 1e-6) - lower, 0) AS t FROM best)
SELECT scene, t AS translation, t <= extent * 0.1 AS safe, CASE WHEN t > 0 THEN 'support_translated' ELSE 'unmodified_clear' END AS status,
       t / extent AS fraction_of_extent FROM m""",
)
def shift_to_support(spark, folder):
    """Shift that clears the support plane, and whether it is safe."""
    v = vectors(spark, folder).withColumnRenamed("label", "scene")
    return clouds.shift_to_support(v, clouds.support_relation(v, _planes(v), ["scene"]), ["scene"])[1]


def _plane_sql(points: str, planes: int = 2) -> str:
    """All trials of every scene, scored on all points; ``points`` gives (scene, id, x, y, z)."""
    steps = [
        f"pts AS ({points})",
        """spans AS (SELECT scene, count(*) AS total, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS s FROM pts GROUP BY scene HAVING count(*) >= 160)""",
        """left0 AS (SELECT pts.*, total, greatest((s[2] + (s[3] - s[2]) * 0.6) * 0.006, 1e-5) AS tol FROM pts JOIN spans USING (scene))""",
    ]
    for r in range(planes):
        steps += [
            f"""num{r} AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY sha256('{r}:' || id), id) - 1 AS at, count(*) OVER (PARTITION BY scene) AS n FROM left{r})""",
            f"""drawn{r} AS (SELECT scene, t, c, ('0x' || substr(sha256('{r}:' || t || ':' || c), 1, 12))::BIGINT % n AS at FROM (SELECT DISTINCT scene, n FROM num{r} WHERE n >= 100), range(1600) a(t), range(3) b(c))""",
            f"""corner{r} AS (SELECT d.scene, t, max({{'x': x, 'y': y, 'z': z}}) FILTER (c = 0) AS p, max({{'x': x, 'y': y, 'z': z}}) FILTER (c = 1) AS q, max({{'x': x, 'y': y, 'z': z}}) FILTER (c = 2) AS w
              FROM drawn{r} d JOIN num{r} m ON m.scene = d.scene AND m.at = d.at GROUP BY d.scene, t)""",
            f"""cross{r} AS (SELECT scene, t, p, (q.y - p.y) * (w.z - p.z) - (q.z - p.z) * (w.y - p.y) AS i, (q.z - p.z) * (w.x - p.x) - (q.x - p.x) * (w.z - p.z) AS j,
              (q.x - p.x) * (w.y - p.y) - (q.y - p.y) * (w.x - p.x) AS k FROM corner{r})""",
            f"""plane{r} AS (SELECT scene, t, i / s AS a, j / s AS b, k / s AS c, -(i / s * p.x + j / s * p.y + k / s * p.z) AS d FROM (SELECT *, sqrt(i * i + j * j + k * k) AS s FROM cross{r}) WHERE s > 1e-12)""",
            f"""score{r} AS (SELECT p.scene, t, count(*) AS n FROM plane{r} p JOIN left{r} l ON l.scene = p.scene AND abs(a * x + b * y + c * z + d) <= tol GROUP BY p.scene, t)""",
            f"""best{r} AS (SELECT p.*, n, tol FROM (SELECT * FROM score{r} QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n DESC, t) = 1) s JOIN plane{r} p USING (scene, t)
              JOIN (SELECT DISTINCT scene, total, tol FROM left{r}) z USING (scene) WHERE n >= greatest(80, floor(total * 0.07)))""",
            f"""moment{r} AS (SELECT b.scene, any_value(n) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz,
              covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM best{r} b JOIN left{r} l ON l.scene = b.scene AND abs(a * x + b * y + c * z + d) <= l.tol GROUP BY b.scene)""",
            f"""normal{r} AS (SELECT *, CASE WHEN yy * zz - yz * yz >= greatest(xx * zz - xz * xz, xx * yy - xy * xy) THEN [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy]
              WHEN xx * zz - xz * xz >= xx * yy - xy * xy THEN [xz * yz - xy * zz, xx * zz - xz * xz, xy * xz - yz * xx] ELSE [xy * yz - xz * yy, xy * xz - yz * xx, xx * yy - xy * xy] END AS v FROM moment{r})""",
            f"""fit{r} AS (SELECT scene, {r} AS plane, v[1] / s AS a, v[2] / s AS b, v[3] / s AS c, -(v[1] / s * mx + v[2] / s * my + v[3] / s * mz) AS d, n AS inliers
              FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS s FROM normal{r}))""",
            f"""left{r + 1} AS (SELECT l.* FROM left{r} l JOIN best{r} b ON l.scene = b.scene AND abs(a * x + b * y + c * z + d) > l.tol)""",
        ]
    return "WITH " + ",\n".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM fit{r}" for r in range(planes))


PLANE_COLUMNS = "scene:i plane:i a:f6 b:f6 c:f6 d:f6 inliers:i"


@query(PLANE_COLUMNS, _plane_sql(f"WITH {XYZ_SQL} SELECT vec_id // 160 AS scene, vec_id AS id, x, y, z * 0.001 + x * 0.5 AS z FROM v"))
def plane_fit(spark, folder):
    """Dominant planes of scenes of 160 vectors, flattened so that a plane dominates."""
    v = vectors(spark, folder)
    scenes = v.withColumn("scene", F.floor(F.col("vec_id") / 160)).withColumn("z", F.col("z") * 0.001 + F.col("x") * 0.5)
    return clouds.fit_planes(scenes, "scene", "vec_id", planes=2)


@query(
    PLANE_COLUMNS,
    _plane_sql(
        """SELECT l_linenumber % 2 AS scene, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_extendedprice / 1000 AS x, l_quantity AS y,
        CASE WHEN l_linenumber < 6 THEN l_extendedprice / 2000 ELSE l_discount * 400 END AS z FROM lineitem"""
    ),
)
def plane_fit_large(spark, folder):
    """Dominant planes of two scenes that hold half of all lines each."""
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    scenes = load(spark, folder, "lineitem").select(
        (line % 2).alias("scene"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (price / 1000).alias("x"), F.col("l_quantity").alias("y"),
        F.when(line < 6, price / 2000).otherwise(F.col("l_discount") * 400).alias("z"),
    )
    return clouds.fit_planes(scenes, "scene", "id", planes=2)


@query(
    "label:i x_from:f6 x_to:f6 y_from:f6 y_to:f6 z_from:f6 z_to:f6",
    f"""WITH {XYZ_SQL},
q AS (SELECT label, quantile_cont(x, 0.005) AS xl, quantile_cont(x, 0.995) AS xh, quantile_cont(y, 0.005) AS yl, quantile_cont(y, 0.995) AS yh,
             quantile_cont(z, 0.005) AS zl, quantile_cont(z, 0.995) AS zh FROM v GROUP BY label),
r AS (SELECT *, greatest((xh - xl) / 2, (yh - yl) / 2, (zh - zl) / 2) * 1.05 AS r FROM q)
SELECT label, (xl + xh) / 2 - r AS x_from, (xl + xh) / 2 + r AS x_to, (yl + yh) / 2 - r AS y_from, (yl + yh) / 2 + r AS y_to,
       (zl + zh) / 2 - r AS z_from, (zl + zh) / 2 + r AS z_to FROM r""",
)
def robust_ranges(spark, folder):
    """Equal-aspect display ranges per label."""
    return clouds.robust_ranges(vectors(spark, folder), ["label"], ["x", "y", "z"], 0.005, 0.995, 0.05)


@query(
    "scene:i source:i points:i",
    """
SELECT label AS scene, 0 AS source, count(*) AS points FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label
UNION ALL SELECT label, 1, count(*) FROM embeddings WHERE vec_id % 3 = 1 GROUP BY label
UNION ALL SELECT label, 2, count(*) FROM embeddings WHERE vec_id % 3 = 2 GROUP BY label""",
)
def compose_scene(spark, folder):
    """Observed, completed and object layers in one cloud, counted per layer."""
    v = vectors(spark, folder).withColumnRenamed("label", "scene").withColumns({c: F.lit(0) for c in "rgb"})
    cloud = clouds.compose_scene(*[v.filter(F.col("vec_id") % 3 == i) for i in range(3)])
    return clouds.layer_counts(cloud)


@query(
    "scene:s body:i points:i friction_min:f6 friction_max:f6 friction_mean:f6 restitution_mean:f6 x_min:f2 x_max:f2",
    """
SELECT p_brand AS scene, p_size % 2 AS body, count(*) AS points, min(p_size / 50.0) AS friction_min, max(p_size / 50.0) AS friction_max,
       avg(p_size / 50.0) AS friction_mean, avg(p_size / 100.0) AS restitution_mean, min(p_retailprice) AS x_min, max(p_retailprice) AS x_max
FROM part GROUP BY 1, 2""",
)
def scene_stats(spark, folder):
    """Material ranges, bounds and counts per body."""
    size = F.col("p_size").cast("double")
    points = load(spark, folder, "part").select(
        F.col("p_brand").alias("scene"), (F.col("p_size") % 2).alias("body"), (size / 50.0).alias("friction"), (size / 100.0).alias("restitution"),
        F.col("p_retailprice").alias("x"), size.alias("y"), size.alias("z"),
    )
    return clouds.scene_stats(points)


@query(
    "frame:i y:i x:i label:i",
    f"""WITH RECURSIVE {GRID_SQL},
p AS (SELECT DISTINCT frame, y, x, CAST(y AS BIGINT) * 4294967296 + x AS code FROM grid),
reach(frame, code, y, x) AS (
  SELECT frame, code, y, x FROM p
  UNION
  SELECT r.frame, r.code, p.y, p.x FROM reach r JOIN p ON r.frame = p.frame AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1)
SELECT frame, y, x, min(code) AS label FROM reach GROUP BY frame, y, x""",
)
def components(spark, folder):
    """8-connected components of each label's pixel set."""
    return clouds.components(pixel_set(spark, folder), ["frame"], tile=8)


@query(
    "frame:i area:i cx:f6 cy:f6 size:i",
    f"""WITH RECURSIVE {GRID_SQL},
p AS (SELECT DISTINCT frame, y, x, CAST(y AS BIGINT) * 4294967296 + x AS code FROM grid),
reach(frame, code, y, x) AS (
  SELECT frame, code, y, x FROM p
  UNION
  SELECT r.frame, r.code, p.y, p.x FROM reach r JOIN p ON r.frame = p.frame AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
l AS (SELECT frame, y, x, min(code) AS label FROM reach GROUP BY frame, y, x)
SELECT frame, count(*) AS area, avg(x) AS cx, avg(y) AS cy, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS size
FROM l GROUP BY frame, label HAVING count(*) BETWEEN 2 AND 12000""",
)
def component_boxes(spark, folder):
    """Blobs with area, centre and box size."""
    return clouds.component_boxes(clouds.components(pixel_set(spark, folder), ["frame"], tile=8), ["frame"], low=2)


@query(
    "mode:s axis:s metric:f4 steps:i non_finite:i last_step:i",
    """
SELECT event_type AS mode, CAST(user_id % 3 AS VARCHAR) AS axis, sum(value) / greatest(count(*), 1) AS metric, count(*) AS steps,
       0 AS non_finite, max(event_id) AS last_step FROM events GROUP BY 1, 2""",
)
def live_metrics_batch(spark, folder):
    """The streaming metrics roll-up over the event log (the stream itself runs in the tests)."""
    progress = load(spark, folder, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("mode"), (F.col("user_id") % 3).cast("string").alias("axis"), F.col("value").alias("total")
    )
    return live_metrics(progress)
