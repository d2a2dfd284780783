"""Contract audits over documents, packages and caches derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackloom import contracts as C
from trackloom.functions import condition
from trackloom.functions.ordered import index_within
from trackloom.operators import audit, manifests, masks, packages, raster, records, selection, sequence, sweep
from trackloom.plans.sequence_queries import PIXELS_SQL, frame_pixels
from trackloom.plans.spec import drain, query
from trackloom.plans.tables import SWEEP_SQL, TRACK_SQL, load, sweep_rows, track_points
from trackloom.session import shared_folder, spread
from trackloom.streaming import live


def record_lines(spark, folder) -> DataFrame:
    """One sample record per part, in JSON, with a defect in most of them."""
    n = F.col("p_partkey") % 11
    size = F.col("p_size").cast("double")

    def when(i: int, bad: Column, good: Column) -> Column:
        return F.when(n == i, bad).otherwise(good)

    def row(a: float, b: float, c: float) -> Column:
        return F.array(F.lit(a), F.lit(b), F.lit(c))

    inertia = when(7, F.array(row(1, 0.5, 0), row(0.25, 1, 0), row(0, 0, 1)), F.array(row(1, 0.5, 0), row(0.5, 1, 0), row(0, 0, 1)))
    gravity = when(5, F.array(F.lit(0.0), F.lit(-9.8)), row(0, -9.8, 0))
    state = F.struct(row(1, 0, 0).alias("linear_velocity_camera_m_s"), row(0, 0, 1).alias("angular_velocity_camera_rad_s"))
    obj = F.struct(
        F.col("p_brand").alias("object_id"),
        when(0, F.lit(0.0), size).alias("mass_kg"),
        inertia.alias("inertia_tensor_camera_kg_m2"),
        F.lit(0.5).alias("friction"),
        when(4, F.lit(1.5), F.lit(0.5)).alias("restitution"),
        *[F.lit(0.0).alias(k) for k in ("rolling_friction", "spinning_friction", "linear_damping", "angular_damping")],
        state.alias("initial_state"),
    )
    physics = F.struct(
        F.lit("simulation_gt").alias("source"), F.lit(C.CAMERA_FRAME).alias("coordinate_frame"), obj.alias("object"),
        F.struct(gravity.alias("gravity_camera_m_s2")).alias("world"),
    )
    key = F.col("p_partkey").cast("string")
    conditioning = F.struct(
        when(2, F.lit("/abs.png"), F.concat(F.lit("f/"), key)).alias("first_frame"), F.concat(F.lit("s/"), key).alias("scene"),
        F.lit("simulation_gt").alias("scene_source"), when(1, F.lit("  "), F.col("p_name")).alias("text"), physics.alias("physics"),
    )
    indices = F.struct(*[F.lit(2).alias(a) for a in C.SWEEP_AXES])
    sweep_part = F.struct(
        when(6, F.lit("one_factor"), F.lit("base")).alias("mode"), when(6, F.lit("mass_kg"), F.lit(None)).alias("axis"), F.lit("mass_kg").alias("source_axis"),
        F.lit(5).alias("level_count"), F.lit(2).alias("level_index"), F.lit(2).alias("base_level_index"), indices.alias("base_level_indices"),
    )
    record = F.struct(
        F.lit("acme.video_condition_sample.v4").alias("schema"), key.alias("sample_id"), F.col("p_brand").alias("base_scene_id"),
        when(3, F.lit("dev"), F.lit("train")).alias("split"), conditioning.alias("conditioning"),
        F.struct(F.concat(F.lit("v/"), key).alias("video"), F.concat(F.lit("m/"), key).alias("metadata")).alias("target"), sweep_part.alias("sweep"),
    )
    return spread(load(spark, folder, "part"), "p_partkey").select(F.col("p_partkey").alias("ordinal"), F.to_json(record).alias("raw")).withColumn("rec", F.try_parse_json("raw"))


VIOLATION_SQL = """
SELECT p_partkey AS ordinal, CAST(p_partkey AS VARCHAR) AS sample_id,
  ['R18', 'R07', 'R08', 'R04', 'R21', 'R30', 'R42', 'R19'][CAST(p_partkey % 11 AS INTEGER) + 1] AS rule_id
FROM part WHERE p_partkey % 11 < 8"""


@query("ordinal:i sample_id:s rule_id:s", VIOLATION_SQL)
def validate_records(spark, folder):
    """The whole record contract on JSON records with known defects."""
    return records.validate_records(record_lines(spark, folder), "first")


@query(
    "sample_id:s slot:i mass:f6 friction:f6 restitution:f6 ixx:f6 ixy:f6 vx:f6 wz:f6 gy:f6 axis_value:f6 ids_valid:b",
    """
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, 0 AS slot, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END AS mass, 0.5 AS friction,
  CASE WHEN p_partkey % 11 = 4 THEN 1.5 ELSE 0.5 END AS restitution, 1 AS ixx, 0.5 AS ixy, 1 AS vx, 1 AS wz, -9.8 AS gy,
  CASE WHEN p_partkey % 11 = 4 THEN 1.5 ELSE 0.5 END AS axis_value, TRUE AS ids_valid FROM part""",
)
def record_features(spark, folder):
    """Typed objects of JSON records with their controls, dynamics and state."""
    samples = records.typed_samples(record_lines(spark, folder)).withColumn("ids_valid", records.ids_valid())
    o = F.col("object")
    rows = records.object_rows(samples, ["ids_valid"]).select(
        "sample_id", "slot", "ids_valid", condition.controls(o).alias("c"), condition.dynamics(o).alias("d"), condition.initial_state(o, F.col("gravity")).alias("s"),
        condition.control_value(o, F.lit("contact_restitution")).alias("axis_value"),
    )
    picks = {"mass": "c[0]", "friction": "c[1]", "restitution": "c[2]", "ixx": "d[0]", "ixy": "d[3]", "vx": "s[0]", "wz": "s[5]", "gy": "s[7]"}
    return rows.select("sample_id", "slot", "axis_value", "ids_valid", *[F.expr(e).alias(n) for n, e in picks.items()])


@query(
    "low_sample_id:i high_sample_id:i initial_separation:f6 final_separation:f6 mean_separation:f6 max_separation:f6 path_delta:f6 same_frames:b active:b",
    f"""
WITH {SWEEP_SQL},
pairs AS (
  SELECT l.scene, l.axis, max(CASE WHEN level = 0 THEN sample_id END) AS lo, max(CASE WHEN level = 4 THEN sample_id END) AS hi
  FROM levels l JOIN complete c ON l.scene = c.scene AND l.axis = c.axis GROUP BY l.scene, l.axis),
poses AS (
  SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS f,
         l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem),
steps AS (
  SELECT s, count(*) OVER (PARTITION BY s) AS n, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d
  FROM poses WINDOW w AS (PARTITION BY s ORDER BY f)),
info AS (SELECT s, any_value(n) AS n, coalesce(sum(d), 0) AS path FROM steps GROUP BY s),
j AS (
  SELECT p.lo, p.hi, a.f, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM pairs p JOIN poses a ON a.s = p.lo JOIN poses b ON b.s = p.hi AND a.f = b.f)
SELECT j.lo AS low_sample_id, j.hi AS high_sample_id, max(CASE WHEN f = 0 THEN d END) AS initial_separation,
  max(CASE WHEN f = il.n - 1 THEN d END) AS final_separation, avg(d) AS mean_separation, max(d) AS max_separation,
  abs(any_value(il.path) - any_value(ih.path)) AS path_delta, any_value(il.n) = any_value(ih.n) AS same_frames, max(d) / 10.0 >= 1.0 AS active
FROM j JOIN info il ON il.s = j.lo JOIN info ih ON ih.s = j.hi GROUP BY j.lo, j.hi""",
)
def sweep_response(spark, folder):
    """Separation of endpoint trajectories: an order's lines are its frames."""
    levels = sweep.complete_levels(sweep_rows(spark, folder), ["scene", "axis"], "level")
    pairs = sweep.sweep_pairs(levels, ["scene", "axis"], "level", ["sample_id"], True)
    items = load(spark, folder, "lineitem")
    # An order has a handful of lines, so numbering them inside the order is bounded.
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    poses = items.select(
        F.col("l_orderkey").alias("sample_id"), (F.row_number().over(w) - 1).alias("frame"), F.col("l_quantity").alias("px"), F.col("l_discount").alias("py"), F.col("l_tax").alias("pz")
    )
    extents = load(spark, folder, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(10.0).alias("extent"))
    return sweep.sweep_response(pairs, poses, extents)


POSE_SQL = f"""{TRACK_SQL},
poses AS (
  SELECT sample_id, slot, frame, avg(cx) AS px, avg(cy) AS py, avg(cz) AS pz, 1.0 AS qw, avg(cy) AS qx, avg(cx) AS qy, 0.5 AS qz FROM points GROUP BY 1, 2, 3),
q AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM poses),
u AS (SELECT *, qw / n AS w, qx / n AS i, qy / n AS j, qz / n AS k FROM q),
b AS (
  SELECT p.sample_id, p.slot, p.frame, p.point_id, n, cx - px AS dx, cy - py AS dy, cz - pz AS dz, w, i, j, k
  FROM points p JOIN u ON p.sample_id = u.sample_id AND p.slot = u.slot AND p.frame = u.frame),
l AS (
  SELECT sample_id, slot, frame, point_id, n,
    (1 - 2 * (j * j + k * k)) * dx + 2 * (i * j + w * k) * dy + 2 * (i * k - w * j) * dz AS lx,
    2 * (i * j - w * k) * dx + (1 - 2 * (i * i + k * k)) * dy + 2 * (j * k + w * i) * dz AS ly,
    2 * (i * k + w * j) * dx + 2 * (j * k - w * i) * dy + (1 - 2 * (i * i + j * j)) * dz AS lz FROM b)"""


@query(
    "sample_id:s rigid_drift:f6 quaternion_norm_error:f6",
    f"""WITH {POSE_SQL}
SELECT a.sample_id, max(sqrt((a.lx - c.lx) ** 2 + (a.ly - c.ly) ** 2 + (a.lz - c.lz) ** 2)) AS rigid_drift, max(abs(a.n - 1)) AS quaternion_norm_error
FROM l a JOIN l c ON a.sample_id = c.sample_id AND a.slot = c.slot AND a.point_id = c.point_id AND c.frame = 0 GROUP BY a.sample_id""",
)
def rigid_drift(spark, folder):
    """Drift of body-frame coordinates under a pose per object and frame."""
    points = track_points(spark, folder).withColumns({"wx": F.col("cx"), "wy": F.col("cy"), "wz": F.col("cz")})
    poses = points.groupBy("sample_id", "slot", "frame").agg(
        F.avg("cx").alias("px"), F.avg("cy").alias("py"), F.avg("cz").alias("pz"), F.lit(1.0).alias("qw"), F.avg("cy").alias("qx"), F.avg("cx").alias("qy"), F.lit(0.5).alias("qz")
    )
    return audit.rigid_drift(points, poses)


@query(
    "sample_id:s frame:i slot:i u:f4 v:f4 um:f4 vm:f4",
    f"""WITH {TRACK_SQL}
SELECT sample_id, frame, slot, avg(u) AS u, avg(v) AS v, quantile_cont(u, 0.5) FILTER (valid) AS um, quantile_cont(v, 0.5) FILTER (valid) AS vm
FROM points GROUP BY 1, 2, 3""",
)
def track_centroid(spark, folder):
    """Mean and median track position per object and frame."""
    points = track_points(spark, folder)
    keys = ["sample_id", "frame", "slot"]
    middle = raster.track_centroid(points, "median").withColumnsRenamed({"u": "um", "v": "vm"})
    return raster.track_centroid(points).join(middle, keys, "left")


@query(
    "sample_id:s containment_min:f6 cell_precision_min:f6 centroid_error_max_px:f4",
    f"""WITH {TRACK_SQL},
first AS (SELECT * FROM points WHERE slot = 0 AND valid),
mask AS (SELECT DISTINCT sample_id, frame, CAST(floor(u) AS INTEGER) AS x, CAST(floor(v) AS INTEGER) AS y FROM first WHERE point_id % 4 <> 1),
big AS (SELECT DISTINCT sample_id, frame, x + a.d AS x, y + b.d AS y FROM mask, range(-3, 4) AS a(d), range(-3, 4) AS b(d) WHERE x + a.d BETWEEN 0 AND 39 AND y + b.d BETWEEN 0 AND 29),
placed AS (SELECT sample_id, frame, CAST(round_even(u, 0) AS INTEGER) AS x, CAST(round_even(v, 0) AS INTEGER) AS y FROM first),
inside AS (
  SELECT p.sample_id, p.frame, avg(CASE WHEN b.x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c FROM placed p
  LEFT JOIN big b ON p.sample_id = b.sample_id AND p.frame = b.frame AND p.x = b.x AND p.y = b.y WHERE p.x BETWEEN 0 AND 39 AND p.y BETWEEN 0 AND 29 GROUP BY 1, 2),
latent AS (
  SELECT DISTINCT sample_id, frame, CAST(floor(((x + 0.5) * (CAST(43 AS DOUBLE) / 40) - 0.5 - 5 + 0.5) * 8 / 32) AS INTEGER) AS x,
    CAST(floor(((y + 0.5) * (CAST(32 AS DOUBLE) / 30) - 0.5 - 0 + 0.5) * 8 / 32) AS INTEGER) AS y FROM mask),
grown AS (SELECT DISTINCT sample_id, frame, x + a.d AS x, y + b.d AS y FROM latent, range(-1, 2) AS a(d), range(-1, 2) AS b(d)
  WHERE latent.x BETWEEN 0 AND 7 AND latent.y BETWEEN 0 AND 7 AND x + a.d BETWEEN 0 AND 7 AND y + b.d BETWEEN 0 AND 7),
occupied AS (SELECT DISTINCT sample_id, frame, least(greatest(CAST(floor(u / 5) AS INTEGER), 0), 7) AS x, least(greatest(CAST(floor(v / 4) AS INTEGER), 0), 7) AS y FROM first),
prec AS (
  SELECT o.sample_id, o.frame, avg(CASE WHEN g.x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS p FROM occupied o
  LEFT JOIN grown g ON o.sample_id = g.sample_id AND o.frame = g.frame AND o.x = g.x AND o.y = g.y GROUP BY 1, 2),
centre AS (SELECT sample_id, frame, avg(x) AS mx, avg(y) AS my FROM mask GROUP BY 1, 2),
middle AS (SELECT sample_id, frame, quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM first GROUP BY 1, 2),
offs AS (SELECT c.sample_id, c.frame, sqrt((mx - mu) ** 2 + (my - mv) ** 2) AS o FROM centre c JOIN middle m ON c.sample_id = m.sample_id AND c.frame = m.frame)
SELECT i.sample_id, min(c) AS containment_min, min(p) AS cell_precision_min, max(o) AS centroid_error_max_px
FROM inside i JOIN prec USING (sample_id, frame) JOIN offs USING (sample_id, frame) GROUP BY i.sample_id""",
)
def mask_consistency(spark, folder):
    """Track points against a pixel mask: containment, cell precision, centroid distance."""
    points = track_points(spark, folder).filter("slot = 0 and valid")
    mask = points.filter("point_id % 4 <> 1").select(
        "sample_id", "frame", F.floor("u").cast("int").alias("x"), F.floor("v").cast("int").alias("y")
    ).distinct()

    def cell(c: str, width: int) -> Column:
        return F.least(F.greatest(F.floor(F.col(c) / width).cast("int"), F.lit(0)), F.lit(7))

    cells = points.select("sample_id", "frame", cell("u", 5).alias("cx"), cell("v", 4).alias("cy"), F.lit(1.0).alias("visible")).distinct()
    return masks.mask_consistency(points, cells, mask, (40, 30), (32, 32), (8, 8))


@query(
    "video:i frame:i y:i x:i",
    f"""WITH {PIXELS_SQL},
back AS (
  SELECT video, y, x, round_even(0.299 * floor(quantile_cont(r, 0.5)) + 0.587 * floor(quantile_cont(g, 0.5)) + 0.114 * floor(quantile_cont(b, 0.5)), 0) AS bg
  FROM pixels GROUP BY video, y, x),
diff AS (
  SELECT p.video, frame, p.y, p.x, abs(round_even(0.299 * r + 0.587 * g + 0.114 * b, 0) - bg) AS v FROM pixels p JOIN back USING (video, y, x)),
taps AS (SELECT * FROM (VALUES (-2, 1.0 / 16), (-1, 4.0 / 16), (0, 6.0 / 16), (1, 4.0 / 16), (2, 1.0 / 16)) AS t(o, w)),
across AS (
  SELECT a.video, a.frame, a.y, a.x, sum(d.v * w) AS v FROM diff a, taps JOIN diff d
  ON d.video = a.video AND d.frame = a.frame AND d.y = a.y AND d.x = CASE WHEN a.x + o < 0 THEN -(a.x + o) WHEN a.x + o > 7 THEN 14 - (a.x + o) ELSE a.x + o END GROUP BY 1, 2, 3, 4),
down AS (
  SELECT a.video, a.frame, a.y, a.x, sum(d.v * w) AS v FROM across a, taps JOIN across d
  ON d.video = a.video AND d.frame = a.frame AND d.x = a.x AND d.y = CASE WHEN a.y + o < 0 THEN -(a.y + o) WHEN a.y + o > 7 THEN 14 - (a.y + o) ELSE a.y + o END GROUP BY 1, 2, 3, 4)
SELECT video, frame, y, x FROM down WHERE round_even(v, 0) > 8""",
)
def foreground_mask(spark, folder):
    """Smoothed difference to the per-pixel background above a threshold."""
    pixels = frame_pixels(spark, folder)
    return masks.foreground_mask(pixels, sequence.frame_median(pixels), 8.0)


@query("doc_id:i ordinal:i", "SELECT doc_id, doc_id AS ordinal FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY ordinal LIMIT 1")
def allowed_sample(spark, folder):
    """First document that is in the snapshot of good labels."""
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("ordinal"))
    snapshot = load(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("sample_id"))
    return selection.allowed_sample(docs, snapshot).withColumnRenamed("sample_id", "doc_id")


@query("doc_id:i quality:i known:b", "SELECT l.doc_id, quality, d.doc_id IS NOT NULL AS known FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def attach_strict(spark, folder):
    """Labels joined to English documents, and the labels those do not know."""
    labels = load(spark, folder, "labels").select("doc_id", "quality")
    docs = load(spark, folder, "documents").filter("lang = 'en'").select("doc_id")
    joined, unknown = manifests.attach_strict(labels, docs, "doc_id")
    return joined.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query("o_orderkey:i ordinal:i", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders WHERE o_orderpriority LIKE '1%' QUALIFY ordinal < 50")
def restore_order(spark, folder):
    """First fifty urgent orders in source order."""
    urgent = load(spark, folder, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey")
    source = index_within(urgent, [], ["o_orderkey"], F.floor(F.col("o_orderkey") / selection.ORDINAL_SEGMENT), "ordinal")
    return selection.limit_ordered(manifests.restore_order(urgent, source, "o_orderkey"), "ordinal", 50)


@query("o_orderkey:i ordinal:i", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def restore_order_all(spark, folder):
    """All orders in source order."""
    orders = load(spark, folder, "orders").select("o_orderkey")
    source = index_within(orders, [], ["o_orderkey"], F.floor(F.col("o_orderkey") / selection.ORDINAL_SEGMENT), "ordinal")
    return manifests.restore_order(orders, source, "o_orderkey")


@query("sample_id:i trajectory_id:i", """
WITH b AS (SELECT o_custkey, min(o_orderkey) AS t FROM orders WHERE o_orderpriority LIKE '3%' GROUP BY o_custkey)
SELECT o_orderkey AS sample_id, t AS trajectory_id FROM orders LEFT JOIN b ON orders.o_custkey = b.o_custkey""")
def trajectory_inputs(spark, folder):
    """Each order with the trajectory of its scene's base record."""
    rows = sweep_rows(spark, folder).select(
        "sample_id", F.col("scene").alias("base_scene_id"), F.when(F.col("level") == 2, F.lit("base")).otherwise(F.lit("one_factor")).alias("mode")
    )
    return manifests.trajectory_inputs(rows, rows, "nominal_base", several="least")


@query("sample_id:i ordinal:i", """
WITH c AS (
  SELECT DISTINCT l_orderkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45)
SELECT o_orderkey AS sample_id, o_orderkey AS ordinal FROM orders WHERE o_orderkey IN (SELECT s FROM c) ORDER BY ordinal LIMIT 50""")
def affected_examples(spark, folder):
    """First fifty orders with a part that is not represented."""
    coverage = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("sample_id"), F.when(F.col("p_size") > 45, F.lit("not_represented_at_t0")).otherwise(F.lit("direct")).alias("status")
    )
    samples = load(spark, folder, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("ordinal"))
    return manifests.affected_examples(coverage, samples, 50)


@query("p_partkey:i alias:s reason:s", """
SELECT p_partkey, p_type AS alias, 'direct_collider_id' AS reason FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey, 'environment_mesh_' || p_type, 'direct_collider_id' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'scene_mesh_' || p_type, 'reviewed_environment_mesh_replacement' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'solid_ramp_wedge', 'solid_wedge_visual_replacement' FROM part WHERE p_size > 25""")
def collider_aliases(spark, folder):
    """Aliases of a collider id with their reasons."""
    collider = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("environment_mesh_"), "p_type")).otherwise(F.col("p_type"))
    aliases = condition.collider_aliases(collider, F.col("p_size") > 25)
    return load(spark, folder, "part").select("p_partkey", F.explode(aliases).alias("_a")).select("p_partkey", "_a.alias", "_a.reason")


@query("scene:i part_id:s", "SELECT event_id AS scene, 'k' AS part_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 0")
def represented_parts(spark, folder):
    """Part ids with a positive count in a JSON map."""
    scenes = load(spark, folder, "events").select(F.col("event_id").alias("scene"), F.col("props").alias("counts_json"))
    return manifests.represented_parts(scenes)


PACKAGE_SQL = """
s AS (SELECT s_suppkey AS n, s_nationkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS scene FROM supplier),
e AS (
  SELECT scene, 'manifest.absent' AS error FROM s WHERE n % 13 = 1
  UNION ALL SELECT scene, 'manifest.schema' FROM s WHERE n % 13 = 2
  UNION ALL SELECT scene, 'artifact.absent: scene.npz' FROM s WHERE n % 13 = 3
  UNION ALL SELECT scene, 'archive.absent' FROM s WHERE n % 13 = 3
  UNION ALL SELECT scene, 'artifact.bytes: scene.npz' FROM s WHERE n % 13 = 4
  UNION ALL SELECT scene, 'artifact.sha256: scene.npz' FROM s WHERE n % 13 = 5
  UNION ALL SELECT scene, 'artifact.outside: ../x' FROM s WHERE n % 13 = 6
  UNION ALL SELECT scene, 'physics.proxy' FROM s WHERE n % 13 = 7
  UNION ALL SELECT scene, 'report.absent' FROM s WHERE n % 13 = 8
  UNION ALL SELECT scene, 'archive.fields: depth' FROM s WHERE n % 13 = 9
  UNION ALL SELECT DISTINCT s.scene, 'cloud.source' FROM s JOIN lineitem ON l_suppkey = n WHERE n % 13 = 10
  UNION ALL SELECT DISTINCT s.scene, 'mask.dense_outside_content' FROM s JOIN lineitem ON l_suppkey = n WHERE n % 13 = 11 AND l_quantity > 25)
"""


def _packages(spark, folder):
    scene = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    n = F.col("s_suppkey") % 13
    s = load(spark, folder, "supplier").select(scene.alias("scene"), "s_suppkey", "s_nationkey", n.alias("n"))
    digest = F.sha2("scene", 256)
    want = F.struct(F.when(F.col("n") == 4, 1).otherwise(6).cast("long").alias("bytes"), F.when(F.col("n") == 5, F.lit("0")).otherwise(digest).alias("sha256"))
    artifacts = F.when(F.col("n") == 6, F.create_map(F.lit("scene.npz"), want, F.lit("../x"), want)).otherwise(F.create_map(F.lit("scene.npz"), want))
    schema = F.when(F.col("n") == 2, F.lit("acme.structured_scene_package.v0")).otherwise(F.lit("acme.structured_scene_package.v1"))
    manifest = F.to_json(F.struct(schema.alias("schema"), artifacts.alias("artifacts")))
    bundles = s.filter("n <> 1").select("scene", F.parse_json(manifest).alias("manifest"))

    def file(name: str, present: Column) -> Column:
        return F.when(
            present, F.struct(F.concat_ws("/", "scene", F.lit(name)).alias("path"), F.lit(6).cast("long").alias("bytes"), digest.alias("sha256"))
        )

    always = F.lit(True)
    listed = F.array_compact(
        F.array(file("scene.npz", F.col("n") != 3), file("report.json", F.col("n") != 8), file("physics.json", always), file(C.COLLISION_PROXY, F.col("n") != 7))
    )
    files = s.select(F.explode(listed).alias("_f")).select("_f.*")
    gate = F.when(F.col("s_nationkey") < 12, F.lit('{"quality_gate": {"passed": true}}')).otherwise(F.lit('{"quality_gate": {"passed": false}}'))
    documents = s.select(
        F.explode(
            F.array(
                F.struct(F.concat_ws("/", "scene", F.lit("report.json")).alias("path"), gate.alias("j")),
                F.struct(F.concat_ws("/", "scene", F.lit("physics.json")).alias("path"), F.lit(f'{{"collision_proxy": "{C.COLLISION_PROXY}"}}').alias("j")),
            )
        ).alias("_d")
    ).select("_d.path", F.parse_json("_d.j").alias("doc"))
    fields = F.array(*[F.lit(x) for x in C.SCENE_ARRAYS])
    headers = s.filter("n not in (1, 3)").select(
        "scene", F.when(F.col("n") == 9, F.array_remove(fields, "depth")).otherwise(fields).alias("fields"), F.array().cast("array<string>").alias("problems")
    )
    items = load(spark, folder, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    cloud = items.select("scene", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"), F.when(F.col("n") == 10, 3).otherwise(1).alias("source"))
    bad = (F.col("n") == 11) & (F.col("l_quantity") > 25)
    pixels = items.select(
        "scene", always.alias("observed"), F.lit(False).alias("completed"), always.alias("dense"), F.lit(False).alias("hole"), (~bad).alias("content"), F.lit(False).alias("reliable"),
        F.lit(0.0).alias("depth"), F.lit(0.0).alias("raw_depth"),
    )
    return packages.audit_packages(s.select("scene"), bundles, files, documents, headers, cloud, pixels)


@query("scene:s error:s", f"WITH {PACKAGE_SQL} SELECT scene, error FROM e")
def package_errors(spark, folder):
    """Every integrity error of the scene packages."""
    return _packages(spark, folder)[0]


@query(
    "scene:s errors:i integrity_passed:b quality_gate_passed:b passed:b",
    f"""WITH {PACKAGE_SQL}, c AS (SELECT scene, count(*) AS n FROM e GROUP BY scene)
SELECT s.scene, coalesce(c.n, 0) AS errors, c.n IS NULL AS integrity_passed, k < 12 AND s.n % 13 <> 1 AS quality_gate_passed,
       c.n IS NULL AND k < 12 AS passed FROM s LEFT JOIN c ON s.scene = c.scene""",
)
def package_verdicts(spark, folder):
    """Integrity and quality verdict per scene package."""
    return _packages(spark, folder)[1]


CACHE_SQL = """
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, doc_id % 9 AS n FROM documents),
e AS (
  SELECT s, 'record.changed' AS message FROM d WHERE n = 1
  UNION ALL SELECT s, 'latent.shared: l/shared' FROM d WHERE n = 2
  UNION ALL SELECT s, 'artifact: latent' FROM d WHERE n = 3
  UNION ALL SELECT s, 'artifact: text' FROM d WHERE n = 4
  UNION ALL SELECT s, 'track.absent' FROM d WHERE n = 5
  UNION ALL SELECT s, 'track.objects' FROM d WHERE n = 6
  UNION ALL SELECT s, 'track.count' FROM d WHERE n = 7
  UNION ALL SELECT s, 'trajectory.sha256' FROM d WHERE n = 8)
"""


@query("sample_id:s message:s", f"WITH {CACHE_SQL} SELECT s AS sample_id, message FROM e")
def audit_cache(spark, folder):
    """All error conditions of a cache in one listing."""
    key = F.col("doc_id").cast("string")
    d = load(spark, folder, "documents").select("doc_id", key.alias("sample_id"), F.col("source").alias("base_scene_id"), (F.col("doc_id") % 9).alias("n"), F.sha2("text", 256).alias("h"))
    n, sid = F.col("n"), F.col("sample_id")

    def path(prefix: str) -> Column:
        return F.concat(F.lit(f"{prefix}/"), sid)

    latent = F.when(n == 2, F.lit("l/shared")).otherwise(path("l"))
    stale = F.lit("0")
    cache = d.select(
        "sample_id", "base_scene_id", F.when(n == 1, F.lit("{1}")).otherwise(F.lit("{}")).alias("record_json"), F.array(F.lit("o")).alias("object_ids"),
        latent.alias("latent_path"), F.when(n == 2, F.lit("shared")).when(n == 3, stale).otherwise(F.col("h")).alias("latent_sha256"),
        path("t").alias("text_path"), F.when(n == 4, stale).otherwise(F.col("h")).alias("text_sha256"), path("k").alias("track_path"), F.col("h").alias("track_sha256"),
        F.array(F.when(n == 6, F.lit("p")).otherwise(F.lit("o"))).alias("track_object_ids"), F.when(n == 7, 2).otherwise(1).alias("track_object_count"),
        path("p").alias("source_point_trajectory"), F.col("h").alias("source_point_trajectory_sha256"),
        *[x for name in ("first_frame", "scene", "video") for x in (path(name).alias(name), F.col("h").alias(f"{name}_sha256"))],
    )
    listed = F.array(
        F.struct(latent.alias("path"), F.when(n == 2, F.lit("shared")).otherwise(F.col("h")).alias("sha256")),
        *[F.struct(path(p).alias("path"), F.col("h").alias("sha256")) for p in ("t", "k", "p", "first_frame", "scene", "video")],
    )
    files = d.select(F.explode(listed).alias("_f")).select("_f.path", F.lit(1).cast("long").alias("bytes"), "_f.sha256").distinct()
    tracks = d.filter("n <> 5").select(
        "sample_id", path("p").alias("path"), F.when(n == 8, stale).otherwise(F.col("h")).alias("sha256"), F.array(F.lit("o")).alias("object_ids"), F.lit(1).alias("object_count")
    )
    source = d.select("sample_id", F.lit("{}").alias("record_json"))
    return manifests.audit_cache(cache, source, tracks, files)


@query(
    "mode:s axis:s metric:f4 steps:i non_finite:i last_step:i",
    """
SELECT event_type AS mode, CAST(user_id % 3 AS VARCHAR) AS axis, sum(value) / greatest(count(*), 1) AS metric, count(*) AS steps,
       0 AS non_finite, max(event_id) AS last_step FROM events GROUP BY 1, 2""",
)
def live_metrics(spark, folder):
    """The metrics roll-up as a stream over the event table, drained to a result table."""
    schema = load(spark, folder, "events").schema
    # A glob lets the stream read the table whether it is one file or a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    progress = events.select(
        F.col("event_id").alias("step"), F.col("event_type").alias("mode"), (F.col("user_id") % 3).cast("string").alias("axis"), F.col("value").alias("total")
    )
    out = shared_folder(spark, "live-metrics")
    drain(live.live_metrics(progress), out, "complete")
    return spark.read.parquet(out)


@query("sample_id:s rule_id:s", f"SELECT sample_id, rule_id FROM ({VIOLATION_SQL}) AS v")
def live_validation(spark, folder):
    """The record contract on a stream of manifest lines."""
    lines = shared_folder(spark, "manifest-lines")
    record_lines(spark, folder).select(F.col("raw").alias("value")).write.text(lines)
    out = shared_folder(spark, "live-violations")
    drain(live.live_validation(spark.readStream.text(lines)), out, "append")
    return spark.read.parquet(out)
