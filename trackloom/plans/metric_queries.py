"""Evaluation metrics over line items, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import metrics
from trackloom.plans.spec import query
from trackloom.plans.tables import load


@query(
    "l_returnflag:s metric:f6 weight:f2",
    "SELECT l_returnflag, sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1) AS metric, sum(l_quantity) AS weight FROM lineitem GROUP BY l_returnflag",
)
def weighted_metrics(spark, folder):
    """Quantity-weighted mean discount."""
    items = load(spark, folder, "lineitem").withColumn("_num", F.col("l_discount") * F.col("l_quantity"))
    return metrics.weighted_metrics(items, ["l_returnflag"], "_num", "l_quantity")


@query(
    "l_returnflag:s masked_mse:f6",
    """
SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN (l_discount - l_tax) ** 2 ELSE 0 END)
       / greatest(count(*) FILTER (l_linestatus = 'O'), 1) AS masked_mse FROM lineitem GROUP BY l_returnflag""",
)
def masked_mse(spark, folder):
    """Masked squared error between discount and tax."""
    items = load(spark, folder, "lineitem").withColumn("mask", (F.col("l_linestatus") == "O").cast("double"))
    return metrics.masked_mse(items, ["l_returnflag"], "l_discount", "l_tax", "mask")


@query(
    "l_orderkey:i total_weight:f6 front_weight:f6",
    """
WITH t AS (
  SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_quantity > 25) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, t AS total_weight, CASE WHEN f = 0 OR f = t THEN f ELSE 0.7 * t END AS front_weight FROM t""",
)
def balanced_weights(spark, folder):
    """Seventy percent of each order's weight on its large lines."""
    items = load(spark, folder, "lineitem").select("l_orderkey", F.lit(1.0).alias("base"), (F.col("l_quantity") > 25).cast("int").alias("motion"))
    weighted = metrics.balanced_weights(items, ["l_orderkey"], "base", "motion", 0.7)
    return weighted.groupBy("l_orderkey").agg(
        F.sum("weight").alias("total_weight"), F.coalesce(F.sum(F.when(F.col("motion") > 0, F.col("weight"))), F.lit(0.0)).alias("front_weight")
    )


@query(
    "l_returnflag:s response_error:f6",
    """
WITH s AS (
  SELECT l_returnflag, greatest(count(*) FILTER (l_linestatus = 'O'), 1) AS n,
    sum(CASE WHEN l_linestatus = 'O' THEN ((l_discount - l_tax) - (l_discount * 1.1 - l_tax)) ** 2 ELSE 0 END) AS e,
    sum(CASE WHEN l_linestatus = 'O' THEN (l_discount * 1.1 - l_tax) ** 2 ELSE 0 END) AS t FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, (e / n) / greatest(t / n, 1e-3) AS response_error FROM s""",
)
def response_error(spark, folder):
    """Error of a predicted change over the energy of the true change."""
    items = load(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_tax").alias("low_p"), F.col("l_tax").alias("low_t"), F.lit(1.0).alias("low_m"),
        F.col("l_discount").alias("high_p"), (F.col("l_discount") * 1.1).alias("high_t"), (F.col("l_linestatus") == "O").cast("double").alias("high_m"),
    )
    return metrics.response_error(items, ["l_returnflag"], ("low_p", "low_t", "low_m"), ("high_p", "high_t", "high_m"))


@query(
    "o_orderstatus:s js:f8",
    """
WITH base AS (
  SELECT o_orderstatus, o_orderpriority, l_linenumber, sum(l_quantity) AS a, sum(l_discount) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
n AS (
  SELECT *, a / sum(a) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS p, b / sum(b) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS q FROM base),
t AS (
  SELECT o_orderstatus, o_orderpriority, 0.5 * (p * (ln(greatest(p, 1.1920928955078125e-07)) - ln(greatest((p + q) / 2, 1.1920928955078125e-07)))
    + CASE WHEN q > 0 THEN q * (ln(greatest(q, 1.1920928955078125e-07)) - ln(greatest((p + q) / 2, 1.1920928955078125e-07))) ELSE 0 END) AS js FROM n),
f AS (SELECT o_orderstatus, o_orderpriority, sum(js) AS js FROM t GROUP BY 1, 2)
SELECT o_orderstatus, avg(js) AS js FROM f GROUP BY o_orderstatus""",
)
def js_divergence(spark, folder):
    """Divergence of quantity and discount mass over line numbers."""
    orders, items = load(spark, folder, "orders"), load(spark, folder, "lineitem")
    keys = ["o_orderstatus", "o_orderpriority"]
    base = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*keys, "l_linenumber").agg(
        F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b")
    )
    totals = base.groupBy(*keys).agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    mass = base.join(totals, keys).select(*keys, (F.col("a") / F.col("_ta")).alias("p"), (F.col("b") / F.col("_tb")).alias("q"))
    return metrics.js_divergence(mass, ["o_orderstatus"], "o_orderpriority", "p", "q")


@query(
    "l_suppkey:i comparable:b mean_abs_difference:f6 p95_abs_difference:f6 max_abs_difference:f6",
    """
WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'N' OR l_suppkey % 10 <> 3 GROUP BY 1, 2),
b AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity * (1 + l_tax)) AS v FROM lineitem GROUP BY 1, 2),
j AS (SELECT coalesce(a.s, b.s) AS s, abs(a.v - b.v) AS d, a.v IS NOT NULL AND b.v IS NOT NULL AS ok FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p)
SELECT s AS l_suppkey, bool_and(ok) AS comparable, CASE WHEN bool_and(ok) THEN avg(d) END AS mean_abs_difference,
       CASE WHEN bool_and(ok) THEN quantile_cont(d, 0.95) END AS p95_abs_difference, CASE WHEN bool_and(ok) THEN max(d) END AS max_abs_difference
FROM j GROUP BY s""",
)
def abs_diff_stats(spark, folder):
    """Absolute differences of two aligned tables; no figures where sizes differ."""
    items = load(spark, folder, "lineitem")
    keys = [F.col("l_suppkey"), F.col("l_partkey")]
    a = items.filter((F.col("l_returnflag") != "N") | (F.col("l_suppkey") % 10 != 3)).groupBy(*keys).agg(F.sum("l_quantity").alias("v"))
    b = items.groupBy(*keys).agg(F.sum(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("v"))
    return metrics.abs_diff_stats(a, b, ["l_suppkey"], ["l_partkey"], "v")


@query(
    "vec_id:i component:s length_ok:b final_value:f6 max_value:f6",
    """
SELECT vec_id, c AS component, vec_id % 7 <> 0 AS length_ok,
       CASE WHEN c = 'total' THEN embedding[64] ELSE embedding[32] END AS final_value,
       CASE WHEN c = 'total' THEN list_max(embedding) ELSE list_max(embedding[1:32]) END AS max_value
FROM embeddings, (VALUES ('total'), ('half')) AS t(c)""",
)
def loss_history(spark, folder):
    """Final and largest value of each history, and whether its length is the step count."""
    parts = F.array(
        F.struct(F.lit("total").alias("component"), F.lit(64).alias("n"), F.col("embedding").alias("values")),
        F.struct(F.lit("half").alias("component"), F.lit(32).alias("n"), F.slice("embedding", 1, 32).alias("values")),
    )
    history = load(spark, folder, "embeddings").select("vec_id", F.explode(parts).alias("_h")).select(
        "vec_id", "_h.component", (F.col("_h.n") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)).alias("steps"), "_h.values"
    )
    return metrics.loss_history(history, ["vec_id"])


def _scores(spark, folder):
    """Best cosine of every cell of a 64-cell frame against the frame's masked cells.

    The target is the prediction with its second half negated, so a cell does not
    simply match itself.
    """
    base = load(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("frame"), (F.col("vec_id") % 64).alias("cell"), (F.col("label") < 5).alias("mask"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    unit = metrics.centred_unit(base, ["frame"], "vector", 64)
    tokens = unit.withColumn("vector", F.transform("vector", lambda x, i: F.when(i < 32, x).otherwise(-x)))
    matched = metrics.best_match(unit, tokens, ["frame"], "cell", "vector", "mask")
    return matched.join(base.select("frame", "cell", "mask"), ["frame", "cell"])


SCORE_SQL = """
v AS (SELECT vec_id // 64 AS frame, vec_id % 64 AS cell, label < 5 AS mask, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
long AS (SELECT frame, cell, mask, i, e[i] AS x FROM v, range(1, 65) AS t(i)),
m AS (SELECT frame, i, avg(x) AS mean FROM long GROUP BY 1, 2),
c AS (SELECT l.frame, cell, mask, l.i, x - mean AS x FROM long l JOIN m ON l.frame = m.frame AND l.i = m.i),
n AS (SELECT frame, cell, any_value(mask) AS mask, list(x ORDER BY i) AS u, list(CASE WHEN i <= 32 THEN x ELSE -x END ORDER BY i) AS w,
             greatest(sqrt(sum(x * x)), 1e-6) AS len FROM c GROUP BY 1, 2),
scores AS (
  SELECT a.frame, a.cell, a.mask, max(list_dot_product(a.u, b.w) / (a.len * b.len)) AS score
  FROM n a JOIN n b ON a.frame = b.frame AND b.mask GROUP BY 1, 2, 3)
"""


@query("frame:i cell:i score:f6", f"WITH {SCORE_SQL} SELECT frame, cell, score FROM scores")
def best_cosine(spark, folder):
    """Highest cosine of every cell against the frame's masked target tokens."""
    return _scores(spark, folder)


def _centres(spark, folder):
    """Soft centres on the 8 x 8 grid scaled to [-1, 1]."""
    placed = _scores(spark, folder).withColumns(
        {"x": (F.col("cell") % 8) * (2.0 / 7.0) - 1.0, "y": F.floor(F.col("cell") / 8) * (2.0 / 7.0) - 1.0}
    )
    return placed, metrics.soft_centre(placed, ["frame"], "score", "x", "y", "mask")


CENTRE_SQL = f"""{SCORE_SQL},
placed AS (SELECT *, (cell % 8) * (2.0 / 7.0) - 1.0 AS x, (cell // 8) * (2.0 / 7.0) - 1.0 AS y,
                  exp((score - max(score) OVER (PARTITION BY frame)) / 0.07) AS w FROM scores),
centres AS (
  SELECT frame, sum(w * x) / sum(w) AS pred_x, sum(w * y) / sum(w) AS pred_y, avg(x) FILTER (mask) AS target_x, avg(y) FILTER (mask) AS target_y
  FROM placed GROUP BY frame)"""


@query(
    "frame:i pred_x:f6 pred_y:f6 target_x:f6 target_y:f6",
    f"WITH {CENTRE_SQL} SELECT * FROM centres",
)
def soft_centre(spark, folder):
    """Expected grid position under a softmax of the scores, next to the mask's centre."""
    return _centres(spark, folder)[1]


@query(
    "sample_id:i center:f6 velocity:f6 distribution:f6",
    f"""WITH {CENTRE_SQL},
mass AS (
  SELECT frame, w / sum(w) OVER (PARTITION BY frame) AS p, CAST(mask AS INTEGER) / sum(CAST(mask AS INTEGER)) OVER (PARTITION BY frame) AS q FROM placed),
js AS (
  SELECT frame, sum(0.5 * (p * (ln(greatest(p, 1.1920928955078125e-07)) - ln(greatest((p + q) / 2, 1.1920928955078125e-07)))
    + CASE WHEN q > 0 THEN q * (ln(greatest(q, 1.1920928955078125e-07)) - ln(greatest((p + q) / 2, 1.1920928955078125e-07))) ELSE 0 END)) AS js
  FROM mass GROUP BY frame),
k AS (SELECT frame // 4 AS sample_id, frame % 4 AS f, c.*, js FROM centres c JOIN js USING (frame)),
g AS (SELECT *, pred_x - target_x AS ex, pred_y - target_y AS ey,
        (pred_x - target_x) - lag(pred_x - target_x) OVER z AS vx, (pred_y - target_y) - lag(pred_y - target_y) OVER z AS vy
      FROM k WINDOW z AS (PARTITION BY sample_id ORDER BY f)),
l AS (
  SELECT sample_id, f, js,
    ((CASE WHEN abs(ex) < 0.05 THEN 10 * ex * ex ELSE abs(ex) - 0.025 END) + (CASE WHEN abs(ey) < 0.05 THEN 10 * ey * ey ELSE abs(ey) - 0.025 END)) / 2 AS c,
    ((CASE WHEN abs(vx) < 0.05 THEN 10 * vx * vx ELSE abs(vx) - 0.025 END) + (CASE WHEN abs(vy) < 0.05 THEN 10 * vy * vy ELSE abs(vy) - 0.025 END)) / 2 AS s FROM g)
SELECT sample_id, avg(c) FILTER (f > 0) AS center, avg(s) FILTER (f > 1) AS velocity, avg(js) FILTER (f > 0) AS distribution FROM l GROUP BY sample_id""",
)
def motion_errors(spark, folder):
    """Centre, occupancy and velocity errors per sample of four frames."""
    placed, centres = _centres(spark, folder)
    sample = F.floor(F.col("frame") / 4).alias("sample_id")
    inner = (F.col("frame") % 4).alias("frame")
    tops = placed.groupBy("frame").agg(F.max("score").alias("_top"), F.sum(F.col("mask").cast("int")).alias("_n"))
    weight = F.exp((F.col("score") - F.col("_top")) / 0.07)
    weighted = placed.join(tops, "frame").withColumn("_w", weight)
    sums = weighted.groupBy("frame").agg(F.sum("_w").alias("_s"))
    mass = weighted.join(sums, "frame").select(sample, inner, (F.col("_w") / F.col("_s")).alias("p"), (F.col("mask").cast("int") / F.col("_n")).alias("q"))
    moved = centres.select(sample, inner, "pred_x", "pred_y", "target_x", "target_y", "valid")
    return metrics.motion_errors(moved, mass)
