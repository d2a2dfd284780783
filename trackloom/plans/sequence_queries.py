"""Frame-ordered operators over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.geometry import latent_frame
from trackloom.functions.ordered import index_within, micros
from trackloom.operators import metrics, sequence, sweep
from trackloom.plans.spec import drain, query
from trackloom.plans.tables import FRAMES_SQL, load, user_frames
from trackloom.session import shared_folder
from trackloom.streaming import live

VIDEO_FRAMES = 16


def frame_pixels(spark, folder):
    """Embeddings as 8 x 8 frames; sixteen consecutive vectors make a video. What a vector lacks is NULL."""
    cells = load(spark, folder, "embeddings").select(
        F.expr(f"vec_id div {VIDEO_FRAMES}").alias("video"),
        (F.col("vec_id") % VIDEO_FRAMES).alias("frame"),
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"),
    )
    e = F.get("embedding", F.col("i")).cast("double")
    other = F.get("embedding", F.lit(63) - F.col("i")).cast("double")
    return cells.select(
        "video",
        "frame",
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).alias("x"),
        F.floor((e + 1.0) * 127.0).cast("int").alias("r"),
        F.floor((other + 1.0) * 127.0).cast("int").alias("g"),
        F.floor(F.abs(e) * 16.0).cast("int").alias("b"),
    )


PIXELS_SQL = """
cells AS (
  SELECT vec_id // 16 AS video, vec_id % 16 AS frame, i // 8 AS y, i % 8 AS x,
         CAST(embedding[i + 1] AS DOUBLE) AS e, CAST(embedding[64 - i] AS DOUBLE) AS o
  FROM embeddings, range(64) AS t(i)),
pixels AS (
  SELECT video, frame, y, x, CAST(floor((e + 1.0) * 127.0) AS INTEGER) AS r,
         CAST(floor((o + 1.0) * 127.0) AS INTEGER) AS g, CAST(floor(abs(e) * 16.0) AS INTEGER) AS b FROM cells)
"""


@query(
    "video:i path_length:f4",
    f"""
WITH {FRAMES_SQL},
steps AS (SELECT video, abs(value - lag(value) OVER (PARTITION BY video ORDER BY frame)) AS s FROM frames)
SELECT video, coalesce(sum(s), 0) AS path_length FROM steps GROUP BY video""",
)
def path_length(spark, folder):
    """Total variation of each user's values in time order."""
    return sweep.path_length(user_frames(spark, folder), ["video"], "frame", ["value"])


@query(
    "video:i increasing:b",
    f"""
WITH {FRAMES_SQL},
steps AS (SELECT video, t, lag(t) OVER (PARTITION BY video ORDER BY frame) AS p FROM frames)
SELECT video, bool_and(p IS NULL OR t > p) AS increasing FROM steps GROUP BY video""",
)
def strictly_increasing(spark, folder):
    """Whether every user's event times grow strictly."""
    return sequence.strictly_increasing(user_frames(spark, folder), ["video"], "frame", "t")


@query(
    "video:i object_mean:f4 background_mean:f4 global_mean:f4 global_p95:f4",
    f"""
WITH {FRAMES_SQL},
near AS (
  SELECT video, event_type = 'error' AS mask,
         abs(lead(value) OVER w - 2.0 * value + lag(value) OVER w) AS d
  FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame))
SELECT video, avg(d) FILTER (mask) AS object_mean, avg(d) FILTER (NOT mask) AS background_mean,
       avg(d) AS global_mean, quantile_cont(d, 0.95) AS global_p95
FROM near WHERE d IS NOT NULL GROUP BY video""",
)
def second_difference(spark, folder):
    """Second differences of values on error events and elsewhere."""
    frames = user_frames(spark, folder).withColumn("mask", F.col("event_type") == "error")
    diffs = sequence.second_difference(frames, ["video"], "frame", "value", ["mask"])
    return sequence.temporal_scores(diffs, ["video"], "mask")


@query(
    "video:i adjacent_min:f4 adjacent_median:f4 adjacent_p95:f4 adjacent_max:f4 exact_duplicates:i",
    f"""
WITH {FRAMES_SQL},
steps AS (SELECT video, abs(value - lag(value) OVER (PARTITION BY video ORDER BY frame)) AS s FROM frames)
SELECT video, min(s) AS adjacent_min, quantile_cont(s, 0.5) AS adjacent_median, quantile_cont(s, 0.95) AS adjacent_p95,
       max(s) AS adjacent_max, count(*) FILTER (s = 0) AS exact_duplicates
FROM steps WHERE s IS NOT NULL GROUP BY video""",
)
def adjacent_stats(spark, folder):
    """Distribution of step sizes per user."""
    frames = user_frames(spark, folder)
    near = sequence.with_adjacent(frames.select("video", "frame", "value"), ["video"], "frame", ["value"])
    steps = near.withColumn("s", F.abs(F.col("value") - F.col("prev_value"))).filter("s is not null").withColumn("same", F.col("s") == 0)
    return sequence.adjacent_stats(steps, ["video"], "s", "same")


@query(
    "video:i frames:i spatial_std_min:f8 spatial_std_max:f8 near_black_max:f8 near_white_max:f8 "
    "adjacent_min:f8 adjacent_median:f8 adjacent_p95:f8 adjacent_max:f8 exact_duplicates:i",
    f"""
WITH {PIXELS_SQL},
long AS (
  SELECT video, frame, y, x, c, v FROM pixels, LATERAL (VALUES ('r', r), ('g', g), ('b', b)) AS u(c, v)),
per_frame AS (
  SELECT video, frame, stddev_pop(v) AS std, avg(CASE WHEN v <= 2 THEN 1.0 ELSE 0.0 END) AS dark,
         avg(CASE WHEN v >= 253 THEN 1.0 ELSE 0.0 END) AS bright FROM long GROUP BY video, frame),
steps AS (
  SELECT video, frame, v, lag(v) OVER (PARTITION BY video, y, x, c ORDER BY frame) AS p FROM long),
change AS (
  SELECT video, frame, avg(abs(v - p)) AS mae, bool_and(v = p) AS same FROM steps WHERE p IS NOT NULL GROUP BY video, frame),
moved AS (
  SELECT video, min(mae) AS adjacent_min, quantile_cont(mae, 0.5) AS adjacent_median, quantile_cont(mae, 0.95) AS adjacent_p95,
         max(mae) AS adjacent_max, count(*) FILTER (same) AS exact_duplicates FROM change GROUP BY video)
SELECT f.video, count(*) AS frames, min(std) AS spatial_std_min, max(std) AS spatial_std_max,
       max(dark) AS near_black_max, max(bright) AS near_white_max, any_value(adjacent_min) AS adjacent_min,
       any_value(adjacent_median) AS adjacent_median, any_value(adjacent_p95) AS adjacent_p95,
       any_value(adjacent_max) AS adjacent_max, any_value(exact_duplicates) AS exact_duplicates
FROM per_frame f LEFT JOIN moved m ON f.video = m.video GROUP BY f.video""",
)
def frame_stats(spark, folder):
    """Decoded-video statistics of the 8 x 8 videos."""
    return sequence.frame_stats(frame_pixels(spark, folder))


@query(
    "video:i y:i x:i r:i g:i b:i",
    f"""
WITH {PIXELS_SQL}
SELECT video, y, x, CAST(floor(quantile_cont(r, 0.5)) AS INTEGER) AS r, CAST(floor(quantile_cont(g, 0.5)) AS INTEGER) AS g,
       CAST(floor(quantile_cont(b, 0.5)) AS INTEGER) AS b FROM pixels GROUP BY video, y, x""",
)
def frame_median(spark, folder):
    """Per-pixel background of every video."""
    return sequence.frame_median(frame_pixels(spark, folder))


@query(
    "video:i mae:f6 psnr_db:f4",
    f"""
WITH {PIXELS_SQL},
a AS (SELECT * FROM pixels WHERE frame = 0),
b AS (SELECT * FROM pixels WHERE frame = 1),
e AS (
  SELECT a.video, avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3.0) AS mae,
         avg(((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) / 3.0) AS mse
  FROM a JOIN b ON a.video = b.video AND a.y = b.y AND a.x = b.x GROUP BY a.video)
SELECT video, mae, CASE WHEN mse > 0 THEN 10.0 * log10(65025.0 / mse) END AS psnr_db FROM e""",
)
def first_frame_psnr(spark, folder):
    """Error and PSNR of the first two frames of every video."""
    pixels = frame_pixels(spark, folder)
    return sequence.frame_psnr(pixels.filter("frame = 0"), pixels.filter("frame = 1"))


@query(
    "video:i start_frame:i end_frame:i frames:i",
    f"""
WITH {FRAMES_SQL},
good AS (SELECT video, frame, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS run FROM frames WHERE value > 20)
SELECT video, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames
FROM good GROUP BY video, run HAVING count(*) > 1""",
)
def finite_runs(spark, folder):
    """Runs of consecutive events above a threshold."""
    return sequence.finite_runs(user_frames(spark, folder), ["video"], "frame", F.col("value") > 20)


@query(
    "video:i frame:i value:f4",
    f"""
WITH {FRAMES_SQL},
seen AS (
  SELECT video, frame, value, min(value) OVER (
    PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM frames)
SELECT video, frame, value FROM seen WHERE best IS NULL OR value < best""",
)
def running_best(spark, folder):
    """Events that improve on every earlier value of their user."""
    return sequence.running_best(user_frames(spark, folder), ["video"], "frame", "value").select("video", "frame", "value")


@query(
    "video:i event_type:s latent:i value:f4 top:f4",
    f"""
WITH {FRAMES_SQL},
keyed AS (SELECT video, event_type, value, CASE WHEN frame = 0 THEN 0 ELSE (frame - 1) // 4 + 1 END AS latent FROM frames)
SELECT video, event_type, latent, sum(value) / CASE WHEN latent = 0 THEN 1.0 ELSE 4.0 END AS value, max(value) AS top
FROM keyed GROUP BY video, event_type, latent""",
)
def temporal_pool4(spark, folder):
    """Windows of four frames per event type; missing cells count as zero."""
    frames = user_frames(spark, folder)
    mean = sequence.temporal_pool4(frames, ["video", "event_type"], ["value"])
    top = sequence.temporal_pool4(frames, ["video", "event_type"], ["value"], how="max").withColumnRenamed("value", "top")
    return mean.join(top, ["video", "event_type", "latent"])


@query(
    "video:i event_type:s frame:i",
    f"""
WITH {FRAMES_SQL},
mask AS (SELECT DISTINCT video, event_type, CASE WHEN frame = 0 THEN 0 ELSE (frame - 1) // 4 + 1 END AS latent
         FROM frames WHERE event_type = 'error')
SELECT video, event_type, CASE WHEN latent = 0 THEN 0 ELSE 4 * (latent - 1) + 1 + j END AS frame
FROM mask, range(4) AS t(j) WHERE latent > 0 OR j = 0""",
)
def mask_hold(spark, folder):
    """Latent windows with an error, expanded to their frames."""
    frames = user_frames(spark, folder).filter("event_type = 'error'")
    mask = frames.select("video", "event_type", latent_frame(F.col("frame")).alias("latent")).distinct()
    return sequence.mask_hold(mask)


def _clips(spark, folder):
    """Candidates: a clip is one user's day, three candidates per event (some without any)."""
    events = load(spark, folder, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type", "value")
    day = F.floor(F.col("t") / F.lit(86_400_000_000))
    clips = events.withColumn("video", F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string")))
    frames = index_within(clips, ["video"], ["t", "event_id"], F.floor(F.col("t") / F.lit(3_600_000_000)), "frame")
    v = F.col("value")
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("candidate_id"), (v * a % 200.0).alias("cx"), (v * b % 120.0).alias("cy"), (v + 50.0 * i + 50.0).alias("area"))
            for i, (a, b) in enumerate(((3.0, 5.0), (7.0, 2.0), (1.0, 11.0)))
        ]
    )
    none = F.array(
        F.struct(F.lit(0).alias("candidate_id"), F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"), F.lit(0.0).alias("area"))
    )
    return frames.select(
        "video", "frame", F.explode(F.when(F.col("event_type") == "error", none).otherwise(spots)).alias("_c")
    ).select("video", "frame", "_c.*")


def _tracked(spark, folder):
    candidates = _clips(spark, folder)
    seeds = candidates.select("video").distinct().select("video", F.lit(100.0).alias("sx"), F.lit(60.0).alias("sy"))
    return sequence.track_candidates(candidates, seeds)


#: The tracker as a walk over frames: the state of every video advances by one frame a round.
WALK_SQL = """
e AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS video, epoch_us(ts) AS t, event_id, event_type, value AS v FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, event_id) - 1 AS frame FROM e),
cand AS (
  SELECT video, frame, CASE WHEN event_type = 'error' THEN [] ELSE [
    {'i': 0, 'x': CAST(v * 3.0 % 200.0 AS FLOAT), 'y': CAST(v * 5.0 % 120.0 AS FLOAT), 'a': v + 50.0}, {'i': 1, 'x': CAST(v * 7.0 % 200.0 AS FLOAT), 'y': CAST(v * 2.0 % 120.0 AS FLOAT), 'a': v + 100.0},
    {'i': 2, 'x': CAST(v * 1.0 % 200.0 AS FLOAT), 'y': CAST(v * 11.0 % 120.0 AS FLOAT), 'a': v + 150.0}] END AS c,
    v * 3.0 % 200.0 AS u, v * 5.0 % 120.0 AS w, event_type <> 'error' AS seen FROM f),
walk AS (
  SELECT video, CAST(-1 AS BIGINT) AS frame, NULL::FLOAT AS lx, NULL::FLOAT AS ly, NULL::FLOAT AS px, NULL::FLOAT AS py, 0::DOUBLE AS area, NULL::FLOAT AS cx, NULL::FLOAT AS cy FROM (SELECT DISTINCT video FROM cand)
  UNION ALL
  SELECT video, frame, coalesce(b.x, lx), coalesce(b.y, ly), CASE WHEN b IS NULL THEN px ELSE lx END, CASE WHEN b IS NULL THEN py ELSE ly END, coalesce(b.a, 0), b.x, b.y
  FROM (
    SELECT s.*, c.frame AS frame, list_sort(list_transform(list_filter(list_transform(c.c, lambda z: {'d': CAST(sqrt((z.x - ax) * (z.x - ax) + (z.y - ay) * (z.y - ay)) AS FLOAT)::DOUBLE, 'z': z}), lambda z: z.d <= most),
        lambda z: {'cost': z.d + CASE WHEN known > 0 THEN 3.0 * abs(ln(greatest(z.z.a, 1.0) / greatest(known, 1.0))) ELSE 0 END, 'i': z.z.i, 'x': z.z.x, 'y': z.z.y, 'a': z.z.a}))[1] AS b
    FROM (
      SELECT video, frame + 1 AS next, lx, ly, px, py, CASE WHEN lx IS NULL THEN 160.0 ELSE 150.0 END AS most, CASE WHEN lx IS NULL THEN 0 ELSE area END AS known,
        CASE WHEN lx IS NULL THEN 100::FLOAT WHEN px IS NULL THEN lx ELSE lx + (lx - px) END AS ax, CASE WHEN lx IS NULL THEN 60::FLOAT WHEN py IS NULL THEN ly ELSE ly + (ly - py) END AS ay FROM walk) s
    JOIN cand c ON c.video = s.video AND c.frame = s.next)),
tracked AS (SELECT video, frame, cx, cy, area FROM walk WHERE frame >= 0)"""


@query("video:s frame:i cx:f4 cy:f4 area:f4", f"WITH RECURSIVE {WALK_SQL} SELECT * FROM tracked")
def track_candidates(spark, folder):
    """Greedy tracker; checked against a plain loop in the tests."""
    return _tracked(spark, folder)


@query("video:s frame:i cx:f4 cy:f4 area:f4 late:b", f"WITH RECURSIVE {WALK_SQL} SELECT *, false AS late FROM tracked")
def live_tracker(spark, folder):
    """The tracker as a stream with state, fed day by day; every day's clips equal the batch tracker's."""
    source, out = shared_folder(spark, "candidates"), shared_folder(spark, "live-tracks")
    rows = _clips(spark, folder).withColumns({"sx": F.lit(100.0), "sy": F.lit(60.0), "_day": F.substring_index("video", ":", -1)})
    schema = rows.drop("_day").schema
    rows.repartition("_day").write.partitionBy("_day").parquet(source)
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "16").option("recursiveFileLookup", "true").parquet(source)
        drain(live.live_tracker(stream), out, "append")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


@query(
    "video:s frames:i detected_frames:i detection_coverage:f6 mean_distance_px:f4 median_distance_px:f4 p95_distance_px:f4 rmse_px:f4 max_distance_px:f4",
    f"""WITH RECURSIVE {WALK_SQL},
    g AS (SELECT t.video, sqrt((cx - u) * (cx - u) + (cy - w) * (cy - w)) AS d FROM (SELECT video, frame, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM tracked WHERE cx IS NOT NULL) t
      JOIN cand c ON c.video = t.video AND c.frame = t.frame AND seen),
    stats AS (SELECT video, round_even(avg(d), 4) AS mean_distance_px, round_even(quantile_cont(d, 0.5), 4) AS median_distance_px, round_even(quantile_cont(d, 0.95), 4) AS p95_distance_px,
      round_even(sqrt(avg(d * d)), 4) AS rmse_px, round_even(max(d), 4) AS max_distance_px FROM g GROUP BY video),
    base AS (SELECT video, count(*) AS frames, count(cx) AS detected_frames, round_even(count(cx) / count(*), 6) AS detection_coverage FROM tracked GROUP BY video)
    SELECT * FROM base LEFT JOIN stats USING (video)""",
)
def trajectory_report(spark, folder):
    """Coverage and error of the tracked path against each frame's first candidate."""
    observed = _tracked(spark, folder)
    reference = _clips(spark, folder).filter("candidate_id = 0").select("video", "frame", F.col("cx").alias("u"), F.col("cy").alias("v"))
    return sequence.trajectory_report(observed, sequence.track_error(observed, reference))


@query(
    "video:i distance_rows:i mean_distance:f4 max_distance:f4",
    f"""
WITH {FRAMES_SQL},
e AS (SELECT video, sqrt((value - 20.0) * (value - 20.0) + (value * 0.5 - 10.0) * (value * 0.5 - 10.0)) AS d
      FROM frames WHERE event_type <> 'error' AND value < 80)
SELECT video, count(*) AS distance_rows, avg(d) AS mean_distance, max(d) AS max_distance FROM e GROUP BY video""",
)
def track_error(spark, folder):
    """Distances where both the observed and the reference position exist."""
    frames = user_frames(spark, folder)
    observed = frames.select(
        "video", "frame", F.when(F.col("event_type") != "error", F.col("value")).alias("cx"), (F.col("value") * 0.5).alias("cy")
    )
    nan = F.lit(float("nan"))
    reference = frames.select("video", "frame", F.when(F.col("value") < 80, F.lit(20.0)).otherwise(nan).alias("u"), F.lit(10.0).alias("v"))
    errors = sequence.track_error(observed, reference)
    return errors.groupBy("video").agg(
        F.count(F.lit(1)).alias("distance_rows"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")
    )


@query(
    "video:i smooth_l1:f6",
    f"""
WITH {FRAMES_SQL},
near AS (
  SELECT video, (value - lag(value) OVER w) - (value * 1.01 - lag(value * 1.01) OVER w) AS d
  FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame))
SELECT video, avg(CASE WHEN abs(d) < 0.05 THEN 0.5 * d * d / 0.05 ELSE abs(d) - 0.025 END) AS smooth_l1
FROM near WHERE d IS NOT NULL GROUP BY video""",
)
def smooth_l1(spark, folder):
    """Smooth-L1 of adjacent changes between values and a scaled copy."""
    frames = user_frames(spark, folder).withColumn("target", F.col("value") * 1.01)
    return metrics.smooth_l1_delta(frames, ["video"], [], "frame", "value", "target")
