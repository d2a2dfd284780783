"""Array archives, images and documents: written by tasks, some of them damaged, and read back."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackloom.operators import raster
from trackloom.plans.spec import query
from trackloom.plans.tables import load
from trackloom.session import shared_folder
from trackloom.sources import archives, images, manifest, sinks

#: Vectors of one archive; every kind of damage meets one archive in eight.
PER_FILE = 64


def _files(spark, folder: str, name: str, pack) -> str:
    """One file per 64 consecutive vectors, packed by ``pack(sample, vectors)``."""
    path = shared_folder(spark, "archives")

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        sample = int(group["vec_id"].iloc[0]) // PER_FILE
        return pd.DataFrame({"path": [name.format(sample)], "content": [pack(sample, np.stack(group["embedding"].to_list()).astype("float32"))]})

    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding")
    sinks.write_files(vectors.groupBy(F.floor(F.col("vec_id") / PER_FILE)).applyInPandas(of, "path string, content binary"), path)
    return path


def _track(sample: int, e: np.ndarray) -> bytes:
    frames, kind = 4, sample % 8
    world = np.stack([e[None, :, 3 * t : 3 * t + 3] for t in range(frames)])
    camera = world + np.float32([0, 0, 2])
    valid = np.stack([(e[None, :, 40 + t] > 0) for t in range(frames)]).astype("uint8")
    if kind == 3:
        valid[0, 0, 0] = 2
    arrays = {
        "time_s": np.arange(frames) / 24, "object_ids": np.array(["o0"]), "points_world_m": world, "points_camera_m": camera,
        "tracks_xy_px": np.stack([np.stack([e[None, :, 20 + t], e[None, :, 30 + t]], -1) for t in range(frames)]), "depth_m": camera[..., 2], "valid": valid,
        "initial_points_camera_m": camera[0], "camera_from_world": np.eye(4), "camera_intrinsics": np.eye(3), "image_size_px": np.array([40, 30]), "metadata_json": np.array("{}"),
    }
    if kind == 2:
        del arrays["depth_m"]
    if kind == 4:
        arrays["tracks_xy_px"] = camera
    if kind == 5:
        del arrays["camera_from_world"]
    content = archives.pack_npz(arrays)
    return b"no archive" if kind == 6 else content[:-200] if kind == 1 else content


def _tracks(spark, folder: str):
    return archives.read_tracks(archives.binary_files(spark, _files(spark, folder, "{}.npz", _track)))


VECTORS = """
v AS (SELECT vec_id // 64 AS s, (vec_id // 64) % 8 AS kind, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
samples AS (SELECT s, kind, count(*) AS n FROM v GROUP BY s, kind)"""


@query(
    "sample_id:i frame:i points:i x:f4 u:f4 depth:f4 flagged:i odd:i",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, t AS frame, count(*) AS points, sum(e[3 * t + 1]) AS x, sum(e[21 + t]) AS u, sum(e[3 * t + 3] + 2) AS depth,
      count(*) FILTER (e[41 + t] > 0 OR (kind = 3 AND t = 0 AND vec_id % 64 = 0)) AS flagged, count(*) FILTER (kind = 3 AND t = 0 AND vec_id % 64 = 0) AS odd
    FROM v, range(4) r(t) WHERE kind NOT IN (1, 2, 4, 6) GROUP BY s, t""",
)
def archive_points(spark, folder):
    """Points of all archives that can be read; damaged ones give none."""
    return _tracks(spark, folder)["points"].groupBy("sample_id", "frame").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("wx").cast("double")).alias("x"), F.sum(F.col("u").cast("double")).alias("u"), F.sum(F.col("depth").cast("double")).alias("depth"),
        F.count_if("valid").alias("flagged"), F.count_if(~F.col("valid_binary")).alias("odd"),
    )


@query(
    "sample_id:i lacking:s problem:s",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, CASE kind WHEN 2 THEN 'depth_m' WHEN 4 THEN 'tracks_xy_px' WHEN 5 THEN 'camera_from_world' END AS lacking,
      CASE WHEN kind IN (1, 6) THEN 'unreadable' WHEN kind = 4 THEN 'shape' ELSE 'missing' END AS problem
    FROM samples WHERE kind IN (1, 2, 4, 5, 6)""",
)
def archive_problems(spark, folder):
    return _tracks(spark, folder)["problems"].withColumnRenamed("array", "lacking")


@query(
    "sample_id:i fields:i frames:i objects:i width:i height:i times:f4 static_views:i starts:i",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, CASE WHEN kind IN (2, 5) THEN 11 ELSE 12 END AS fields, 4 AS frames, 1 AS objects, 40 AS width, 30 AS height, 6.0 / 24 AS times,
      CASE WHEN kind = 5 THEN 0 ELSE 1 END AS static_views, n AS starts FROM samples WHERE kind NOT IN (1, 6)""",
)
def archive_headers(spark, folder):
    """Header, cameras and first points of every archive that opens, next to its points that may be lacking."""
    got = _tracks(spark, folder)
    views = got["cameras"].groupBy("sample_id").agg(F.count_if(F.col("frame").isNull()).alias("static_views"))
    starts = got["initial"].groupBy("sample_id").agg(F.count(F.lit(1)).alias("starts"))
    both = got["meta"].join(views, "sample_id", "left").join(starts, "sample_id", "left")
    times = F.aggregate("time_s", F.lit(0.0), lambda a, x: a + x)
    return both.select("sample_id", F.size("fields").alias("fields"), "frames", F.size("object_ids").alias("objects"), "width", "height", times.alias("times"), F.coalesce("static_views", F.lit(0)).alias("static_views"), "starts")


@query(
    "sample_id:i rule_id:s",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, CASE kind WHEN 3 THEN 'T03' ELSE 'T01' END AS rule_id FROM samples WHERE kind IN (2, 3, 5)""",
)
def archive_rules(spark, folder):
    """Presence and flag rules of the track contract, straight from the readers."""
    got = _tracks(spark, folder)
    found = raster.validate_tracks(got["points"], got["cameras"], got["meta"], got["initial"]).select("sample_id", "rule_id")
    # an archive with a problem breaks every rule about what it lacks, so its flags are not judged
    flags = found.where("rule_id = 'T03'").join(got["problems"], "sample_id", "left_anti")
    return found.where("rule_id = 'T01'").union(flags)


def _motion(sample: int, e: np.ndarray) -> bytes:
    arrays = {"time_s": np.arange(len(e)) / 24, "box__position_m": e[:, :3], "box__quaternion_wxyz": e[:, 3:7] if sample % 8 != 2 else e[:, 3:6]}
    arrays |= {f"box__collider_contact_count__c{k}": (e[:, 10 + k] > 0.3).astype("int32") for k in range(4)}
    content = archives.pack_npz(arrays)
    return content[:50] if sample % 8 == 1 else content


@query(
    "sample_id:i object_id:s frames:i x:f4 w:f4 span:f4",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, 'box' AS object_id, count(*) AS frames, sum(e[1]) AS x, sum(e[4]) AS w, (count(*) - 1) / 24.0 AS span FROM v WHERE kind NOT IN (1, 2) GROUP BY s""",
)
def archive_poses(spark, folder):
    got = archives.read_motion(archives.binary_files(spark, _files(spark, folder, "{}.npz", _motion)))
    return got["poses"].groupBy("sample_id", "object_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("px").alias("x"), F.sum("qw").alias("w"), (F.max("t") - F.min("t")).alias("span")
    )


@query(
    "sample_id:i object_id:s collider_id:s",
    f"WITH {VECTORS} SELECT DISTINCT s AS sample_id, 'box' AS object_id, 'c' || k AS collider_id FROM v, range(4) r(k) WHERE kind <> 1 AND e[11 + k] > CAST(0.3::FLOAT AS DOUBLE)",
)
def archive_contacts(spark, folder):
    """Colliders touched in any frame; a broken pose does not hide them."""
    return archives.read_contacts(archives.binary_files(spark, _files(spark, folder, "{}.npz", _motion)))


def _scene(sample: int, e: np.ndarray) -> bytes:
    arrays = {
        "object_xyz_camera_m": np.stack([e[:, :3], e[:, 3:6]]), "object_normal_camera": np.stack([e[:, 6:9], e[:, 9:12]]), "environment_xyz_camera_m": e[:, 12:15],
        "environment_normal_camera": e[:, 15:18], "environment_friction": e[:, 18:19], "environment_restitution": e[:, 19], "camera_intrinsics_normalized": e[0, :4],
    }
    if sample % 8 == 1:
        del arrays["environment_friction"]
    if sample % 8 == 2:
        arrays["environment_restitution"] = e[1:, 19]
    return archives.pack_npz(arrays)


@query(
    "scene:i body:i slot:i points:i x:f4 nx:f4 friction:f4 focal:f4",
    f"""WITH {VECTORS}
    SELECT s AS scene, CASE WHEN b = 2 THEN 0 ELSE 1 END AS body, CASE WHEN b = 2 THEN -1 ELSE b END AS slot, count(*) AS points,
      sum(CASE b WHEN 0 THEN e[1] WHEN 1 THEN e[4] ELSE e[13] END) AS x, sum(CASE b WHEN 0 THEN e[7] WHEN 1 THEN e[10] ELSE e[16] END) AS nx,
      sum(CASE WHEN b = 2 THEN e[19] END) AS friction, min(e[1]) FILTER (vec_id % 64 = 0) AS focal
    FROM v, range(3) r(b) WHERE kind NOT IN (1, 2) GROUP BY s, b""",
)
def archive_scenes(spark, folder):
    """Object and environment points of a scene with its camera."""
    points, cameras = archives.read_scene_points(archives.binary_files(spark, _files(spark, folder, "{}.npz", _scene)))
    total = lambda c: F.sum(F.col(c).cast("double"))
    sums = points.groupBy("scene", "body", "slot").agg(F.count(F.lit(1)).alias("points"), total("x").alias("x"), total("nx").alias("nx"), total("friction").alias("friction"))
    return sums.join(cameras.select("scene", F.col("intrinsics")[0].alias("focal")), "scene")


def _cells(sample: int, e: np.ndarray) -> bytes:
    tensor = np.maximum(e[:, :60], 0).reshape(len(e), 12, 1, 5).transpose(1, 0, 2, 3)
    content = archives.pack_safetensors({"other" if sample % 8 == 2 else "point_track_map": tensor})
    return content[:-40] if sample % 8 == 1 else content


@query(
    "sample_id:i slot:i cells:i r:f4 visible:f4",
    f"""WITH {VECTORS},
    c AS (SELECT s, k AS slot, e[20 * k + x + 1] AS r, e[20 * k + x + 6] AS g, e[20 * k + x + 11] AS b, e[20 * k + x + 16] AS w
      FROM v, range(3) a(k), range(5) d(x) WHERE kind NOT IN (1, 2))
    SELECT s AS sample_id, slot, count(*) AS cells, sum(greatest(r, 0)) AS r, sum(greatest(w, 0)) AS visible FROM c WHERE greatest(r, g, b, w) > 0 GROUP BY s, slot""",
)
def archive_cells(spark, folder):
    """Non-zero cells of identity maps, through the table that sinks keep them in."""
    cells, _ = archives.read_track_cells(archives.binary_files(spark, _files(spark, folder, "{}.safetensors", _cells), "*.safetensors"))
    path = shared_folder(spark, "cells")
    sinks.write_track_cells(cells, path, 8)
    kept = spark.read.parquet(path)
    return kept.groupBy("sample_id", "slot").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("r").cast("double")).alias("r"), F.sum(F.col("visible").cast("double")).alias("visible"))


@query(
    "sample_id:i tensor:s frames:i ok:b problems:i",
    f"""WITH {VECTORS}
    SELECT s AS sample_id, CASE kind WHEN 1 THEN NULL WHEN 2 THEN 'other' ELSE 'point_track_map' END AS tensor, CASE WHEN kind NOT IN (1, 2) THEN n END AS frames,
      kind NOT IN (1, 2) AS ok, CASE kind WHEN 1 THEN 2 ELSE 0 END AS problems FROM samples""",
)
def archive_tensors(spark, folder):
    """Header of every tensor file; a cut file has problems instead."""
    got = archives.read_cell_tables(archives.binary_files(spark, _files(spark, folder, "{}.safetensors", _cells), "*.safetensors"))
    lost = got["problems"].groupBy("sample_id").agg(F.count(F.lit(1)).alias("problems"))
    both = got["header"].join(lost, "sample_id", "full")
    return both.select("sample_id", F.get("tensors", F.lit(0)).alias("tensor"), F.get("shape", F.lit(1)).alias("frames"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("problems", F.lit(0)).alias("problems"))


def _png(sample: int, e: np.ndarray) -> bytes:
    """A grey PNG, a row for each vector; one in eight is constant."""
    grey = np.where(e > 0, 255, 0).astype("uint8") if sample % 8 != 1 else np.zeros(e.shape, "uint8")
    lines = b"".join(b"\0" + row.tobytes() for row in grey)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    size = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query(
    "image:i height:i problem:s pixels:i across:i",
    f"""WITH {VECTORS}
    SELECT s AS image, count(DISTINCT vec_id) AS height, CASE WHEN kind = 1 THEN 'constant mask' END AS problem,
      count(*) FILTER (kind <> 1 AND e[x + 1] > 0) AS pixels, coalesce(sum(x) FILTER (kind <> 1 AND e[x + 1] > 0), 0) AS across
    FROM v, range(64) r(x) GROUP BY s, kind""",
)
def mask_images(spark, folder):
    """Masks read from image files; constant ones are rejected."""
    pixels, status = images.read_masks(spark, _files(spark, folder, "{}.png", _png))
    on = pixels.groupBy("source").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("across"))
    image = F.regexp_extract("source", r"(\d+)\.png$", 1)
    return status.join(on, "source", "left").select(image.alias("image"), "height", "problem", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.coalesce("across", F.lit(0)).alias("across"))


@query(
    "document:i readable:b records:i stated:i agrees:b first_sample:s last_place:i",
    """WITH o AS (SELECT o_orderkey // 512 AS d, o_orderkey FROM orders)
    SELECT d AS document, d % 5 <> 1 AS readable, CASE WHEN d % 5 <> 1 THEN count(*) END AS records, CASE WHEN d % 5 <> 1 THEN count(*) + CASE WHEN d % 5 = 2 THEN 1 ELSE 0 END END AS stated,
      d % 5 NOT IN (1, 2) AS agrees, CASE WHEN d % 5 <> 1 THEN CAST(min(o_orderkey) AS VARCHAR) END AS first_sample, CASE WHEN d % 5 <> 1 THEN count(*) - 1 END AS last_place FROM o GROUP BY d""",
)
def document_records(spark, folder):
    """Whole JSON documents of 512 order keys each: some state a wrong count, some are cut short."""
    path = shared_folder(spark, "documents")
    part = F.floor(F.col("o_orderkey") / 512)
    listed = load(spark, folder, "orders").groupBy(part.alias("d")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    items = F.transform("keys", lambda k: F.struct(k.cast("string").alias("sample_id")))
    text = F.to_json(F.struct((F.size("keys") + F.when(F.col("d") % 5 == 2, 1).otherwise(0)).alias("record_count"), items.alias("records")))
    text = F.when(F.col("d") % 5 == 1, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    sinks.write_files(listed.select(F.concat(F.col("d").cast("string"), F.lit(".json")).alias("path"), F.encode(text, "UTF-8").alias("content")), path)
    header, records = manifest.read_document(spark, path)
    ends = records.groupBy("source").agg(F.min_by("sample_id", "ordinal").alias("first_sample"), F.max("ordinal").alias("last_place"))
    document = F.regexp_extract("source", r"(\d+)\.json$", 1)
    return header.join(ends, "source", "left").select(
        document.alias("document"), "readable", F.when(F.col("readable"), F.col("records_found")).alias("records"), F.col("record_count").alias("stated"), F.col("count_ok").alias("agrees"), "first_sample", "last_place"
    )


@query(
    "sample_id:s reports:i videos:i place:i",
    """WITH r AS (SELECT l_partkey % 40 AS part, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 's' || (l_partkey % 7) END AS sample, l_partkey % 2 = 0 AS video FROM lineitem GROUP BY ALL),
    f AS (SELECT sample, count(*) AS reports, count(*) FILTER (video) AS videos, min(printf('%02d', part) || '/' || sample || CASE WHEN video THEN 'v' ELSE 'n' END) AS first FROM r WHERE sample IS NOT NULL GROUP BY sample)
    SELECT sample AS sample_id, reports, videos, row_number() OVER (ORDER BY first) - 1 AS place FROM f""",
)
def report_tree(spark, folder):
    """Reports in folders, some next to a video: counted, and ordered by the first path that names a sample."""
    path = shared_folder(spark, "reports")
    key = F.col("l_partkey")
    rows = load(spark, folder, "lineitem").select(
        (key % 40).alias("part"), F.when(key % 3 != 0, F.concat(F.lit("s"), (key % 7).cast("string"))).alias("sample_id"), (key % 2 == 0).alias("video")
    ).distinct()
    stem = F.concat(F.format_string("%02d/", F.col("part").cast("int")), F.coalesce("sample_id", F.lit("none")), F.when(F.col("video"), "v").otherwise("n"))
    body = F.to_json(F.struct("sample_id"))
    both = rows.select(F.explode(F.array(F.struct(F.concat(stem, F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content")), F.when(F.col("video"), F.struct(F.concat(stem, F.lit(".mp4")).alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"))))).alias("f"))
    sinks.write_files(both.where("f is not null").select("f.path", "f.content"), path)
    reports = manifest.read_reports(spark, path)
    counts = reports.groupBy("sample_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if("has_video").alias("videos"))
    summary = shared_folder(spark, "summary")
    sinks.write_report(counts.where(F.length("sample_id") > 0), summary)
    first = manifest.first_seen_ids(reports)
    ordered = first.select("sample_id", F.expr("row_number() over (order by first_path) - 1").alias("place"))
    return spark.read.json(summary).join(ordered, "sample_id")
