"""Cache headers and track manifests: every rule is broken by some of the documents built from orders."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trackloom import contracts as C
from trackloom.operators import documents, headers
from trackloom.plans.spec import query
from trackloom.plans.tables import load

FILES = [("m.json", "aa"), ("t.json", "bb"), ("r.json", "cc")]


def _preprocess(kind: int, width: int) -> dict | None:
    """Stated preprocessing of a header: dense for kinds 4 and 5, else identity maps; 3, 6 and 7 are off."""
    size = {"source_schema": "x.point_trajectories.v1", "preprocess_size_px": [width, 480]}
    if kind in (4, 5):
        return size | C.PREPROCESS_DENSE | (C.PREPROCESS_CURRENT if kind == 4 else {})
    out = size | C.PREPROCESS_IDENTITY | C.PREPROCESS_CURRENT
    if kind == 3:
        out = out | {"representation": "unknown_tracks"}
    if kind == 6:
        out = out | {"max_objects": 2}
    if kind == 7:
        out = {**out, "channels": ["identity_r", "identity_g", "identity_x", "visibility"]}
        del out["visibility"]
    return out


def _header(kind: int) -> str:
    version = {1: 9, 2: 3, 5: 3}.get(kind, 4)
    head = {
        "schema": f"x.wan_ti2v_cache.v{version}", "preprocess": {"frames": 97, "height": 480, "width": 832}, "point_track_preprocess": _preprocess(kind, 832),
        "source_manifest": "m.json", "source_manifest_sha256": "zz" if kind == 8 else "aa",
        "source_point_trajectory_manifest": "gone.json" if kind == 9 else "t.json", "source_point_trajectory_manifest_sha256": "bb",
    }
    if kind >= 10:
        head |= {"reused_cache_manifest": "r.json", "reused_cache_manifest_sha256": "zz" if kind == 10 else "cc"}
    return json.dumps(head)


def _headers(spark, folder):
    """One header for every order; its kind is the order key modulo twelve."""
    kind = F.col("o_orderkey") % 12
    raw = F.get(F.array(*[F.lit(_header(k)) for k in range(12)]), kind.cast("int"))
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("header"), F.parse_json(raw).alias("doc"))


@query(
    "header:i rule_id:s detail:s",
    """WITH o AS (SELECT o_orderkey AS header, o_orderkey % 12 AS kind FROM orders),
    r AS (SELECT * FROM (VALUES (1, 'header.schema', 'x.wan_ti2v_cache.v9'), (1, 'preprocess.version', 'x.wan_ti2v_cache.v9'), (2, 'preprocess.version', 'x.wan_ti2v_cache.v3'),
      (3, 'preprocess.representation', 'unknown_tracks'), (6, 'preprocess.contract', '$.max_objects'), (7, 'preprocess.contract', '$.channels[2]'), (7, 'preprocess.contract', '$.visibility'),
      (8, 'header.manifest', 'm.json'), (9, 'header.tracks', 'gone.json'), (10, 'header.reused', 'r.json')) t(kind, rule_id, detail))
    SELECT header, rule_id, detail FROM o JOIN r USING (kind)""",
)
def cache_header_audit(spark, folder):
    """Header, file and preprocessing rules of cache headers, the differing path named."""
    return headers.audit_headers(_headers(spark, folder), spark.createDataFrame(FILES, "path string, sha256 string"), "header")


@query(
    "header:i latent:s track:s",
    """SELECT o_orderkey AS header, '48,25,30,52' AS latent,
    CASE WHEN o_orderkey % 12 = 3 THEN NULL WHEN o_orderkey % 12 IN (4, 5) THEN '18,25,30,52' ELSE '12,97,30,52' END AS track FROM orders""",
)
def cache_shapes(spark, folder):
    """Tensor shapes that a header asks for."""
    f = headers.header_fields(_headers(spark, folder))
    track = F.when(F.get("track_shape", F.lit(0)).isNotNull(), F.array_join("track_shape", ","))
    return f.select("header", F.array_join("latent_shape", ",").alias("latent"), track.alias("track"))


@query(
    "manifest:i rule_id:s detail:s",
    """WITH d AS (SELECT o_orderkey // 512 AS manifest, (o_orderkey // 512) % 6 AS kind, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
    SELECT manifest, CASE kind WHEN 1 THEN 'tracks.schema' WHEN 2 THEN 'tracks.records' WHEN 3 THEN 'tracks.empty_id' WHEN 4 THEN 'tracks.duplicate' ELSE 'tracks.count' END AS rule_id,
      CASE kind WHEN 1 THEN 'other' WHEN 4 THEN CAST(first AS VARCHAR) WHEN 5 THEN CAST(n + 1 AS VARCHAR) END AS detail FROM d WHERE kind > 0""",
)
def track_manifest_audit(spark, folder):
    """Shape, ids and count of track manifests of 512 order keys each."""
    listed = load(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 512).alias("manifest")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    kind = F.col("manifest") % 6
    ids = F.transform("keys", lambda k: k.cast("string"))
    more = F.when(kind == 3, F.array(F.lit(""))).when(kind == 4, F.slice(ids, 1, 1)).otherwise(F.array().cast("array<string>"))
    records = F.transform(F.concat(ids, more), lambda i: F.struct(i.alias("sample_id")))
    schema = F.when(kind == 1, "other").otherwise("x.point_trajectory_manifest.v1").alias("schema")
    count = F.when(kind == 5, F.size("keys") + 1).when(~kind.isin(2), F.size("keys") + F.size(more)).alias("record_count")
    raw = F.when(kind == 2, F.to_json(F.struct(schema, F.struct(F.lit(1).alias("a")).alias("records")))).otherwise(F.to_json(F.struct(schema, count, records.alias("records"))))
    return headers.audit_track_manifests(listed.select("manifest", F.parse_json(raw).alias("doc")), "manifest")


@query(
    "sample_id:i shape_ok:b values_ok:b",
    """SELECT o_orderkey AS sample_id, o_orderkey % 5 NOT IN (1, 2, 3) AS shape_ok, o_orderkey % 7 NOT IN (1, 2) AS values_ok FROM orders""",
)
def text_contexts(spark, folder):
    """Shape and value rules of text tensors."""
    k = F.col("o_orderkey")
    long, wide, narrow, flat = (F.array(*[F.lit(x) for x in s]) for s in ((513, 4096), (512, 4096), (77, 4095), (4096,)))
    shape = F.when(k % 5 == 1, long).when(k % 5 == 2, narrow).when(k % 5 == 3, flat).otherwise(wide)
    rows = load(spark, folder, "orders").select(k.alias("sample_id"), shape.alias("shape"), F.when(k % 7 == 1, "float32").otherwise("bfloat16").alias("dtype"), (k % 7 != 2).alias("finite"))
    return headers.check_text_contexts(rows)


@query(
    "doc_id:i finding:s",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 1 THEN ' /home/someone/data' WHEN 2 THEN ' C:\Users\someone' WHEN 3 THEN ' /mnt/data/someone/x' ELSE '' END AS t FROM documents)
    SELECT doc_id, 'home_path' AS finding FROM d WHERE regexp_matches(t, '/home/[A-Za-z0-9_][A-Za-z0-9_.-]*')
    UNION ALL SELECT doc_id, 'windows_path' FROM d WHERE regexp_matches(t, '(?i)[a-z]:\\users\\[^\\\s]+')
    UNION ALL SELECT doc_id, 'data_mount' FROM d WHERE regexp_matches(t, '/mnt/data/[A-Za-z0-9_.-]+')""",
)
def machine_paths(spark, folder):
    """Personal folders in whole texts; most texts are given one."""
    more = F.get(F.array(*[F.lit(x) for x in ("", " /home/someone/data", r" C:\Users\someone", " /mnt/data/someone/x")]), (F.col("doc_id") % 4).cast("int"))
    docs = load(spark, folder, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return documents.machine_paths(docs, "doc_id")
