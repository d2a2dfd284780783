"""Cache headers: stated contracts compared with what they should state, by JSON path."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C

LEAVES = "path string, value string"


def _leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """Scalars of a JSON value with their paths; an empty container is a leaf. Walks a stack, so depth is no limit."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{at}.{name}", inner) for name, inner in v.items()]
        elif isinstance(v, list) and v:
            stack += [(f"{at}[{i}]", inner) for i, inner in enumerate(v)]
        else:
            yield at, json.dumps(v)


def json_leaves(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, path, value): every scalar of a JSON text as JSON, at any depth, in one pass.

    NULL gives no rows; a text that is no JSON gives the path ``$`` with a NULL value.
    """
    name = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, paths, values = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    found = list(_leaves(json.loads(text)))
                except (ValueError, RecursionError):
                    found = [("$", None)]
                place += [i] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

    return docs.select(key, raw).mapInArrow(run, f"`{key}` {name.dataType.simpleString()}, {LEAVES}")


def json_diff(stated: DataFrame, expected: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, path, stated, expected) wherever two JSON documents of one key differ; a side that lacks a path is NULL."""
    left = json_leaves(stated, key, raw).withColumnRenamed("value", "stated")
    right = json_leaves(expected, key, raw).withColumnRenamed("value", "expected")
    return left.join(right, [key, "path"], "full").filter(~F.col("stated").eqNullSafe(F.col("expected")))


def json_row_diff(docs: DataFrame, key: str, stated: str = "stated", expected: str = "expected") -> DataFrame:
    """As :func:`json_diff` for two JSON texts of the same row, which are compared in place: nothing is shuffled."""
    name = docs.schema[key]

    def leaves(text: str | None) -> dict[str, list[str | None]]:
        found: dict[str, list[str | None]] = {}
        if text is not None:
            try:
                for path, value in _leaves(json.loads(text)):
                    found.setdefault(path, []).append(value)
            except (ValueError, RecursionError):
                return {"$": [None]}
        return found

    def differences(left: str | None, right: str | None) -> list[tuple[str, str | None, str | None]]:
        if left == right:
            return []
        a, b = leaves(left), leaves(right)
        return [(path, x, y) for path in {**a, **b} for x in a.get(path, [None]) for y in b.get(path, [None]) if x != y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, found = [], []
            for i, (left, right) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                more = differences(left, right)
                place += [i] * len(more)
                found += more
            columns = [pa.array([f[j] for f in found], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), *columns], [key, "path", "stated", "expected"])

    return docs.select(key, stated, expected).mapInArrow(run, f"`{key}` {name.dataType.simpleString()}, path string, stated string, expected string")


def _number(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "long")


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def header_fields(headers: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds frames, height, width, representation, current, latent_shape and track_shape to cache headers."""
    d = F.col(doc)
    frames, height, width = (_number(d, f"$.preprocess.{n}") for n in ("frames", "height", "width"))
    representation = F.coalesce(_text(d, "$.point_track_preprocess.representation"), F.lit("dense_point_tracks"))
    identity = representation == "das_3d_tracks"
    latent_frames = F.floor((frames - 1) / 4) + 1
    cells = [F.floor(height / 16), F.floor(width / 16)]
    channels = F.when(identity, 12).when(representation == "dense_point_tracks", 18).cast("long")
    return headers.withColumns(
        {
            "frames": frames, "height": height, "width": width, "representation": representation,
            "current": F.coalesce(_text(d, "$.schema").rlike(C.CURRENT_CACHE_PATTERN), F.lit(False)),
            "latent_shape": F.array(F.lit(C.LATENT_CHANNELS).cast("long"), latent_frames, *cells),
            "track_shape": F.array(channels, F.when(identity, frames).otherwise(latent_frames), *cells),
        }
    )


def _literal(table: Mapping) -> list[Column]:
    return [(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in table.items()]


def expected_preprocess(fields: DataFrame, doc: str = "doc") -> Column:
    """JSON of the track preprocessing that a header with :func:`header_fields` should state; NULL if unknown."""
    stated = _text(F.col(doc), "$.point_track_preprocess.source_schema")
    source = F.when(stated.rlike(C.TRACK_SCHEMA_PATTERN), stated).otherwise("*.point_trajectories.v1").alias("source_schema")
    size = F.array("width", "height").alias("preprocess_size_px")
    tables: Sequence[Column] = [
        F.when(F.col("representation") == "das_3d_tracks", F.to_json(F.struct(source, size, *_literal(C.PREPROCESS_IDENTITY), *_literal(C.PREPROCESS_CURRENT)))),
        F.when((F.col("representation") == "dense_point_tracks") & F.col("current"), F.to_json(F.struct(source, size, *_literal(C.PREPROCESS_DENSE), *_literal(C.PREPROCESS_CURRENT)))),
        F.when(F.col("representation") == "dense_point_tracks", F.to_json(F.struct(source, size, *_literal(C.PREPROCESS_DENSE)))),
    ]
    return F.coalesce(*tables)


def audit_headers(headers: DataFrame, files: DataFrame, key: str = "source", doc: str = "doc") -> DataFrame:
    """Broken rules (key, rule_id, detail) of cache headers; ``files(path, sha256)`` are the files that exist.

    ``header.schema``: version not supported. ``header.manifest``, ``header.tracks``, ``header.reused``: the
    named file is absent or has another hash (the last only if it is named). ``preprocess.representation``:
    unknown. ``preprocess.version``: identity maps need the current schema. ``preprocess.contract``: a path of
    the stated preprocessing that differs from its contract, one row for each.
    """
    fields = header_fields(headers, doc)
    d = F.col(doc)
    named = F.array(
        *[
            F.struct(F.lit(rule).alias("rule_id"), _text(d, f"$.{slot}").alias("path"), _text(d, f"$.{slot}_sha256").alias("_wanted"), F.lit(optional).alias("_optional"))
            for rule, slot, optional in (
                ("header.manifest", "source_manifest", False), ("header.tracks", "source_point_trajectory_manifest", False), ("header.reused", "reused_cache_manifest", True),
            )
        ]
    )
    bound = fields.select(key, F.explode(named).alias("_f")).select(key, "_f.*").filter("not _optional or path is not null")
    joined = bound.join(files.select("path", F.col("sha256").alias("_there")), "path", "left")
    broken = joined.filter(~F.coalesce(F.col("_there") == F.col("_wanted"), F.lit(False))).select(key, "rule_id", F.col("path").alias("detail"))
    known = F.col("representation").isin("das_3d_tracks", "dense_point_tracks")
    own = F.array_compact(
        F.array(
            F.when(~F.coalesce(_text(d, "$.schema").rlike(C.CACHE_SCHEMA_PATTERN), F.lit(False)), F.struct(F.lit("header.schema").alias("rule_id"), _text(d, "$.schema").alias("detail"))),
            F.when(~known, F.struct(F.lit("preprocess.representation").alias("rule_id"), F.col("representation").alias("detail"))),
            F.when((F.col("representation") == "das_3d_tracks") & ~F.col("current"), F.struct(F.lit("preprocess.version").alias("rule_id"), _text(d, "$.schema").alias("detail"))),
        )
    )
    simple = fields.select(key, F.explode(own).alias("_r")).select(key, "_r.*")
    stated = F.coalesce(F.to_json(F.try_variant_get(d, "$.point_track_preprocess", "variant")), F.lit("{}")).alias("stated")
    both = fields.filter(known).select(key, stated, expected_preprocess(fields, doc).alias("expected"))
    differs = json_row_diff(both, key).select(key, F.lit("preprocess.contract").alias("rule_id"), F.col("path").alias("detail"))
    return broken.unionByName(simple).unionByName(differs)


def audit_track_manifests(manifests: DataFrame, key: str = "source", doc: str = "doc") -> DataFrame:
    """Broken rules (key, rule_id, detail) of track manifests.

    ``tracks.schema``, ``tracks.records`` (no list), ``tracks.empty_id``, ``tracks.duplicate`` (one row per
    repeated id) and ``tracks.count`` (a stated count that is wrong; none need be stated).
    """
    d = F.col(doc)
    records = F.try_variant_get(d, "$.records", "array<variant>")
    given = F.try_variant_get(d, "$.records", "variant").isNotNull()
    stated = _number(d, "$.record_count")
    row = lambda rule, detail: F.struct(F.lit(rule).alias("rule_id"), detail.cast("string").alias("detail"))
    own = F.array_compact(
        F.array(
            F.when(~F.coalesce(_text(d, "$.schema").rlike(C.TRACK_MANIFEST_PATTERN), F.lit(False)), row("tracks.schema", _text(d, "$.schema"))),
            F.when(given & records.isNull(), row("tracks.records", F.lit(None))),
            F.when(stated.isNotNull() & (stated != F.coalesce(F.size(records), F.lit(0))), row("tracks.count", stated)),
        )
    )
    simple = manifests.select(key, F.explode(own).alias("_r")).select(key, "_r.*")
    ids = manifests.select(key, F.explode(records).alias("_v")).select(key, F.try_variant_get("_v", "$.sample_id", "string").alias("detail"))
    empty = ids.filter(F.coalesce("detail", F.lit("")) == "").select(key).distinct().select(key, F.lit("tracks.empty_id").alias("rule_id"), F.lit(None).cast("string").alias("detail"))
    twice = ids.filter(F.col("detail") != "").groupBy(key, "detail").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit("tracks.duplicate").alias("rule_id"), "detail")
    return simple.unionByName(empty).unionByName(twice)


def check_text_contexts(stats: DataFrame) -> DataFrame:
    """Verdicts of text tensors from their statistics (shape, dtype, finite): rank 2, fixed width, bounded length, bfloat16."""
    shape = F.col("shape")
    shape_ok = (F.size(shape) == 2) & (F.get(shape, F.lit(1)) == C.TEXT_WIDTH) & (F.get(shape, F.lit(0)) <= C.TEXT_TOKENS)
    return stats.withColumn("shape_ok", F.coalesce(shape_ok, F.lit(False))).withColumn("values_ok", F.coalesce((F.col("dtype") == "bfloat16") & F.col("finite"), F.lit(False)))
