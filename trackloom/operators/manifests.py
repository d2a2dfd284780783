"""Joins between manifests, caches, artifacts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import contracts as C
from trackloom.functions.checks import relative_path
from trackloom.functions.condition import collider_aliases
from trackloom.session import spread


def same(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a.eqNullSafe(b)


def bind_tracks(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per sample that cannot be bound: missing, or with other object ids."""
    left = samples.select("sample_id", F.col("object_ids").alias("_want"))
    right = tracks.select("sample_id", F.col("object_ids").alias("_have"), F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit").isNull(), F.lit("missing")).when(
        ~same("_want", "_have"), F.lit("object_ids_differ")
    )
    return (
        left.join(right, "sample_id", "left")
        .select("sample_id", status.alias("status"))
        .filter("status is not null")
    )


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys nothing carries."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def changed_records(cache: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cached keys whose row differs from the source row; an absent source counts as changed."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*[F.col(c) for c in columns]).alias(name))

    joined = digest(cache, "_c").join(digest(source, "_s"), key, "left")
    return joined.filter(~same("_c", "_s")).select(
        key,
        F.when(F.col("_s").isNull(), F.lit("absent")).otherwise(F.lit("changed")).alias("status"),
    )


def merge_shards(records: DataFrame, source: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every shard record with its verdict and its position in the source.

    ``records`` carries (key, shard, complete); ``status`` is ok, duplicate,
    incomplete or unknown.  Rows come back keyed, so order by ``ordinal`` to write.
    """
    copies = records.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    joined = records.join(copies, key).join(source.select(key, "ordinal"), key, "left")
    status = (
        F.when(F.col("_copies") > 1, F.lit("duplicate"))
        .when(~F.col("complete"), F.lit("incomplete"))
        .when(F.col("ordinal").isNull(), F.lit("unknown"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("status", status).drop("_copies")


def shard_invariants(headers: DataFrame, keys: Sequence[str] = C.SHARD_INVARIANTS, shard: str = "shard") -> DataFrame:
    """(shard, key, expected, actual) where a shard header differs from the first shard's.

    ``headers`` is one row per shard with a ``fields`` MAP<STRING,STRING>.
    """
    long = headers.select(
        shard,
        F.explode(F.array(*[F.lit(k) for k in ("schema", *keys)])).alias("key"),
        "fields",
    ).select(shard, "key", F.element_at("fields", F.col("key")).alias("actual"))
    first = long.groupBy("key").agg(F.min_by("actual", shard).alias("expected"))
    return long.join(first, "key").filter(~same("actual", "expected"))


def nominal_lookup(records: DataFrame, group: str = "base_scene_id", mode: str = "mode") -> tuple[DataFrame, DataFrame]:
    """(targets with ``nominal_id``, groups that do not have exactly one base row)."""
    base = F.col(mode) == "base"
    counted = records.groupBy(group).agg(
        F.count_if(base).alias("base_rows"),
        F.min(F.when(base, F.col("sample_id"))).alias("nominal_id"),
    )
    good = counted.filter("base_rows = 1").select(group, "nominal_id")
    bad = counted.filter("base_rows <> 1").select(group, "base_rows")
    return records.join(good, group), bad


def trajectory_inputs(targets: DataFrame, records: DataFrame, source: str = "target", several: str = "error") -> DataFrame:
    """Sample whose trajectory each target uses: its own, or its scene's base record.

    A scene without a base record gives NULL. One with several fails as soon as a target asks for it, or
    gives the base of least id if ``several`` is ``least``.
    """
    if source not in ("target", "nominal_base") or several not in ("error", "least"):
        raise ValueError(f"unsupported trajectory source: {source}, {several}")
    if source == "target":
        return targets.withColumn("trajectory_id", F.col("sample_id"))
    base = records.filter(F.col("mode") == "base").groupBy("base_scene_id").agg(F.min("sample_id").alias("trajectory_id"), F.count(F.lit(1)).alias("_n"))
    if several == "least":
        return targets.join(base.drop("_n"), "base_scene_id", "left")
    failure = F.raise_error(F.concat(F.lit("several base records of scene "), F.col("base_scene_id").cast("string"))).cast(records.schema["sample_id"].dataType)
    one = F.when(F.col("_n") > 1, failure).otherwise(F.col("trajectory_id"))
    return targets.join(base, "base_scene_id", "left").withColumn("trajectory_id", one).drop("_n")


def restore_order(df: DataFrame, source: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows with the source's ``ordinal``, sorted by it (a range sort over all partitions)."""
    return df.join(source.select(key, "ordinal"), key).orderBy("ordinal")


def build_plan(samples: DataFrame, current: DataFrame, reusable: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """Which artifacts must be built.

    ``samples(sample_id, path)`` names the local target; ``current`` and ``reusable``
    bind (sample_id, path, sha256); ``files`` lists (path, sha256) that exist.
    """
    disk = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    cur = current.select("sample_id", F.col("path").alias("_cp"), F.col("sha256").alias("_ch"))
    reuse = (
        reusable.select("sample_id", F.col("path").alias("_p"), F.col("sha256").alias("_rh"))
        .join(disk, "_p")
        .filter(F.col("_rh") == F.col("_h"))
        .select("sample_id", F.lit(True).alias("_reuse"))
    )
    target = samples.join(disk, samples["path"] == disk["_p"], "left").join(cur, "sample_id", "left")
    exists = F.col("_h").isNotNull()
    flags = target.join(reuse, "sample_id", "left").select(
        "sample_id",
        "path",
        exists.alias("exists"),
        (exists & F.coalesce((F.col("_cp") == F.col("path")) & (F.col("_ch") == F.col("_h")), F.lit(False))).alias("current"),
        F.coalesce("_reuse", F.lit(False)).alias("reusable"),
    )
    return flags.withColumn("build", must_build(F.col("exists"), F.col("current"), F.col("reusable"), F.lit(overwrite)))


def must_build(exists: Column, current: Column, reusable: Column, overwrite: Column) -> Column:
    """An unverified local file is rebuilt; a verified one, or a verified reusable, is kept."""
    return overwrite | (~current & (exists | ~reusable))


def dedupe_by_content(df: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(distinct contents to process once, every row with the id of its content)."""
    keyed = df.withColumn("content_key", content)
    distinct = keyed.groupBy("content_key").agg(
        F.min(key).alias("representative"), F.count(F.lit(1)).alias("uses")
    )
    return distinct, keyed.join(distinct, "content_key")


def collider_catalogue(support: DataFrame, bound: DataFrame) -> DataFrame:
    """Two collider lists merged by (sample, id); the second list wins."""
    ranked = support.withColumn("_p", F.lit(0)).unionByName(bound.withColumn("_p", F.lit(1)))
    return ranked.groupBy("sample_id", "collider_id").agg(F.max_by("solid_wedge", "_p").alias("solid_wedge"))


def represented_parts(scenes: DataFrame, raw: str = "counts_json") -> DataFrame:
    """Part ids with a positive point count in a JSON map."""
    counts = F.from_json(F.col(raw), "map<string,int>")
    return scenes.select("scene", F.explode(counts).alias("part_id", "n")).filter("n > 0").select("scene", "part_id")


def contact_coverage(contacts: DataFrame, colliders: DataFrame, parts: DataFrame) -> DataFrame:
    """Status of every contacted collider against the parts its scene represents.

    ``contacts(sample_id, scene, collider_id)`` is distinct.
    """
    return flagged_coverage(contacts.join(colliders, ["sample_id", "collider_id"], "left"), parts)


def flagged_coverage(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    """``contact_coverage`` of distinct contacts that carry ``solid_wedge`` themselves.

    A contact has at most four aliases. Each is looked up by (scene, part) in a join of its
    own, so no contact is exploded and none has to be gathered again.
    """
    shown = parts.select("scene", "part_id").distinct()
    matched = contacts.withColumn("_a", collider_aliases(F.col("collider_id"), F.coalesce("solid_wedge", F.lit(False))))
    hits = []
    for i in range(4):
        alias = F.get("_a", F.lit(i))
        part = shown.select(F.col("scene").alias(f"_s{i}"), F.col("part_id").alias(f"_p{i}"))
        matched = matched.join(part, (F.col("scene") == F.col(f"_s{i}")) & (alias["alias"] == F.col(f"_p{i}")), "left")
        hits.append(F.when(F.col(f"_p{i}").isNotNull(), alias))
    best = F.array_min(F.array_compact(F.array(*hits)))
    status = (
        F.when(F.col("_p0").isNotNull(), F.lit("direct"))  # the first alias is the collider itself
        .when(best.isNotNull(), F.lit("visual_alias"))
        .otherwise(F.lit("not_represented_at_t0"))
    )
    return matched.select(
        "sample_id",
        "scene",
        "collider_id",
        status.alias("status"),
        F.when(status == "visual_alias", best["reason"]).alias("reason"),
    )


def coverage_report(
    coverage: DataFrame, samples: DataFrame | None = None, scenes: DataFrame | None = None, tasks: int = 1
) -> DataFrame:
    """Long roll-up (section, name, n): statuses, alias reasons, missing colliders, affected scenes and samples, totals.

    Every affected scene and sample is listed with the number of its missing contacts; the first samples in file
    order are the examples. ``samples(sample_id)`` and ``scenes(scene)`` bring those without a contact into the
    totals. Coverage is complete if no sample is affected. Order by (section, n desc, name) to list it.
    Samples are counted in at least ``tasks`` tasks.
    """
    missing = F.col("status") == "not_represented_at_t0"
    # Dealt once, with the samples that have no contact: no element of an array is pruned and no filter stands above
    # it, so all sections read the same shuffle and no contact is matched twice.
    found = F.array("status", F.when(missing, F.col("collider_id")).otherwise(F.col("reason")), F.col("scene").cast("string"))
    rows = coverage.select("sample_id", found.alias("_f"))
    if samples is not None:
        rows = rows.unionByName(samples.select("sample_id", F.array(*[F.lit(None).cast("string")] * 3).alias("_f")))
    dealt = spread(rows, "sample_id", least=tasks)
    status, name, scene = (F.get("_f", F.lit(i)) for i in range(3))
    missing = F.coalesce(status == "not_represented_at_t0", F.lit(False)).cast("int").alias("_bad")

    def entry(section: str, name: str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.col(name).alias("name"))

    entries = F.array_compact(
        F.array(
            F.when(F.col("_status").isNotNull(), entry("status", "_status")),
            F.when(F.col("_status") == "visual_alias", entry("alias", "_name")),
            F.when(F.col("_status") == "not_represented_at_t0", entry("missing", "_name")),
        )
    )
    kinds = dealt.groupBy(status.alias("_status"), name.alias("_name")).agg(F.count(F.lit(1)).alias("n"))
    out = kinds.select(F.explode(entries).alias("_e"), "n").groupBy("_e.section", "_e.name").agg(F.sum("n").alias("n"))
    of_scene = dealt.select(scene.alias("scene"), missing, status.isNotNull().alias("_known"))
    if scenes is not None:
        of_scene = of_scene.unionByName(scenes.select(F.col("scene").cast("string").alias("scene"), F.lit(0).alias("_bad"), F.lit(True).alias("_known")))
    of_sample = dealt.select("sample_id", missing, F.lit(True).alias("_known"))
    for key, section, marked in (("scene", "scene", of_scene), ("sample_id", "sample", of_sample)):
        sums = marked.groupBy(key).agg(F.sum("_bad").alias("n"), F.bool_or("_known").alias("_known")).filter("_known")
        listed = sums.filter("n > 0").select(F.lit(f"affected_{section}").alias("section"), F.col(key).cast("string").alias("name"), "n")
        sizes = sums.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("n") > 0).alias("_hit"))
        totals = F.array(*[
            F.struct(F.lit("total").alias("section"), F.lit(f"{kind}{section}s").alias("name"), F.col(n).alias("n"))
            for kind, n in (("", "_all"), ("affected_", "_hit"))
        ])
        out = out.unionByName(listed).unionByName(sizes.select(F.inline(totals)))
    return out


def affected_examples(coverage: DataFrame, samples: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` samples in file order with a contacted but unrepresented collider."""
    bad = coverage.filter(F.col("status") == "not_represented_at_t0")
    return (
        samples.join(bad.select("sample_id"), "sample_id", "left_semi")
        .orderBy("ordinal")
        .limit(n)
    )


def scene_jobs(base: DataFrame, masks: DataFrame, wanted: DataFrame) -> DataFrame:
    """A job per wanted scene; ``problem`` names what is missing."""
    joined = wanted.join(base.select("base_scene_id", "sample_id", "first_frame"), "base_scene_id", "left").join(
        masks.select("sample_id", F.col("path").alias("mask")), "sample_id", "left"
    )
    problem = F.when(F.col("sample_id").isNull(), F.lit("unknown base scene")).when(
        F.col("mask").isNull(), F.lit("mask is missing")
    )
    return joined.withColumn("problem", problem)


def attach_strict(reports: DataFrame, cache: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(joined reports, reports whose key the cache does not know)."""
    return reports.join(cache, key), reports.join(cache.select(key), key, "left_anti")


def attach_source(tracks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Video path of each track; empty when the manifest lacks the sample."""
    return tracks.join(manifest.select("sample_id", "video"), "sample_id", "left").withColumn(
        "video", F.coalesce("video", F.lit(""))
    )


def artifact_status(expected: DataFrame, files: DataFrame) -> DataFrame:
    """First problem of every expected artifact: incomplete, escapes, missing, size, sha256 or ok."""
    found = files.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    status = (
        F.when(F.col("path").isNull() | F.col("sha256").isNull(), F.lit("incomplete"))
        .when(~relative_path(F.col("path")), F.lit("escapes"))
        .when(F.col("_sha").isNull(), F.lit("missing"))
        .when(F.col("bytes").isNotNull() & (F.col("bytes") != F.col("_bytes")), F.lit("size"))
        .when(F.col("sha256") != F.col("_sha"), F.lit("sha256"))
        .otherwise(F.lit("ok"))
    )
    return expected.join(found, "path", "left").withColumn("status", status).drop("_bytes", "_sha")


def contract_status(
    headers: DataFrame,
    files: DataFrame,
    summaries: DataFrame,
    path_base: str,
    schema_pattern: str = C.CACHE_SCHEMA_PATTERN,
) -> DataFrame:
    """First broken rule of each cache header against its three bound documents.

    ``headers`` has one row per cache; ``summaries(path, path_base, manifest,
    manifest_sha256)`` are the parsed dataset summaries.

    Both lists of files grow with the headers, so the joins are merged: from the size of a
    well compressed table Spark would guess that they fit a broadcast.
    """
    def on_disk(name: str) -> DataFrame:
        return files.select(F.col("path").alias(name), F.col("sha256").alias(f"_{name}_sha")).hint("merge")

    joined = headers
    slots = ("source_manifest", "source_dataset_summary", "source_point_trajectory_manifest")
    for slot in slots:
        joined = joined.join(on_disk(slot), slot, "left")
    body = summaries.select(
        F.col("path").alias("source_dataset_summary"),
        F.col("path_base").alias("_base"),
        F.col("manifest").alias("_m"),
        F.col("manifest_sha256").alias("_mh"),
    ).hint("merge")
    joined = joined.join(body, "source_dataset_summary", "left")
    reason = F.when(
        ~F.coalesce(F.col("schema").rlike(schema_pattern), F.lit(False)), F.lit("unsupported schema")
    ).when(F.col("dataset_root").isNull(), F.lit("missing dataset root"))

    def document(reason: Column, slot: str) -> Column:
        return (
            reason.when(F.col(slot).isNull() | F.col(f"{slot}_sha256").isNull(), F.lit(f"{slot} contract is missing"))
            .when(~relative_path(F.col(slot)), F.lit(f"{slot} must be relative"))
            .when(F.col(f"_{slot}_sha").isNull(), F.lit(f"{slot} file is missing"))
            .when(F.col(f"_{slot}_sha") != F.col(f"{slot}_sha256"), F.lit(f"{slot} changed"))
        )

    reason = document(document(reason, slots[0]), slots[1])
    reason = (
        reason.when(~same("_base", F.lit(path_base)), F.lit("summary has an unsupported path base"))
        .when(~same("_m", "source_manifest"), F.lit("summary references a different manifest"))
        .when(~same("_mh", "source_manifest_sha256"), F.lit("summary manifest hash mismatch"))
    )
    reason = document(reason, slots[2])
    return joined.withColumn("status", F.coalesce(reason, F.lit("ok"))).select(*headers.columns, "status")


def diff_contract(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str], present_only: bool = False) -> DataFrame:
    """(key, field, previous, current) for fields that differ between two versions.

    ``present_only`` skips fields the previous version does not state.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(key, F.explode(pairs).alias("_e")).select(key, "_e.field", f"_e.{name}")

    joined = long(previous, "previous").join(long(current, "current"), [key, "field"], "full")
    out = joined.filter(~same("previous", "current"))
    return out.filter("previous is not null") if present_only else out


def binding_check(cached: DataFrame, tracks: DataFrame) -> DataFrame:
    """Samples whose cached track path or hash is not the manifest's."""
    right = tracks.select("sample_id", F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    return (
        cached.join(right, "sample_id")
        .select(
            "sample_id",
            (~same("source_point_trajectory", "_p")).alias("path_differs"),
            (~same("source_point_trajectory_sha256", "_h")).alias("hash_differs"),
        )
        .filter("path_differs or hash_differs")
    )


def check_tensor_shapes(stats: DataFrame, expected: Column, dtype: str) -> DataFrame:
    """Shape, type and finiteness verdict of one tensor statistics row each."""
    return stats.withColumn("shape_ok", same("shape", expected)).withColumn(
        "values_ok", same("dtype", F.lit(dtype)) & F.col("finite")
    )


def cache_counts(records: DataFrame) -> DataFrame:
    """One row: samples, scenes, latents, distinct texts and distinct track shapes."""
    return records.agg(
        F.count_distinct("sample_id").alias("sample_count"),
        F.count_distinct("base_scene_id").alias("base_scene_count"),
        F.count_distinct("latent_path").alias("latent_count"),
        F.count_distinct("text_path").alias("unique_text_context_count"),
        F.count_distinct("track_shape").alias("track_shape_count"),
    )


def error_report(violations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pass flag and counts per rule; the listing itself stays a table."""
    return violations.groupBy(*keys, "rule_id").agg(
        F.count(F.lit(1)).alias("errors"), F.min("message").alias("example")
    )


def audit_cache(
    records: DataFrame,
    source: DataFrame,
    tracks: DataFrame,
    files: DataFrame,
    record_violations: DataFrame | None = None,
    tensor_stats: DataFrame | None = None,
    cell_violations: DataFrame | None = None,
    text_stats: DataFrame | None = None,
) -> DataFrame:
    """All per-sample error conditions of a cache as (sample_id, rule_id, message).

    ``records`` is flattened: sample_id, base_scene_id, record_json, object_ids,
    latent_path/sha256, text_path/sha256, track_path/sha256/shape, track_object_ids,
    track_object_count, source_point_trajectory(_sha256), first_frame(_sha256),
    scene(_sha256), video(_sha256). Headers and track manifests are audited by
    ``headers.audit_headers`` and ``headers.audit_track_manifests``.
    """
    def rows(df: DataFrame, rule: str, message: Column | str) -> DataFrame:
        text = F.lit(message) if isinstance(message, str) else message
        return df.select("sample_id", F.lit(rule).alias("rule_id"), text.alias("message"))

    parts = [
        rows(duplicates_of(records, "sample_id"), "duplicate", "record.repeated"),
        rows(
            changed_records(
                records.select("sample_id", _parsed("record_json")),
                source.select("sample_id", _parsed("record_json")),
                "sample_id",
                ["record_json"],
            ),
            "changed",
            "record.changed",
        ),
        rows(
            records.join(duplicates_of(records, "latent_path"), "latent_path", "left_semi"),
            "latent_reused",
            F.concat(F.lit("latent.shared: "), F.col("latent_path")),
        ),
    ]
    bound = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(p).alias("path"), F.col(h).alias("sha256"), F.lit(None).cast("long").alias("bytes"))
            for label, p, h in (
                ("first_frame", "first_frame", "first_frame_sha256"),
                ("scene", "scene", "scene_sha256"),
                ("latent", "latent_path", "latent_sha256"),
                ("text", "text_path", "text_sha256"),
                ("track", "track_path", "track_sha256"),
                ("trajectory", "source_point_trajectory", "source_point_trajectory_sha256"),
                ("video", "video", "video_sha256"),
            )
        ]
    )
    artifacts = records.select("sample_id", F.explode(bound).alias("_a")).select("sample_id", "_a.*")
    parts.append(
        rows(
            artifact_status(artifacts, files).filter("status <> 'ok'"),
            "artifact",
            F.concat(F.lit("artifact: "), F.col("label")),
        )
    )
    right = tracks.select(
        "sample_id",
        F.lit(True).alias("_hit"),
        F.col("path").alias("_p"),
        F.col("sha256").alias("_h"),
        F.col("object_ids").alias("_ids"),
        F.col("object_count").alias("_n"),
    )
    j = records.join(right, "sample_id", "left")
    conditions = F.array_compact(
        F.array(
            F.when(F.col("_hit").isNull() | F.col("track_path").isNull(), F.lit("track.absent")),
            F.when(~same("track_object_ids", "object_ids"), F.lit("track.objects")),
            F.when(~same("track_object_count", F.size("object_ids")), F.lit("track.count")),
            F.when(F.col("_hit") & ~same("_ids", "object_ids"), F.lit("trajectory.objects")),
            F.when(F.col("_hit") & ~same("_n", F.size("object_ids")), F.lit("trajectory.count")),
            F.when(F.col("_hit") & ~same("source_point_trajectory", "_p"), F.lit("trajectory.path")),
            F.when(F.col("_hit") & ~same("source_point_trajectory_sha256", "_h"), F.lit("trajectory.sha256")),
        )
    )
    parts.append(
        j.select("sample_id", F.explode(conditions).alias("message")).select(
            "sample_id", F.lit("binding").alias("rule_id"), "message"
        )
    )
    if record_violations is not None:
        parts.append(rows(record_violations, "record", F.col("message")))
    if tensor_stats is not None:
        bad = tensor_stats.filter(~F.col("shape_ok") | ~F.col("values_ok"))
        parts.append(rows(bad, "tensor", F.when(~F.col("shape_ok"), F.lit("tensor.shape")).otherwise(F.lit("tensor.values"))))
    if text_stats is not None:
        bad = text_stats.filter(~F.col("shape_ok") | ~F.col("values_ok"))
        parts.append(rows(bad, "text", F.when(~F.col("shape_ok"), F.lit("text.shape")).otherwise(F.lit("text.values"))))
    if cell_violations is not None:
        parts.append(rows(cell_violations, "cells", F.col("message")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _parsed(column: str) -> Column:
    """A JSON text in one spelling: parsed, keys in order, no spaces; what does not parse stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.col(column)).alias(column)


def duplicates_of(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def batch_report(results: DataFrame) -> DataFrame:
    """Counts of scenes that ran and scenes that passed (or reused a pass)."""
    return results.agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.count_if(F.col("status") != "failed").alias("process_pass_count"),
        F.count_if(F.col("status").isin("passed", "reused")).alias("quality_pass_count"),
    )
