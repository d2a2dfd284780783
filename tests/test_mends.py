"""Cases that once were lost, capped or crashed."""

import json
import math
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from trackloom.functions import quantiles
from trackloom.operators import audit, clouds, documents, headers, manifests, raster, selection
from trackloom.plans import contract_queries, manifest_queries
from trackloom.session import cut_lineage
from trackloom.sources import archives
from trackloom.streaming import live


def test_forbidden_keys_in_long_nested_and_escaped_documents(spark, rows):
    deep = '{"a":' * 60 + '{"seed": 1}' + "}" * 60
    raw = spark.createDataFrame(
        [(1, json.dumps({"text": "x" * 200_000, "list": [{"seed": "deep"}]})), (2, '{"s\\u0065ed": 1}'), (3, deep), (4, '{"x": "seed"}'), (5, "{broken"), (6, None), (7, "[]")],
        "doc_id int, raw string",
    )
    assert sorted(map(str, rows(documents.forbidden_keys(raw, ["seed", "deep"])))) == ["(1, 'seed')", "(2, 'seed')", "(3, 'seed')", "(5, None)"]


def test_nearest_keeps_queries_without_a_place_and_empty_clouds(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, math.nan, 0.0, 0.0), (3, None, 0.0, 0.0)], "q long, x double, y double, z double")
    c = spark.createDataFrame([(7, 1.0, 0.0, 0.0)], "c long, x double, y double, z double")
    got = {r.q: (r.c, r.distance) for r in clouds.nearest(q, c, "q", "c").collect()}
    assert got == {1: (7, 1.0), 2: (None, None), 3: (None, None)}
    assert {r.q: r.c for r in clouds.nearest(q, c.limit(0), "q", "c").collect()} == {1: None, 2: None, 3: None}


def test_every_improvement_inside_a_batch_is_written(spark, tmp_path, rows):
    write = live.best_so_far_writer(str(tmp_path / "best"))
    for batch, data in enumerate([[(1, "a", 5.0), (2, "a", 4.0), (3, "a", 4.5), (4, "a", 3.0)], [(5, "a", 3.5), (6, "a", 2.0)]]):
        write(spark.createDataFrame(data, "step long, mode string, total double"), batch)
    assert rows(spark.read.parquet(str(tmp_path / "best")), "total", "step", "batch") == [(2.0, 6, 1), (3.0, 4, 0), (4.0, 2, 0), (5.0, 1, 0)]


def test_cells_of_a_sample_without_object_count(spark, rows):
    cells = spark.createDataFrame([("s", 0, 0, 0, 0, 0.5, 0.5, 0.5, 1.0)], "sample_id string, slot int, frame int, cy int, cx int, r float, g float, b float, visible float")
    counts = spark.createDataFrame([], "sample_id string, object_count int")
    assert rows(raster.validate_track_cells(cells, counts), "sample_id", "rule_id") == [("s", "C00")]


def test_audit_without_all_metrics_does_not_pass(spark):
    samples = spark.createDataFrame([("s",)], "sample_id string")
    part = spark.createDataFrame([("s", 0.0)], "sample_id string, time_error double")
    r = audit.roundtrip_audit(samples, [part]).first()
    assert not r.passed and r.failures == [] and len(r.skipped) == len(audit.CHECKS) - 1


def test_quantiles_of_small_groups_take_the_bracket_path(spark):
    data = [(k, float(v)) for k, values in {"a": [3], "b": [1, 2], "c": [5, 1, 4], "d": [2, 2, 9, 1], "e": range(37)}.items() for v in values]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", probs, [f"p{i}" for i in range(6)]).toPandas().set_index("k")
    want = pd.DataFrame(data, columns=["k", "v"]).groupby("k").v.quantile(probs).unstack()
    for k in want.index:
        assert [round(x, 9) for x in got.loc[k]] == [round(x, 9) for x in want.loc[k]]


def test_rank_limits_agree_at_any_n(spark, rows):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("ordinal"))
    got = selection.round_robin(df, "g", "ordinal", 4000, 3)
    assert rows(got.select("position", "ordinal")) == [(i, i) for i in range(4000)]


def test_unreadable_archive_is_reported(spark, tmp_path, rows):
    (tmp_path / "01_bad").mkdir()
    (tmp_path / "01_bad" / "scene.npz").write_bytes(b"no archive")
    assert rows(archives.read_scene_headers(spark, str(tmp_path)).select("scene", F.array_join("problems", ","))) == [("01_bad", "unreadable")]


def test_records_of_a_file_with_one_row_group_are_checked_by_many_tasks(spark):
    lines = contract_queries.record_lines(spark, "/root/testdata/sf0.1")
    sizes = [r["n"] for r in lines.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 8 and sum(sizes) == 20_000 and max(sizes) < 2_000


def test_planes_are_the_same_however_a_scene_is_dealt(spark, monkeypatch):
    i = F.col("id")
    points = spark.range(2400).select((i % 2).alias("scene"), "id", (i * 7919 % 997 / 100).alias("x"), (i * 104729 % 991 / 100).alias("y"), F.when(i % 3 == 0, i % 89 / 10).otherwise(1.5).alias("z"))
    whole = sorted(map(tuple, clouds.fit_planes(points, "scene", "id", planes=2, trials=50).collect()))
    monkeypatch.setattr(clouds, "SCORED", 100)
    monkeypatch.setattr(clouds, "SHARD", 2)
    dealt = sorted(map(tuple, clouds.fit_planes(points, "scene", "id", planes=2, trials=50).collect()))
    assert [r[:2] + (r[6],) for r in dealt] == [r[:2] + (r[6],) for r in whole] and [r[6] for r in whole if r[1] == 0] == [804, 805]


def test_features_read_the_records_once(spark, capsys):
    contract_queries.record_features(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_quantiles_of_large_and_small_keys_together(spark, monkeypatch, capsys):
    monkeypatch.setattr(quantiles, "LARGE", 50)
    data = [("a" if i % 4 else "b" if i % 40 else "c", float(i * 7919 % 1009)) for i in range(400)] + [("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    frame = pd.DataFrame(data, columns=["k", "v"]).dropna()
    got = {r.k: r.m for r in quantiles.percentiles(df, ["k"], "v", [0.3], ["m"]).collect()}
    want = frame.groupby("k").v.quantile(0.3)
    assert set(got) == set(want.index) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    scale = {r.k: r for r in quantiles.robust_scale(df, ["k"], "v").collect()}
    kept = {r.k: r.kept for r in quantiles.trimmed_median(df, ["k"], "v").collect()}
    for k, part in frame.groupby("k"):
        mid = part.v.median()
        assert scale[k].median == mid and abs(scale[k].scale - 1.4826 * (part.v - mid).abs().median()) < 1e-9
        good = part.v[part.v > 0]
        assert kept[k] == good.between(good.quantile(0.15), good.quantile(0.85)).sum()
    monkeypatch.setattr(quantiles, "LARGE", 5)
    quantiles.percentiles(df, ["k"], "v", [0.3], ["m"]).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_documents_of_one_row_are_compared_in_place(spark, rows):
    data = [(1, '{"a": [1, {}], "b": 2}', '{"b": 2, "a": [1.0, {}], "c": null}'), (2, None, '{"a": 1}'), (3, "[1", "[1]"), (4, "{}", "{}"), (5, None, None), (6, '{"a.b": 1, "a": {"b": 2}}', '{"a": {"b": 1}}'), (7, "[1", '"x"')]
    docs = spark.createDataFrame(data, "id int, stated string, expected string")
    got = headers.json_row_diff(docs, "id")
    want = headers.json_diff(docs.select("id", F.col("stated").alias("raw")), docs.select("id", F.col("expected").alias("raw")), "id")
    order = ["id", "path", "stated", "expected"]
    assert sorted(map(str, rows(got.select(*order).fillna("-")))) == sorted(map(str, rows(want.select(*order).fillna("-"))))


def test_contract_files_are_not_broadcast_for_being_well_compressed(spark, tmp_path, capsys):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("path"), F.lit("root").alias("path_base"), F.lit("h").alias("sha256"))
    rows.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    slots = ("source_manifest", "source_dataset_summary", "source_point_trajectory_manifest")
    headers = files.select(F.lit("x.wan_ti2v_cache.v4").alias("schema"), F.lit("/d").alias("dataset_root"), *[c for s in slots for c in (F.col("path").alias(s), F.col("sha256").alias(f"{s}_sha256"))])
    summaries = files.select("path", "path_base", F.col("path").alias("manifest"), F.col("sha256").alias("manifest_sha256"))
    status = manifests.contract_status(headers, files, summaries, "root")
    status.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 4 and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in status.groupBy("status").count().collect()] == [("ok", 20_000)]


def test_contacts_are_derived_once_and_not_regrouped(spark, rows, capsys):
    manifest_queries.contact_coverage(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out.splitlines()
    scans = [line for line in plan if "FileScan" in line and "l_orderkey" in line]
    joins = [line for line in plan if "Join" in line and "l_partkey" in line]
    assert len(scans) == 1 and len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert not any("Generate" in line and "sample_id" in line for line in plan)
    ids = ["floor", "ramp", "support", "environment_mesh_7", "solid_ramp_wedge", None]
    contacts = spark.createDataFrame([(s, c, i, w) for s, c in ((1, "a"), (2, "b"), (3, None)) for i in ids for w in (True, False, None)], "sample_id int, scene string, collider_id string, solid_wedge boolean")
    parts = spark.createDataFrame([("a", p) for p in ("floor", "floor", "scene_mesh_7", "solid_ramp_wedge", None)] + [("b", "support_visual_mesh"), (None, "floor")], "scene string, part_id string")
    got = rows(manifests.flagged_coverage(contacts.filter("solid_wedge"), parts).fillna("-"), "sample_id", "collider_id", "status", "reason")
    wedge, none = ("visual_alias", "solid_wedge_visual_replacement"), ("not_represented_at_t0", "-")
    direct, mesh = ("direct", "-"), ("visual_alias", "reviewed_environment_mesh_replacement")
    first = {"-": wedge, "environment_mesh_7": mesh, "floor": direct, "ramp": wedge, "solid_ramp_wedge": direct, "support": wedge}
    assert got == sorted((s, i, *(first[i] if s == 1 else ("visual_alias", "reviewed_support_mesh_replacement") if (s, i) == (2, "support") else none)) for s in (1, 2, 3) for i in first)
    plain = manifests.flagged_coverage(contacts.filter("solid_wedge is null and sample_id = 1"), parts)
    assert rows(plain.fillna("-"), "collider_id", "status") == [("-", none[0]), ("environment_mesh_7", mesh[0]), ("floor", "direct"), ("ramp", none[0]), ("solid_ramp_wedge", "direct"), ("support", none[0])]


def test_tasks_of_the_coverage_report_follow_the_rows(spark, monkeypatch, capsys):
    monkeypatch.setattr(manifest_queries, "CONTACTS", 100)
    report = manifest_queries.coverage_report(spark, "/root/testdata/sf0.001")
    report.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and ", 60), REPARTITION_BY_NUM" in plan
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").join(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), F.expr("l_partkey = p_partkey"))
    contacts = rows.selectExpr("l_orderkey", "p_brand", "CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN concat('environment_mesh_', p_type) ELSE p_type END").distinct().count()
    assert sum(r.n for r in report.filter("section = 'status'").collect()) == contacts


def test_contacts_meet_their_parts_in_tasks_that_follow_the_rows(spark, monkeypatch, tmp_path, capsys):
    monkeypatch.setattr(manifest_queries, "CONTACTS", 100)
    manifest_queries.contact_coverage(spark, "/root/testdata/sf0.001").explain()
    shuffles = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(l_partkey" in line or "Exchange hashpartitioning(p_partkey" in line]
    assert len(shuffles) == 2 and all(", 60), REPARTITION_BY_NUM" in line for line in shuffles)
    # one part with all contacts, an order without a key, an unknown part and none
    items = [(i, 1, "ARN"[i % 3]) for i in range(30)] + [(None, 1, "N"), (5, 9, "N"), (6, None, "N")]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "Brand#1", "TIN", 1)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = manifest_queries.contact_coverage(spark, str(tmp_path)).select("sample_id", "collider_id", "status").collect()
    name = {"A": "support", "R": "environment_mesh_TIN", "N": "TIN"}
    want = [(o, name[f], "visual_alias" if f == "A" else "not_represented_at_t0") for o, p, f in items if p == 1]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_cut_leaves_no_shuffle_files_behind(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p for d in disk.localDirsString() for p in Path(d).rglob("shuffle_*")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(key, None)
    grouped = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")).join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k")
    cut = cut_lineage(grouped)
    end = time.time() + 20  # files are removed in the background
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(key, None) == conf
    assert sorted(tuple(r) for r in cut.collect()) == sorted(tuple(r) for r in grouped.collect()) == [(k, sum(range(k, 1_000, 7))) for k in range(7)]
