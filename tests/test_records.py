import json

import pytest
from pyspark.sql import functions as F

from tests.samples import AXES, edited, record, sweep_group
from trackloom.functions import condition
from trackloom.operators import documents, records, selection, sweep
from trackloom.sources.manifest import read_manifest

PH = "conditioning.physics"
OB = f"{PH}.object"
CASES = [
    ("R01", "schema", "acme.video_condition_sample.v3"),
    ("R02", "sample_id", ""),
    ("R03", "base_scene_id", 7),
    ("R04", "split", "dev"),
    ("R05", "conditioning.extra", 1),
    ("R06", "conditioning.scene_source", "guess"),
    ("R07", "conditioning.text", "   "),
    ("R08", "conditioning.first_frame", "/abs.png"),
    ("R09", "conditioning.scene", "a/../b.npz"),
    ("R10", "target.video", ""),
    ("R11", "target.metadata", ...),
    ("R13", f"{PH}.more", {}),
    ("R14", f"{PH}.source", "robot"),
    ("R15", f"{PH}.coordinate_frame", "world"),
    ("R16", f"{OB}.colour", "red"),
    ("R17", f"{OB}.object_id", ""),
    ("R18", f"{OB}.mass_kg", 0),
    ("R18", f"{OB}.mass_kg", True),
    ("R19", f"{OB}.inertia_tensor_camera_kg_m2", [[1, 0.5, 0], [0.4, 1, 0], [0, 0, 1]]),
    ("R19", f"{OB}.inertia_tensor_camera_kg_m2", [[1, 2, 0], [2, 1, 0], [0, 0, 1]]),
    ("R19", f"{OB}.inertia_tensor_camera_kg_m2", [[1, 0, 0], [0, 1, 0]]),
    ("R20", f"{OB}.friction", -0.1),
    ("R21", f"{OB}.restitution", 1.2),
    ("R22", f"{OB}.rolling_friction", "0"),
    ("R23", f"{OB}.spinning_friction", -1),
    ("R24", f"{OB}.linear_damping", None),
    ("R25", f"{OB}.angular_damping", -2),
    ("R26", f"{OB}.initial_state", {}),
    ("R27", f"{OB}.initial_state.linear_velocity_camera_m_s", [1, 2]),
    ("R28", f"{OB}.initial_state.angular_velocity_camera_rad_s", [1, 2, True]),
    ("R29", f"{PH}.world", {"gravity": [0, 0, 0]}),
    ("R30", f"{PH}.world.gravity_camera_m_s2", [0, 0, "x"]),
    ("R31", "sweep.mode", "grid"),
    ("R32", "sweep.axis", "mass_kg"),
    ("R34", "sweep.level_count", 4),
    ("R35", "sweep.level_index", 5),
    ("R36", "sweep.base_level_index", -1),
    ("R37", "sweep.base_level_indices", {"mass_kg": 2}),
    ("R38", "sweep.base_level_indices.mass_kg", 9),
    ("R39", "sweep.source_axis", "size"),
    ("R40", "sweep.base_level_indices.mass_kg", 3),
    ("R41", "sweep.level_index", 1),
]


def manifest(spark, tmp_path, lines):
    path = tmp_path / "manifest.jsonl"
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")
    return read_manifest(spark, str(path))


def test_each_rule_fires_first(spark, tmp_path, rows):
    lines = [record(), ""] + [edited(path, value) for _, path, value in CASES]
    lines.append(record(mode="one_factor", axis="mass_kg", level=2))  # R42
    lines.append(edited("sweep.axis", "size", record(mode="one_factor", axis="mass_kg", level=1)))  # R33
    lines.append("{not json")
    found = rows(records.validate_records(manifest(spark, tmp_path, lines), "first"), "ordinal", "rule_id")
    want = [(i + 2, rule) for i, (rule, _, _) in enumerate(CASES)]
    tail = len(CASES) + 2
    assert found == want + [(tail, "R42"), (tail + 1, "R33"), (tail + 2, "R00")]


def test_valid_sweep_group_has_no_violation(spark, tmp_path):
    assert records.validate_records(manifest(spark, tmp_path, sweep_group())).count() == 0


def test_multi_object_records(spark, tmp_path, rows):
    one = record()["conditioning"]["physics"]["object"]
    two = dict(one, object_id="ball")
    several = edited(f"{PH}.objects", {"b": one, "a": two}, edited(f"{OB}", ...))
    twice = edited(f"{PH}.objects", [one, one], edited(f"{OB}", ...))
    m = manifest(spark, tmp_path, [several, twice])
    strict = rows(records.validate_records(m), "ordinal", "rule_id")
    assert strict == [(0, "R13"), (1, "R13")]
    assert records.validate_records(m, max_objects=3).count() == 0
    ids = records.object_ids_status(records.typed_samples(m)).collect()
    assert [(r.object_ids, r.valid) for r in ids] == [(["ball", "box"], True), (["box", "box"], False)]


def test_summary_duplicates_and_leakage(spark, tmp_path, rows):
    lines = sweep_group("a") + sweep_group("b")
    lines += [record("a-base", "a"), record("c", "b", split="test")]
    samples = records.typed_samples(manifest(spark, tmp_path, lines))
    summary = records.manifest_summary(samples).first().asDict()
    assert summary["sample_count"] == 28 and summary["base_scene_count"] == 2
    assert summary["split_test"] == 1 and summary["split_validation"] == 0
    assert summary["mode_base"] == 4 and summary["mode_mass_kg"] == 8
    assert rows(records.duplicates(samples, "sample_id"), "sample_id", "copies") == [("a-base", 2)]
    assert rows(records.split_leakage(samples), "base_scene_id") == [("b",)]


def test_missing_files(spark, tmp_path, rows):
    m = manifest(spark, tmp_path, [record("x")])
    files = spark.createDataFrame([("frames/x.png",), ("videos/x.mp4",), ("meta/x.json",)], "path string")
    assert rows(records.missing_files(m, files), "message") == [("does not exist: scenes/scene0.npz",)]


def test_conditions(spark, tmp_path):
    samples = records.typed_samples(manifest(spark, tmp_path, [record()]))
    o = F.col("objects")[0]
    row = samples.select(
        condition.controls(o).alias("c"),
        condition.dynamics(o).alias("d"),
        condition.initial_state(o, F.col("gravity")).alias("s"),
        condition.control_value(o, F.lit("contact_friction")).alias("v"),
    ).first()
    assert row.c == [1.5, 0.4, 0.5] and row.v == 0.4
    assert row.d[:6] == [0.1, 0.2, 0.3, 0.0, 0.0, 0.0] and row.d[9] == 0.02
    assert row.s == [1, 0, 0, 0, 0, 2.5, 0, -9.81, 0]


def test_sweep_levels_and_pairs(spark, tmp_path, rows):
    samples = records.typed_samples(manifest(spark, tmp_path, sweep_group("a")))
    levels = sweep.sweep_levels(samples)
    keys = ["base_scene_id", "axis"]
    assert rows(sweep.level_status(levels, keys, "level"), "axis", "complete") == sorted((a, True) for a in AXES)
    pairs = rows(sweep.sweep_pairs(levels, keys, "level", ["sample_id"]).filter("axis = 'mass_kg'"), "low_level", "high_level", "kind")
    assert pairs == [(0, 1, "adjacent"), (0, 4, "endpoint"), (1, 2, "adjacent"), (2, 3, "adjacent"), (3, 4, "adjacent")]
    ends = rows(sweep.sweep_pairs(levels, keys, "level", ["sample_id"], True), "axis", "low_sample_id", "high_sample_id")
    assert ends == sorted((a, f"a-{a}-0", f"a-{a}-4") for a in AXES)
    broken = levels.filter("not (axis = 'mass_kg' and level = 1)").unionByName(levels.filter("axis = 'contact_friction' and level = 3"))
    status = dict(rows(sweep.level_status(broken, keys, "level"), "axis", "complete"))
    assert status == {"mass_kg": False, "contact_friction": False, "contact_restitution": True}
    assert sweep.complete_levels(broken, keys, "level").count() == 5


def test_sweep_response(spark):
    poses = spark.createDataFrame(
        [(s, t, float(t * v), 0.0, 0.0) for s, v in (("low", 1.0), ("high", 3.0)) for t in range(4)],
        "sample_id string, frame int, px double, py double, pz double",
    )
    pairs = spark.createDataFrame([("a", "mass_kg", "low", "high")], "base_scene_id string, axis string, low_sample_id string, high_sample_id string")
    extents = spark.createDataFrame([("low", 1.5), ("high", 2.0)], "sample_id string, extent double")
    r = sweep.sweep_response(pairs, poses, extents).first()
    assert (r.initial_separation, r.final_separation, r.mean_separation, r.max_separation) == (0.0, 6.0, 3.0, 6.0)
    assert (r.max_extents, r.path_delta, r.active, r.initial_invariant, r.same_frames) == (3.0, 6.0, True, True, True)


def test_training_schedule(spark, rows):
    plan = sweep.training_schedule(spark, 25, 1, 1)
    assert rows(plan.groupBy("mode").count()) == [("ordinary", 15), ("response", 10)]
    assert rows(plan.filter("axis is not null").groupBy("axis").count()) == [("contact_friction", 4), ("contact_restitution", 4), ("mass_kg", 2)]


def test_round_robin(spark):
    df = spark.createDataFrame([(f"{s}-{i}", s, j * 3 + i) for j, s in enumerate("abc") for i in range(3)], "sample_id string, base_scene_id string, ordinal int")
    got = [r.sample_id for r in selection.round_robin(df, "base_scene_id", "ordinal", 7, 3).orderBy("position").collect()]
    assert got == ["a-0", "b-0", "c-0", "a-1", "b-1", "c-1", "a-2"]


def test_cyclic_draw_covers_every_item_once_per_cycle(spark):
    items = spark.createDataFrame([(i,) for i in range(7)], "item int")
    draws = spark.range(21).withColumnRenamed("id", "n")
    drawn = selection.cyclic_draw(items, "item", draws, "n", 5, 7)
    per_cycle = drawn.groupBy("cycle").agg(F.count_distinct("item").alias("k")).collect()
    assert sorted((r.cycle, r.k) for r in per_cycle) == [(0, 7), (1, 7), (2, 7)]
    order = [[r.item for r in drawn.filter(f"cycle = {c}").orderBy("offset").collect()] for c in (0, 1)]
    assert order[0] != order[1]


def test_shards_keep_groups_whole(spark, rows):
    df = spark.createDataFrame([(i, f"g{i % 5}") for i in range(40)], "ordinal int, scene string")
    sharded = selection.with_shard(df, "scene", "ordinal", 2)
    assert sharded.groupBy("scene").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    assert rows(sharded.select("scene", "shard").distinct()) == [("g0", 0), ("g1", 1), ("g2", 0), ("g3", 1), ("g4", 0)]


def test_unknown_groups_and_allowed_sample(spark, rows):
    df = spark.createDataFrame([(0, "a", "s0"), (1, "b", "s1")], "ordinal int, base_scene_id string, sample_id string")
    assert rows(selection.unknown_groups(df, ["a", "z"])) == [("z",)]
    snapshot = spark.createDataFrame([("s1",)], "sample_id string")
    assert rows(selection.allowed_sample(df, snapshot), "sample_id") == [("s1",)]
    assert selection.allowed_sample(df, snapshot, "s0").count() == 0


def test_text_scans(spark, rows):
    key = "-----BEGIN " + "RSA PRIVATE KEY-----"
    docs = spark.createDataFrame(
        [("clean.py", 10, "x = 1", False), ("key.txt", 10, key, False), ("run.sh", 10, "a\r\nb", True), ("doc.md", 10, "a\r\nb", False),
         ("big.bin", 96 * 1024 * 1024, "", False), ("tok.txt", 9, "hf_" + "a" * 24, False)],
        "path string, length long, text string, script boolean",
    )
    found = rows(documents.scan_text(docs, size="length", script="script"))
    assert found == [("big.bin", "oversized"), ("key.txt", "private_key"), ("run.sh", "crlf"), ("tok.txt", "token")]
    raw = spark.createDataFrame([(1, '{"a": [{"deep": {"seed": 1}}], "b": "seed: \\"seed\\": no"}'), (2, '{"b": "seed"}')], "doc_id int, raw string")
    assert rows(documents.forbidden_keys(raw, ["seed", "deep"])) == [(1, "deep"), (1, "seed")]


@pytest.mark.parametrize("value,ok", [((64, 32, 5), True), ((64, 48, 5), False), ((64, 32, 8), False), ((64, 32, 1), False)])
def test_grid_rule(spark, value, ok):
    df = spark.createDataFrame([value], "width int, height int, frames int")
    assert records.check_grid(df).first().grid_ok is ok


def test_companions(spark):
    df = spark.createDataFrame(
        [("x", "t", None), (None, None, None), (None, "t", None)], "first_frame string, text string, mass double"
    )
    got = records.require_companions(df, "first_frame", ["text", "mass"], ["text"]).collect()
    assert [(r.missing, r.orphaned) for r in got] == [(["mass"], []), ([], []), ([], ["text"])]
