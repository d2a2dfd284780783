import json
import math
import os

import pytest

from tests.samples import edited, record
from tests.test_sequence import CANDIDATES, candidate_rows
from trackloom.streaming import live


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_metrics_stream_equals_batch(spark, tmp_path, rows):
    folder = tmp_path / "log"
    folder.mkdir()
    for part in range(3):
        lines = [json.dumps({"step": part * 10 + i, "mode": "response" if i % 2 else "ordinary", "axis": "a", "total": float(i)}) for i in range(10)]
        (folder / f"p{part}.json").write_text("\n".join(lines))
    run(live.live_metrics(live.read_progress(spark, str(folder), True)), "metrics_out", "complete")
    want = rows(live.live_metrics(live.read_progress(spark, str(folder))), "mode", "metric", "steps", "last_step")
    assert rows(spark.table("metrics_out"), "mode", "metric", "steps", "last_step") == want
    assert want == [("ordinary", 4.0, 15, 28), ("response", 5.0, 15, 29)]


def test_non_finite_totals_raise_the_alert(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "x", math.nan), (3, "a", "x", math.inf)], "step long, mode string, axis string, total double")
    r = live.live_metrics(df).first()
    assert (r.metric, r.non_finite) == (1.0, 2)


def test_best_so_far(spark, tmp_path, rows):
    write = live.best_so_far_writer(str(tmp_path / "best"))
    schema = "step long, mode string, total double"
    for batch, data in enumerate([[(1, "a", 5.0), (2, "a", 4.0)], [(3, "a", 4.5), (4, "b", 9.0)], [(5, "a", 1.0)]]):
        write(spark.createDataFrame(data, schema), batch)
        write(spark.createDataFrame(data, schema), batch)  # a replay changes nothing
    got = rows(spark.read.parquet(str(tmp_path / "best")), "mode", "total", "step", "batch")
    assert got == [("a", 1.0, 5, 2), ("a", 4.0, 2, 0), ("a", 5.0, 1, 0), ("b", 9.0, 4, 1)]


def test_tracker_stream_equals_loop(spark, tmp_path):
    rows, want = candidate_rows(11, videos=2, frames=12)
    schema = f"{CANDIDATES}, sx double, sy double"
    folder = tmp_path / "c"
    folder.mkdir()
    for part in range(3):  # three arrivals of four frames each
        chosen = [r for r in rows if r[1] // 4 == part]
        lines = [json.dumps(dict(zip(("video", "frame", "candidate_id", "cx", "cy", "area", "sx", "sy"), (*r, 100.0, 60.0)))) for r in chosen]
        (folder / f"p{part}.json").write_text("\n".join(lines))
        os.utime(folder / f"p{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run(live.live_tracker(stream), "tracker_out", "append")
    got = {(r.video, r.frame): r for r in spark.table("tracker_out").collect()}
    assert len(got) == 24
    for (video, frame), r in got.items():
        centre = want[video][0][frame]
        assert (r.cx is None) == (centre is None)
        if centre is not None:
            assert (r.cx, r.cy) == pytest.approx(tuple(float(c) for c in centre), rel=1e-6)


def test_tracker_walks_many_videos_in_one_call(spark, tmp_path):
    rows, want = candidate_rows(13, videos=40, frames=6)
    schema = f"{CANDIDATES}, sx double, sy double"
    folder = tmp_path / "c"
    folder.mkdir()
    for part, chosen in enumerate(([r for r in rows if r[1] < 3], [r for r in rows if r[1] > 1])):  # frame 2 comes again
        lines = [json.dumps(dict(zip(("video", "frame", "candidate_id", "cx", "cy", "area", "sx", "sy"), (*r, 100.0, 60.0)))) for r in chosen]
        (folder / f"p{part}.json").write_text("\n".join(lines))
        os.utime(folder / f"p{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run(live.live_tracker(stream, buckets=3), "many_out", "append")
    out = spark.table("many_out").collect()
    assert sorted((r.video, r.frame) for r in out if r.late) == sorted((v, 2) for v in want)
    got = {(r.video, r.frame): r for r in out if not r.late}
    assert len(got) == 240
    for (video, frame), r in got.items():
        centre = want[video][0][frame]
        assert (r.cx is None) == (centre is None)
        if centre is not None:
            assert (r.cx, r.cy) == pytest.approx(tuple(float(c) for c in centre), rel=1e-6)


def test_validation_stream(spark, tmp_path, rows):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps(record("x")) + "\n" + json.dumps(edited("split", "dev", record("y"))) + "\n")
    (folder / "b.jsonl").write_text(json.dumps(record("x")) + "\n{bad\n")
    lines = spark.readStream.text(str(folder))
    run(live.live_validation(lines), "violations_out", "append")
    assert sorted(r.rule_id for r in spark.table("violations_out").collect()) == ["R00", "R04"]
    run(live.live_unique_samples(spark.readStream.text(str(folder))), "unique_out", "append")
    assert rows(spark.table("unique_out")) == [("x",), ("y",)]
