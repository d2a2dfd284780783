"""Queries that together cover all rows of what they are named for."""

from trackloom.plans.catalogue import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_every_order_is_restored(spark):
    rows = catalogue()["restore_order_all"].spark_frame(spark, FOLDER).collect()
    keys = sorted(r["o_orderkey"] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").collect())
    assert sorted((r["ordinal"], r["o_orderkey"]) for r in rows) == list(enumerate(keys))


def test_ordinary_and_response_microbatches_fill_the_schedule(spark):
    pairs = catalogue()["training_schedule"].spark_frame(spark, FOLDER).collect()
    records = catalogue()["training_schedule_ordinary"].spark_frame(spark, FOLDER).collect()
    cells = [(r["step"], r["rank"], r["micro"]) for r in [*pairs, *records]]
    assert len(records) == 480 and {r["draw_index"] for r in records} == set(range(480))
    assert len(pairs) == 160 and set(cells) == {(s, r, m) for s in range(100) for r in range(2) for m in range(2)}
