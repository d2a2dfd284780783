import random
import re

import pytest

from tests.llm.fixtures import DOCS, documents, odd_documents
from trackloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal, cut at the top, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def corpus(spark, rnd, sources, n):
    rows = []
    for s in sources:
        for _ in range(rnd.randint(1, n)):
            words = rnd.choice([0, 1, 5, 20, 80, 300])
            rows.append((len(rows), " \n".join(["w"] * words), "en", s, 0))
    return spark.createDataFrame(rows, DOCS)


def test_targets_equal_dealing_the_excess_again(spark):
    rnd = random.Random(3)
    for trial in range(4):
        sizes = {s: rnd.choice([0, 1, 3, 50, 400, 9_000]) for s in [None, "", "Z", "a", "é", "漢", "😀", *(f"s{i}" for i in range(rnd.randint(0, 20)))]}
        df = spark.createDataFrame([(s, n, trial) for s, n in sizes.items()], "source string, source_size long, trial int")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.source_targets(df, share=3.0)


@pytest.mark.parametrize("block, fan", [(2048, 64), (4, 2)])
def test_words_taken_come_near_each_target(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN", fan)
    df = corpus(spark, random.Random(5), ["a", "b", "c", None, "x"], 300)
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == df.count()
    by, texts = {}, {r["doc_id"]: r for r in df.collect()}
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]["text"]))
        x = r["target"] / r["source_size"]
        assert r["size"] == size and r["taken"] == r["copies"] * size <= 2 * size
        assert r["copies"] in (int(x), int(x) + 1) or not size
        by.setdefault(texts[r["doc_id"]]["source"], []).append(r)
    for s, mine in by.items():
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)}
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)


def test_every_document_keeps_its_expected_copies(spark):
    df = documents(spark, ["w " * (1 + i % 7) for i in range(40)])
    total = [0] * 40
    for seed in range(12):
        for r in mixing.mix(df, seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
    assert all(12 <= t <= 24 for t in total) and min(total) < 18 < max(total)
    assert sum(total) / 480 == pytest.approx(1.5, abs=0.05)


def test_transfer_keeps_words_and_settles_one():
    rnd = random.Random(6)
    for _ in range(2000):
        a, b, p, q = rnd.randint(1, 90), rnd.randint(1, 90), rnd.uniform(0.01, 0.99), rnd.uniform(0.01, 0.99)
        x, y = mixing._transfer(a, p, b, q, rnd.random())
        assert a * x + b * y == pytest.approx(a * p + b * q, abs=1e-6) and (x in (0.0, 1.0) or y in (0.0, 1.0)) and 0 <= x <= 1 and 0 <= y <= 1


def test_repeated_odd_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    same = spark.createDataFrame([(5, "two words", "en", "s", 0)] * 100 + [(None, "one", "en", "s", 0)] * 3, DOCS)
    rows = mixing.mix(same).collect()
    assert len(rows) == 103 and abs(sum(r["taken"] for r in rows) - 1.5 * 203) <= 2
    odd = odd_documents(spark)
    out = mixing.mix(odd)
    assert out.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"] and out.count() == odd.count()
    assert {r["doc_id"]: r["taken"] for r in out.collect() if not r["size"]} == {1: 0, 2: 0, 3: 0}
    assert mixing.mix(odd.limit(0)).count() == 0
