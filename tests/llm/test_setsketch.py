import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, odd_documents
from trackloom.llm import common, setsketch


def _set(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def _brute(texts, percent=85):
    sets, parent = [_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def _corpus(n_groups, per_group, seed, edits):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    texts = []
    for _ in range(n_groups):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(per_group):
            v = list(base)
            for _ in range(rnd.randint(0, edits)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            texts.append(" ".join(v))
    rnd.shuffle(texts)
    return texts


def test_registers_merge_and_estimate():
    a, b = setsketch.shingle_hashes(" ".join(map(str, range(900)))), setsketch.shingle_hashes(" ".join(map(str, range(300, 1200))))
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    union = setsketch.registers(np.union1d(a, b))
    assert (setsketch.merge(ra, rb) == union).all()
    assert abs(setsketch.cardinality(union) / len(np.union1d(a, b)) - 1) < 0.4
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = setsketch.joint_similarity(*(np.array([float(x)]) for x in ((ra > rb).sum(), (ra < rb).sum(), len(a), len(b))))
    assert abs(got[0] - want) < 0.15


def test_shingle_sets_are_exact():
    rnd = random.Random(0)
    for _ in range(100):
        text = " ".join(rnd.choice(["A", "b", "É", "é", "c\td", "x" * 70]) for _ in range(rnd.randint(0, 12)))
        assert len(setsketch.shingle_hashes(text)) == len(_set(text))
    long = "x" * 64
    assert setsketch.shingle_hashes(long + "ab")[0] != setsketch.shingle_hashes(long + "ba")[0]


@pytest.mark.parametrize("block", [256, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    """Small blocks send the groups through several pairs of blocks."""
    monkeypatch.setattr(common, "BLOCK", block)
    monkeypatch.setattr(setsketch, "BLOCK", block)
    monkeypatch.setattr(common.block_pairs, "__defaults__", (block,))
    texts = _corpus(6, 25, 3, 4) + ["one two", "ONE  two", "one two three four five", ""] + ["a b c d e f g"] * 12
    want, sizes = _brute(texts)
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_odd_rows_and_empty_tables(spark):
    out = setsketch.near_duplicates(odd_documents(spark)).collect()
    assert len(out) == 8
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[2]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[4]["n_shingles"] == len(_set("word and other words that follow. " * 3))
    assert setsketch.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
