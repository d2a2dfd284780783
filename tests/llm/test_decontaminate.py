import random
import re
from collections import Counter

import pytest

from tests.llm.fixtures import documents, odd_documents
from trackloom.llm import decontaminate

ITEM = "item_id long, text string"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))


def _brute(texts, items, n=10):
    windows = {}
    for i, t in items:
        w = _words(t)
        k = min(n, len(w))
        for o in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[o : o + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for k in {len(x) for x in windows}:
            for o in range(len(w) - k + 1):
                if tuple(w[o : o + k]) in windows:
                    hit |= set(range(o, o + k))
                    found |= windows[tuple(w[o : o + k])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    """With no room to broadcast, every join is shuffled and the rows are the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(2)
    words = ["aa", "bb", "cc", "Dd", "é", "É", "zz9"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 10, 14, 30])))) for i in range(12)] + [(50, "x y z"), (51, "x, Y; z"), (50, None)]
    texts = []
    for _ in range(40):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))]
        if rnd.random() < 0.5:
            w = _words(rnd.choice(items)[1])
            parts.insert(rnd.randint(0, 1), " - ".join(w[rnd.randint(0, 3) :]))
        texts.append(" ".join(parts))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(documents(spark, texts), spark.createDataFrame(items, ITEM)).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts, items)


def test_proximity_takes_words_out_of_order(spark):
    item = " ".join(f"w{i}" for i in range(10))
    swapped = "start w1 w0 w2 w3 w4 w5 w6 extra w7 w8 w9 end"
    docs, bench = documents(spark, [swapped, item, "w0 w1 w2 w3"]), spark.createDataFrame([(1, item)], ITEM)
    hit = lambda s: {r["doc_id"] for r in decontaminate.find(docs, bench, slop=s).where("n_hit > 0").collect()}
    assert hit(0) == {1} and hit(2) == {0, 1}


def _brute_near(texts, items, slop, n=10):
    """Every span of at most k + 2 slop words that holds a window's words as often, and whose ends it needs."""
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for i, item in items:
            x = _words(item)
            k = min(n, len(x))
            for need in [Counter(x[o : o + k]) for o in range(len(x) - k + 1 if x else 0)]:
                for a in range(len(w)):
                    for b in range(a + k, min(len(w), a + k + 2 * slop) + 1):
                        if need <= Counter(w[a:b]) and not need <= Counter(w[a + 1 : b]) and not need <= Counter(w[a : b - 1]):
                            hit |= set(range(a, b))
                            found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("slop", [1, 2, 4])
def test_proximity_equals_brute_force(spark, slop):
    """Random permutations of a window with foreign words put in, and words that come too seldom."""
    rnd = random.Random(slop)
    some = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rnd.choice(some[:n]) if i % 2 else x for x in rnd.sample(some, n))) for i, n in enumerate([10, 10, 12, 14, 3, 4, 1, 2])]
    texts = ["w9 w1 w2 w3 w4 w5 w6 w7 w8 w0"]
    for _ in range(60):
        w = _words(rnd.choice(items)[1])
        o = rnd.randint(0, max(0, len(w) - 10))
        w = w[o : o + 10]
        rnd.shuffle(w)
        for _ in range(rnd.randint(0, 2 * slop + 1)):
            w.insert(rnd.randint(0, len(w)), rnd.choice(["x", "y", *some]))
        if rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = rnd.choice(some)
        texts.append(" ".join([*rnd.choices(["x", "y", "w0"], k=rnd.randint(0, 30)), *w, *rnd.choices(["x", "y", "w1"], k=rnd.randint(0, 5))]))
    items.append((90, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(documents(spark, texts), spark.createDataFrame(items, ITEM), slop=slop).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_near(texts, items, slop)
    assert "90" in got[0][2]


def test_odd_rows_and_empty_tables(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], ITEM)
    bench = spark.createDataFrame([(1, "same row twice in this table"), (None, "a text without an id stays alone here"), (2, ""), (3, None)], ITEM)
    out = decontaminate.find(docs, bench).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[5]["n_hit"] == 6 and by[5]["items"] == ["1"] and by[None]["n_hit"] == 8 and by[None]["items"] == []
    assert by[1]["n_words"] == 0 and by[4]["n_hit"] == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find(docs, none).collect())
    assert decontaminate.find(documents(spark, []), bench).count() == 0


def test_plan_has_no_python(spark):
    plan = decontaminate.find(documents(spark, ["a b c"]), spark.createDataFrame([(1, "a b c")], ITEM))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
