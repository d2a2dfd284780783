import numpy as np

from tests.llm.fixtures import documents, labels, odd_documents
from trackloom.llm import toxicity
from trackloom.llm.common import held_out


def _brute(scores):
    """Maximal segments by the definition: best segment, then left and right of it."""
    def rec(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*rec(a, i), (i, j), *rec(j, b)]

    return rec(0, len(scores))


def test_maximal_segments_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.normal(-0.3, 1, rng.integers(0, 14)).round(3)
        got = toxicity.maximal_segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == _brute(list(scores))
        assert all(abs(s - sum(scores[a:b])) < 1e-6 for a, b, s in got)


def test_learns_and_scores_held_out_rows(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts, marks = [], []
    for i in range(700):
        w = list(rng.choice(words, 40))
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 40, 4):
                w[k] = ("xvileish", "xvilena", "zzgrim")[int(k) % 3]
        texts.append(" ".join(w))
        marks.append((i, 1, int(toxic)))
    docs, lab = documents(spark, texts), labels(spark, marks)
    model = toxicity.fit_lexicon(docs, lab)
    assert any(f.startswith("^xvil") for f in model.lexicon)
    found = docs.select("doc_id", toxicity.toxic_evidence(model).alias("e")).select("doc_id", "e.*")
    model = toxicity.calibrate(found, lab, model)
    rows = found.withColumn("score", toxicity.toxic_score(model)).where(held_out("doc_id")).collect()
    assert len(rows) > 50 and all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    model = toxicity.fit_lexicon(docs, labels(spark))
    out = docs.select("doc_id", toxicity.toxic_evidence(model).alias("e")).select("doc_id", "e.*").withColumn("score", toxicity.toxic_score(model)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] < 0.5 for r in out)
    model = toxicity.fit_lexicon(docs, labels(spark, [(4, 1, 1), (6, 1, 0), (5, 1, None)]))
    assert docs.select(toxicity.toxic_evidence(model)).count() == docs.count()
    none = documents(spark, [])
    assert none.select(toxicity.toxic_evidence(toxicity.fit_lexicon(none, labels(spark)))).count() == 0
