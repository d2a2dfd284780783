import numpy as np

from tests.llm.fixtures import documents, labels, odd_documents
from trackloom.llm import quality


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeionrst"), 5)) for _ in range(300)]
    good = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(n)]
    junk = [" ".join(w + "%%%" for w in rng.choice(words, 60)) for _ in range(n // 3)]
    return good, junk


def test_separates_junk_without_seeing_a_negative_label():
    good, junk = _texts(900, 1)
    pos, unl = quality.features(good[:300]), quality.features(good[300:600] + junk[:150])
    model = quality.fit(pos, unl)
    assert 0.5 <= model.prior <= 0.8  # two thirds of the unlabelled are good
    assert (model.score(good[600:]) >= 0.3).mean() > 0.97
    assert (model.score(junk[150:]) < 0.3).mean() > 0.9


def test_best_bin_prior_on_known_mixture():
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, 5000)
    unl = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 2000)])
    assert abs(quality.best_bin_prior(pos, unl) - 0.6) < 0.06


def test_a_fully_labelled_table_is_learnt_too(spark):
    """The unlabelled sample ignores labels, so junk that is labelled still counts as unlabelled."""
    good, junk = _texts(600, 4)
    docs = documents(spark, good + junk)
    marks = labels(spark, [(i, int(i < len(good)), 0) for i in range(len(good) + len(junk))])
    score = [r["s"] for r in docs.select(quality.quality_score(quality.fit_from_tables(docs, marks)).alias("s")).collect()]
    assert np.mean(np.array(score[: len(good)]) >= 0.3) > 0.97 and np.mean(np.array(score[len(good) :]) < 0.3) > 0.9


def test_risk_and_gradient_equal_their_definition():
    """Sums over all rows and differences of them, on both sides of zero."""
    rng = np.random.default_rng(3)
    for shift, prior in ((0.0, 0.4), (-3.0, 0.7)):
        fp, fu = rng.normal(1, 1, 7), rng.normal(shift, 1, 9)
        loss = lambda z: np.log1p(np.exp(-z))
        parts = lambda p, u: (prior * sum(map(loss, p)) / len(p), sum(loss(-x) for x in u) / len(u) - prior * sum(loss(-x) for x in p) / len(p))
        assert np.allclose(quality.risk(fp, fu, prior), parts(fp, fu))
        below = parts(fp, fu)[1] < 0
        assert below == (shift < 0)
        aim = (lambda p, u: -parts(p, u)[1]) if below else (lambda p, u: sum(parts(p, u)))
        g_p, g_u = quality.risk_gradient(fp, fu, prior)
        for i, d in enumerate(np.eye(len(fp)) * 1e-6):
            assert abs((aim(fp + d, fu) - aim(fp - d, fu)) / 2e-6 - g_p[i]) < 1e-6
        for i, d in enumerate(np.eye(len(fu)) * 1e-6):
            assert abs((aim(fp, fu + d) - aim(fp, fu - d)) / 2e-6 - g_u[i]) < 1e-6


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    model = quality.fit_from_tables(docs, labels(spark, [(4, 1, 0), (6, 1, 0), (2, None, None)]))
    out = quality.with_quality(docs, model, "score").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 5]
    assert same[0] == same[1]
    nothing = quality.with_quality(documents(spark, []), quality.fit_from_tables(documents(spark, []), labels(spark)))
    assert nothing.count() == 0
