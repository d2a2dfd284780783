import random

from tests.llm.fixtures import documents, odd_documents
from trackloom.llm import secrets


def _key(rnd):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(32))


def test_base_patterns():
    text = 'x password = "abcdefgh1" token:short API-key apikey=\'A.b/c=d_e-f+\' AKIA0123456789AB AKIA012 ' + "0f" * 20 + " secret=secret:longenough99"
    spans = secrets.scan(text)[0]
    got = [(secrets.KINDS[k], text[a:b]) for a, k, b in spans]
    assert got == [("assign", 'password = "abcdefgh1'), ("assign", "apikey='A.b/c=d_e-f+"), ("access", "AKIA0123456789AB"), ("hex", "0f" * 20)]


def test_automaton_is_a_distribution_and_knows_the_format():
    rnd = random.Random(1)
    strings = {"AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)): 1 for _ in range(300)}
    a = secrets.infer(strings)
    assert 4 < len(a.moves) < 40  # the fixed beginning stays, the random rest is merged
    import math

    for moves, end in zip(a.moves, a.ends):
        assert abs(sum(math.exp(p) for _, p in moves.values()) + math.exp(end) - 1) < 0.02
    assert a.log_likelihood("AKIA" + "Q" * 16) > a.log_likelihood("QKIA" + "Q" * 16) + 5


def test_adds_like_strings_and_leaves_words_alone(spark):
    rnd = random.Random(5)
    bare = _key(rnd)[:24]
    words = "Internationalisationskommissionen-und 4111222233334444 ordinary-text-with-hyphens"
    texts = [f"token={_key(rnd)} {words}" for _ in range(60)] + [f"see {bare} there"]
    docs = documents(spark, texts)
    model = secrets.fit_formats(docs)
    found = [model.spans(t) for t in texts]
    assert found[-1] == [(4, 3, 28)]
    assert all([k for _, k, _ in s] == [0, 2] for s in found[:-1])
    assert secrets.PLACEHOLDER in model.redact(texts[0]) and not model.spans(model.redact(texts[0]))
    assert model.redact("nothing here") == "nothing here"


def test_runs_beside_spans_equal_brute_force():
    rnd = random.Random(9)
    for _ in range(500):
        places = sorted(rnd.sample(range(60), 12))
        runs = [(a, b, "x") for a, b in zip(places[::2], places[1::2])]
        spans = sorted((a, rnd.randint(0, 2), a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 5))))
        assert secrets._untouched(runs, spans) == [r for r in runs if not any(r[0] < e and s < r[1] for s, _, e in spans)]
    long = "token=abcdefgh12 0123456789abcdef0 plain-words-in-a-row " * 40_000
    assert len(secrets.scan(long)[0]) == 40_000 and len(secrets.scan(long)[2]) == 80_000


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    model = secrets.fit_formats(docs)
    out = docs.select("text", secrets.secret_spans(model).alias("s"), secrets.redacted(model).alias("r")).collect()
    assert len(out) == docs.count() and all(r["s"] == [] and r["r"] == r["text"] for r in out)
    assert documents(spark, []).select(secrets.secret_spans(secrets.fit_formats(documents(spark, [])))).count() == 0
