import random

from tests.llm.fixtures import documents, odd_documents
from trackloom.llm import pieces


def _all_paths(tool, text, n):
    edges = tool.edges(" " + text)

    def rec(j):
        return [(0.0, ())] if j == 0 else [(s + own, ids + i) for at, own, i in edges[j] for s, ids in rec(at)]

    return sorted(rec(len(text) + 1), key=lambda r: -r[0])[:n]


def test_n_best_equal_all_paths_and_decode():
    tool, rnd = pieces.Lattice(pieces.VOCABULARY, 4), random.Random(3)
    for _ in range(150):
        text = "".join(rnd.choice("the an.of é,\n▁") for _ in range(rnd.randint(1, 9)))
        want = _all_paths(tool, text, 4)
        ids, score, others = tool.encode(text)
        assert [round(w[0], 6) for w in want] == [round(s, 6) for s in [score, *(score - loss for loss, _ in others)]]
        assert tool.decode(ids.tolist()) == text
        for _, edits in others:
            own = ids.tolist()
            for at, drop, new in reversed(edits):
                own[at : at + drop] = new
            assert tool.decode(own) == text and own != ids.tolist()


def test_backward_search_is_in_order_of_score():
    tool = pieces.Lattice(pieces.VOCABULARY, 4)
    got = tool.search(" international", 30)
    assert len(set(got)) == 30 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_forgetting_changes_nothing(monkeypatch):
    text = " ".join(f"w{i}x{i * 7}" for i in range(400))
    whole = pieces.Lattice(pieces.VOCABULARY, 3).encode(text)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "AT_ONCE", 7)
    tool = pieces.Lattice(pieces.VOCABULARY, 3)
    list(tool.encode_many(["other words here", text[:100]]))
    again = tool.encode(text)
    assert whole[0].tolist() == again[0].tolist() and abs(whole[1] - again[1]) < 1e-9


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    encoded = pieces.encode(docs)
    out = encoded.select("text", "score", "round_trip", "lang", pieces.decoded("ids").alias("back")).collect()
    assert len(out) == docs.count() and all(r["back"] == (r["text"] or "") and r["round_trip"] and isinstance(r["score"], float) for r in out)
    assert set(docs.columns) <= set(encoded.columns) and len(encoded.columns) == len(set(encoded.columns))
    assert pieces.encode(documents(spark, [])).count() == 0
