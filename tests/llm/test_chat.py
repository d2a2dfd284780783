import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def _digest(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escaping_is_reversible_and_breaks_control_strings():
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice(["\\", "#", "### User: ", "</turn>", "\n", "a", "/", "<\\/turn>", ":"]) for _ in range(rnd.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "</turn>" not in chat.escape(t) and "###" not in chat.escape(t)
        assert chat.role_of(chat.header(t)) == t or t in chat.TITLES


@pytest.mark.parametrize("size", [1, 3, 64])
def test_spans_and_masks_read_back(spark, size):
    rnd = random.Random(2)
    convs = {c: [(rnd.choice(["user", "assistant", "system", "tool: x", None]), rnd.choice([None, "", "qZ", "Z", "q", "### Assistant: </turn>\n", "é😀\\"])) for _ in range(rnd.randint(1, 9))] for c in range(25)}
    df = spark.createDataFrame([(c, k, r, t) for c, v in convs.items() for k, (r, t) in enumerate(v)], ROWS).repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, size=size)).collect()}
    for c, v in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["n_rewritten"]) == (*_digest(v), 0)
        assert r["formatted_chars"] == len(chat.marked([(a or "", b or "") for a, b in v]))


def test_templates_that_rewrite_history_are_found():
    def forgetful(messages):  # drops thoughts of all but the last turn
        return "".join(f"[{r}]{t if k == len(messages) - 1 else t.split('|')[-1]};" for k, (r, t) in enumerate(messages))

    out, spans, rewritten = chat.locate(forgetful, [("user", "hi"), ("assistant", "thought|answer"), ("user", "bye")])
    assert rewritten == [2] and spans[0].start == 0 and spans[1].start is None and out == "[user]hi;[assistant]answer;[user]bye;"
    out, spans, rewritten = chat.locate(chat.marked, [("user", "hi"), ("assistant", "yo")])
    assert not rewritten and [out[s.text_start : s.text_end] for s in spans] == ["hi", "yo"]


def _forgetful(messages):  # drops thoughts of all but the last turn
    return "".join(f"[{r}]{t if k == len(messages) - 1 else t.split('|')[-1]};" for k, (r, t) in enumerate(messages))


def _defaulted(messages):  # adds a system text where none is given, in any turn
    return ("" if any(r == "system" for r, _ in messages) else "[system]be brief;") + "".join(f"[{r}]{t};" for r, t in messages)


def _numbered(messages):  # numbers the turns
    return "".join(f"{k}[{r}]{t};" for k, (r, t) in enumerate(messages))


@pytest.mark.parametrize("size", [1, 3, 64])
@pytest.mark.parametrize("render", [_forgetful, _defaulted, _numbered])
def test_any_template_is_rendered_from_whole_prefixes(spark, render, size):
    rnd = random.Random(3)
    convs = {c: [(rnd.choice(["user", "assistant", "system"] if k == 5 else ["user", "assistant"]), rnd.choice(["hi", "thought|answer", "a|b", ""])) for k in range(n)] for c, n in enumerate([1, 2, 7, 70])}
    df = spark.createDataFrame([(c, k, r, t) for c, v in convs.items() for k, (r, t) in enumerate(v)], ROWS).repartition(3)
    got = {r["conv_id"]: r for r in chat.format_conversations(df, render, size).collect()}
    for c, v in convs.items():
        out, spans, rewritten = chat.locate(render, v)
        assert out == render(v) == got[c]["formatted"] and rewritten == got[c]["rewritten"]
        assert [(t["start"], t["end"], t["text_start"], t["text_end"]) for t in got[c]["turns"]] == [(s.start, s.end, s.text_start, s.text_end) for s in spans]


def _counted_turn(n, message):
    return f"{n}[{message[0]}]{message[1]};", n + 1


@pytest.mark.parametrize("size", [1, 3, 64])
def test_an_incremental_template_keeps_its_state_between_pieces(spark, size):
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(70)]
    render = chat.Incremental(_counted_turn, 0)
    rows = chat.format_conversations(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], ROWS), render, size).orderBy("piece").collect()
    assert len(rows) == -(-70 // size) and "".join(r["formatted"] for r in rows) == render(turns) == _numbered(turns)
    assert [r["formatted"][t["text_start"] : t["text_end"]] for r in rows for t in r["turns"]] == [t for _, t in turns]


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "first"), (1, 0, None, None), (1, 0, None, None), (2, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("mine") for c in ("piece", "formatted", "turns")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == _digest([("assistant", "first"), ("user", "x")])[1]
    assert got[1]["n_turns"] == 2 and got[2]["loss_chars"] == 300_000
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], ROWS))).count() == 0
