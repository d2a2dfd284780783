import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trackloom.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edit strings up to two inserts in a gap, by trying them."""
    kinds = faults(rows)
    ways = {("", ""): (0, "", ())}  # (initials) -> least; keyed by what was written so far

    def add(table, initials, cost, audit, turns):
        if re.fullmatch(r"s?(ua)*u?", initials):
            best = table.get(initials)
            if best is None or (cost, audit) < best[:2]:
                table[initials] = (cost, audit, turns)

    def inserted(table):
        for _ in range(2):
            for initials, (cost, audit, turns) in list(table.items()):
                for role in ("user", "assistant"):
                    add(table, initials + role[0], cost + 5, audit + "I", (*turns, (role, "")))
        return table

    ways = inserted({"": (0, "", ())})
    for (role, text), kind in zip(rows, kinds):
        new = {}
        for initials, (cost, audit, turns) in ways.items():
            add(new, initials, cost + 2, audit + "D", turns)
            if kind in ("", "truncated"):
                more = 5 * (kind == "truncated")
                if role:  # an empty role fits nowhere
                    add(new, initials + role[:1], cost + more, audit + "K", (*turns, (role, text)))
                for other in ("user", "assistant"):
                    add(new, initials + other[0], cost + 1 + more, audit + "R", (*turns, (other, text)))
        ways = inserted(new)
    return min(v for k, v in ways.items() if PATTERN.fullmatch(k))


def expect(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    plain = [r[1:] for r in rows]
    kinds = faults(plain)
    cost, audit, turns = cheapest(plain)
    known = {r[0] for r in rows} - {None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest


@pytest.mark.parametrize("segment", [1, 2, 64])
def test_edits_equal_a_search_over_all_of_them(spark, segment, monkeypatch):
    rnd = random.Random(segment)
    roles = ["user", "assistant", "system", "tool", "usher", ""]
    texts = ["one.", "two!", "three", "", " \n", "four?  ", "é漢."]
    rows = {c: [(rnd.choice([None, *range(9)]), rnd.choice(roles[: rnd.choice((2, 3, 6))]), rnd.choice(texts)) for _ in range(rnd.randint(1, 8))] for c in range(120)}
    monkeypatch.setattr(repair, "SEGMENT", segment)
    got = {}
    for c, v in rows.items():  # the lattice alone, for any length of a segment
        plan = repair._Plan(c)
        order = sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        first = {}
        for t, r, x in order:
            first.setdefault((r, x), t)
        for t, r, x in reversed(order):
            end = x.rstrip(repair.SPACE)[-1:]
            later = first[r, x] != t
            plan.add(t, r, hashlib.md5(x.encode()).hexdigest(), False, r[:1], 1 if not end else 0 if end in ".!?" else 3, later)
        got[c] = plan.close()[2:]
        assert got[c] == expect(v)[:7], (c, v)
    if segment == 64:
        df = spark.createDataFrame([(c, *r) for c, v in rows.items() for r in v], ROWS).repartition(5)
        plans = repair.plan_edits(df)
        out = repair.with_digest(plans, repair.turn_digests(repair.repaired_turns(df, plans))).collect()
        assert {r["conv_id"]: tuple(r[2:]) for r in out} == {c: expect(v) for c, v in rows.items()}


def test_repaired_turns_keep_texts_and_follow_the_pattern(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (2, 0, "system", "Be kind."), (3, 5, "user", "A."), (3, 6, "user", "B."), (3, 7, "user", "C.")]
    df = spark.createDataFrame(rows, ROWS)
    plans = repair.plan_edits(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in plans.collect()} == {1: (2, "RR"), 2: (2, "D"), 3: (3, "DKR")}
    out = {}
    for r in repair.repaired_turns(df, plans).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    assert out == {1: [("user", "Hi.", "R"), ("assistant", "Why?", "R")], 3: [("user", "B.", "K"), ("assistant", "C.", "R")]}


def test_a_long_conversation_is_solved_in_segments():
    rnd = random.Random(4)
    plan = repair._Plan(1)
    n = 20_000
    for k in range(n, 0, -1):
        plan.add(k, rnd.choice(["user", "assistant"]), str(k), False, rnd.choice("ua"), rnd.choice([0, 0, 0, 1, 3]), False)
    out = plan.close()
    assert out[1] == n and len(out[8].replace("I", "")) == n and out[7] > 0


def test_damage_follows_the_key_and_keeps_every_conversation(spark):
    df = spark.createDataFrame([(c, t, None if c == 3 else "assistant", None if c == 4 else "Yes. No!") for c in range(60) for t in (0, 1)] + [(None, None, "user", "ok.")], ROWS)
    rows = repair.damaged(df.withColumn("lost", F.lit("mine"))).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for (c, t), found in seen.items():
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = ("user" if c is None else " " if c == 3 else "assistant"), ("ok." if c is None else " " if c == 4 else "Yes. No!")
        want = ("user" if kind == 4 else role, "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text, kind == 0)
        assert [(r["role"], r["text"], r["lost"]) for r in found] == [want] * (2 if kind == 3 else 1)
    assert len(seen) == 121
    plans = repair.plan_edits(repair.damaged(df)).collect()
    assert {r["conv_id"] for r in plans} == {None, *range(60)}


def test_lost_null_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "A.", True), (2, None, None, None, False), (None, 1, "user", "A.", False), (None, 2, "assistant", "B.", False)], ROWS + ", lost boolean")
    plans = repair.plan_edits(df)
    out = {r["conv_id"]: tuple(r[1:]) for r in repair.with_digest(plans, repair.turn_digests(repair.repaired_turns(df, plans))).collect()}
    nothing = hashlib.sha256().hexdigest()
    assert out[1] == (0, 0, 0, 0, 0, 0, 0, "", nothing)
    assert out[2] == (1, 0, 1, 0, 0, 0, 2, "D", nothing)
    assert out[None][6:] == (0, "KK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())
    none = df.limit(0)
    assert repair.plan_edits(none).count() == 0 and repair.repaired_turns(none, repair.plan_edits(none)).count() == 0
