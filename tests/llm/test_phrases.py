import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, odd_documents
from trackloom.llm import phrases


def counts(rows, longest=3):
    """Occurrences of all phrases by language, and all words."""
    found, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            found.update((lang, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return found, total


def best(found, total, least, top):
    often = {key: n for key, n in found.items() if n >= least}
    out = []
    for lang in total:
        rows = []
        for (where, phrase), a in often.items():
            words = phrase.split(" ")
            if where != lang or len(words) < 2:
                continue
            inside = [n for (o, q), n in often.items() if o == lang and len(q.split(" ")) > len(words) and f" {phrase} " in f" {q} "]
            if any(100 * n >= 50 * a for n in inside):
                continue
            cuts = [(1_000_000 * a * a // (found[lang, " ".join(words[:j])] * found[lang, " ".join(words[j:])]), j) for j in range(1, len(words))]
            score, j = min(cuts)
            rows.append((-score, -a, phrase.encode(), found[lang, " ".join(words[:j])], found[lang, " ".join(words[j:])]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


def texts(rnd, n):
    vocabulary = [*"abcdefgh", "É", "漢字", "x\x00y", "\x1c"]
    rows = []
    for i in range(n):
        words = rnd.choices(vocabulary, weights=[9, 8, 7, 5, 3, 2, 1, 1, 1, 1, 1, 1], k=rnd.randint(0, 60))
        text = "".join(w.upper() * (rnd.random() < 0.1) or w for w in words for w in (w, rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"])))
        rows.append((i, text, rnd.choice(["en", "en", "en", "de", None]), "s", 0))
    return rows


@pytest.mark.parametrize("shards, slots, least", [(3, 1 << 16, 10), (1, 1 << 16, 4), (4, 16, 12), (2, 1, 7)])
def test_phrases_equal_counting_all_of_them(spark, monkeypatch, shards, slots, least):
    """Any number of shards and any size of the slot table give the exact counts."""
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = texts(random.Random(shards), 90)
    found, total = counts(rows, 4)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = phrases.frequent_phrases(df, least, 4, shards, slots).collect()
    want = {(*key, n) for key, n in found.items() if n >= least} | {(lang, "", n) for lang, n in total.items()}
    assert len(out) == len(want) and {(r["lang"], r["phrase"], r["n"]) for r in out} == want


def test_best_phrases_equal_brute_force(spark):
    rows = texts(random.Random(7), 150)
    found, total = counts(rows)
    got = phrases.collocations(phrases.frequent_phrases(spark.createDataFrame(rows, DOCS).repartition(3), 6, slots=1 << 16), 12)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(best(found, total, 6, 12))


def test_scores_beyond_64_bits(spark):
    big = 40_000_000_000
    rows = [("en", "", 0, 3 * big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    out = phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, n long")).collect()
    assert [tuple(r) for r in out] == [("en", 1, "a b", big - 2, big, big - 1, 3 * big, 1_000_000 * (big - 2) ** 2 // (big * (big - 1)))]


def test_odd_and_no_rows(spark):
    odd = odd_documents(spark).withColumns({c: F.lit("mine") for c in ("phrase", "k", "n", "shard", "reached", "mask")})
    found, total = counts([tuple(r[:5]) for r in odd.collect()])
    out = phrases.frequent_phrases(odd, slots=1 << 16).collect()
    want = {(*key, n) for key, n in found.items() if n >= 10} | {(lang, "", n) for lang, n in total.items()}
    assert {(r["lang"], r["phrase"], r["n"]) for r in out if r["n"]} == {w for w in want if w[2]}
    none = phrases.frequent_phrases(odd.limit(0), slots=1 << 16)
    assert none.count() == 0 and phrases.collocations(none).count() == 0
