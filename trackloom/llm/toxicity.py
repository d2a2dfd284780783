"""Toxic passages by maximal-scoring segments.

Words carry log-odds of toxic against clean documents under an informative Dirichlet prior taken from
the counts of the whole corpus; a word without evidence costs a constant. Every maximal segment of the
score sequence (the passages no extension or cut improves) is found in one linear scan. A segment's
score is turned into a significance by the extreme-value law of such maxima, the segments of a document
are combined by the law of their sum, and a logistic curve fitted on the training fold maps that
figure to a probability.

A word's evidence is the strongest of its own and its first four, five and six letters', so inflected
and compound forms share what was learnt about their stem.

Defined results: null and empty texts have no words, no segments and the score of a document without
evidence; texts are read whole; repeated rows score alike; without labelled rows every score is below
one half; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm.common import held_out

_WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
#: Words whose result a task remembers; the memory is emptied when full.
REMEMBERED = 200_000
#: Least log-odds of a feature in the lexicon.
LEAST_WEIGHT = 1.0


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(word: str) -> list[str]:
    """The word itself and its longer stems, told apart by their first character."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


class _Memo(dict):
    """word -> result of a function, computed once while remembered."""

    def __init__(self, fn) -> None:
        super().__init__()
        self.fn = fn

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.fn(word)
        return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    drift: float
    scale: float  # lambda of the extreme-value law
    constant: float  # K of that law
    slope: float = 0.0
    offset: float = -4.0

    def word_score(self, word: str) -> float:
        get = self.lexicon.get
        best = max(get(f, 0.0) for f in word_features(word))
        return best if best > 0 else -self.drift


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), left to right, in linear time.

    Only positive positions are visited; what lies between them is one negative step. A new positive
    run is merged leftwards with the nearest earlier segment that starts lower, while that one ends
    lower than the run does.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest lower-left
    for i in hot:
        item = (int(i), int(i) + 1, float(total[i]), float(total[i + 1]))
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                stack.append((*item, j))
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def significance(segments: list[tuple[int, int, float]], n_words: int, scale: float, constant: float) -> tuple[float, int]:
    """-log p of a document's significant segments together, and how many there are.

    A segment counts if fewer than one as good is expected by chance. For r such segments with
    normalised scores that add up to t, p is close to exp(-t) t^(r-1) / (r! (r-1)!).
    """
    shift = math.log(max(constant * n_words, 1.0))
    good = [x for _, _, s in segments if (x := scale * s - shift) > 0]
    if not good:
        return 0.0, 0
    t, r = sum(good), len(good)
    return max(0.0, t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)), r


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``max_rows`` toxic and as many clean rows of the training fold."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id").distinct()
    both = ids.join(marks, "doc_id").withColumn("_h", F.xxhash64("doc_id", F.lit("toxic")))
    pick = lambda k: both.where(F.col("toxic") == k).orderBy("_h", "doc_id").limit(max_rows).select("doc_id", "toxic")
    return pick(1).union(pick(0))


def _copy_key(texts: pa.Array) -> pa.Array:
    """The least hash of a text's word triples: near copies mostly share it, other texts do not."""
    out = []
    for t in texts.to_pylist():
        words = words_of(t)
        triples = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
        out.append(min(zlib.crc32("\x00".join(x).encode()) for x in triples))
    return pa.array(out, pa.int64())


def spread_copies(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample with a weight: the documents of one copy group and class weigh one together."""
    keyed = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.arrow_udf(_copy_key, "long")("text").alias("key"))
    sizes = keyed.groupBy("key", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return keyed.join(sizes, ["key", "toxic"]).groupBy("doc_id", "toxic").agg(F.min(1.0 / F.col("n")).alias("weight"))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weight of the documents of each class that hold a feature; one partial row per feature and batch."""
    memo = _Memo(word_features)
    for b in batches:
        counts: tuple[defaultdict[str, float], ...] = (defaultdict(float), defaultdict(float))
        for text, toxic, weight in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), b["weight"].to_pylist()):
            own = counts[toxic]
            own[""] += weight  # the empty feature counts documents
            for f in {f for w in set(words_of(text)) for f in memo[w]}:
                own[f] += weight
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array([counts[1][k] for k in keys], pa.float64()), pa.array([counts[0][k] for k in keys], pa.float64())],
            ["feature", "toxic", "clean"],
        )


def _lower_bound(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, share: np.ndarray, strength: float, margin: float) -> np.ndarray:
    """Log-odds under the Dirichlet prior ``strength * share``, less ``margin`` standard deviations."""
    a, b = toxic + strength * share, clean + strength * share
    rest_a, rest_b = n_toxic + strength - a, n_clean + strength - b
    return np.log(a / np.maximum(rest_a, 1e-9)) - np.log(b / np.maximum(rest_b, 1e-9)) - margin * np.sqrt(1 / a + 1 / b)


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 15_000, max_features: int = 50_000, strength: float = 500.0, margin: float = 2.0, drift: float = 0.3, least_docs: int = 2) -> ToxicityModel:
    """Weights of the features with evidence.

    Class counts come from the labelled sample, the prior from the counts of those features over all
    documents. The sample's ids (at most 30,000 rows of 12 bytes) are broadcast; the lexicon, a model
    parameter, has at most ``max_features`` entries.
    """
    docs = docs.select("doc_id", "text")
    sample = spread_copies(docs, labelled_sample(docs, labels, max_rows))
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int"), "weight")
    counted = rows.mapInArrow(_count_features, "feature string, toxic double, clean double").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # rows that cannot have a positive weight stay in the cluster
    tops = counted.where(f"feature = '' or toxic >= {least_docs}").withColumn("_gain", (F.col("toxic") - F.col("clean")).cast("double"))
    got = tops.orderBy(F.col("feature") != "", F.col("toxic") / (F.col("clean") + 1.0) < 1.0, F.desc("_gain"), "feature").limit(max_features).toArrow()
    names = got["feature"].to_pylist()
    toxic, clean = (np.asarray(got[c].to_pylist(), np.float64) for c in ("toxic", "clean"))
    if not names or names[0] != "" or toxic[0] == 0 or clean[0] == 0:
        return ToxicityModel({}, drift, 1.0, 0.1)
    n_toxic, n_clean = toxic[0], clean[0]
    strength = min(strength, 0.1 * (n_toxic + n_clean))  # a small sample is not drowned by its prior
    names, toxic, clean = names[1:], toxic[1:], clean[1:]
    pooled = (toxic + clean) / (n_toxic + n_clean)
    keep = _lower_bound(toxic, clean, n_toxic, n_clean, pooled, strength, margin) > LEAST_WEIGHT
    names, toxic, clean = [n for n, k in zip(names, keep) if k], toxic[keep], clean[keep]
    share, words = _corpus_share(docs, names)
    weight = _lower_bound(toxic, clean, n_toxic, n_clean, np.maximum(share, 1e-9), strength, margin)
    lexicon = {n: float(w) for n, w in zip(names, weight) if w > LEAST_WEIGHT}
    # the law's scale: sum of p(word) exp(scale * score) is one on clean words
    per_word = (clean + strength * share) / (n_clean + strength) * (weight > LEAST_WEIGHT) / max(words, 1.0)
    starts = np.asarray([n[0] == "=" for n in names], bool)
    p, s = per_word[starts], np.maximum(weight[starts], 0)
    return ToxicityModel(lexicon, drift, _scale(p, s, drift), 0.1)


def _corpus_share(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, float]:
    """Share of all documents that hold each feature, and the mean words of a document."""
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(lambda w: tuple(index[f] for f in word_features(w) if f in index))
        total = np.zeros(len(index) + 2, np.int64)
        for b in batches:
            for text in b["text"].to_pylist():
                words = words_of(text)
                total[-1] += len(words)
                total[-2] += 1
                hits = {i for t in set(map(memo.__getitem__, words)) for i in t}
                if hits:
                    total[list(hits)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["i", "n"])

    got = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(index) + 2)
    total[np.asarray(got["i"].to_pylist(), np.int64)] = got["n"].to_pylist()
    return total[:-2] / max(total[-2], 1), total[-1] / max(total[-2], 1)


def _scale(p: np.ndarray, s: np.ndarray, drift: float) -> float:
    """Positive root of sum p exp(x s) + (1 - sum p) exp(-x drift) = 1, by bisection."""
    if not len(p) or p.sum() <= 0:
        return 1.0
    f = lambda x: float((p * np.exp(x * s)).sum() + (1 - p.sum()) * math.exp(-x * drift) - 1)
    lo, hi = 1e-6, 1.0
    if f(lo) >= 0:
        return 0.05
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(hi, 64.0)


EVIDENCE = "struct<evidence:double,n_segments:int,top_start:int,top_end:int,top_score:double,n_words:int>"


def toxic_evidence(model: ToxicityModel, text: Column | str = "text") -> Column:
    """evidence (-log p), the number of significant segments, and the best one in word positions."""

    def scan(texts: pa.Array) -> pa.Array:
        memo = _Memo(model.word_score)
        get = memo.__getitem__
        out = []
        for t in (t for a in range(0, len(texts), 500) for t in texts.slice(a, 500).to_pylist()):
            words = words_of(t)
            scores = np.fromiter(map(get, words), np.float32, len(words))
            segments = maximal_segments(scores)
            e, r = significance(segments, len(words), model.scale, model.constant)
            a, b, s = max(segments, key=lambda x: (x[2], -x[0]), default=(None, None, 0.0))
            out.append((e, r, a, b, s, len(words)))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
        names = ("evidence", "n_segments", "top_start", "top_end", "top_score", "n_words")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))

    return F.arrow_udf(scan, EVIDENCE)(F.col(text) if isinstance(text, str) else text)


def calibrate(found: DataFrame, labels: DataFrame, model: ToxicityModel, step: float = 0.5, top: float = 60.0) -> ToxicityModel:
    """Fit the logistic curve on the training fold; ``found`` has doc_id and evidence.

    Evidence is cut into at most 122 steps in Spark, so that the driver gets two counts for each.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    train = found.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).join(marks, "doc_id")
    bins = train.groupBy(F.ceil(F.least("evidence", F.lit(top)) / step).alias("bin")).agg(F.sum("_toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toArrow()
    if not len(bins):
        return model
    x = np.asarray(bins["bin"].to_pylist(), np.float64) * step
    y, n = (np.asarray(bins[c].to_pylist(), np.float64) for c in ("toxic", "n"))
    slope, offset = 0.5, -2.0
    for _ in range(50):  # Newton steps with a weak pull to (0.5, -2) so that separable data stay finite
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        w = n * p * (1 - p)
        g = np.array([((y - n * p) * x).sum() - 0.05 * (slope - 0.5), (y - n * p).sum() - 0.05 * (offset + 2)])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope + move[0], offset + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return ToxicityModel(model.lexicon, model.drift, model.scale, model.constant, max(float(slope), 1e-3), float(offset))


def toxic_score(model: ToxicityModel, evidence: Column | str = "evidence") -> Column:
    z = F.col(evidence) if isinstance(evidence, str) else evidence
    return 1.0 / (1.0 + F.exp(-(F.least(z, F.lit(200.0)) * model.slope + model.offset)))
