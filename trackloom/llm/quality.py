"""Quality classifier from positive and unlabelled documents.

A small network over character-class and repetition features is fitted with the non-negative risk
estimator for positive-unlabelled data: the risk of the positives is ``prior * loss(+1)``, that of the
negatives ``E_unlabelled[loss(-1)] - prior * E_positive[loss(-1)]`` and is never allowed below zero (a
step that would push it there ascends instead). The class prior is estimated from a first, plain
positive-against-unlabelled fit by the best bin of its held-back scores. Negative labels are never used.

Defined results: a null or empty text has all-zero features and is scored like any other; texts of any
length are read whole; repeated rows get equal scores; an empty table gives an empty result; other
columns are kept, and an existing column of the output's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm.common import held_out

CLASSES = 13
FEATURES = CLASSES * CLASSES + 12
#: Steps that even the smallest training set gets.
LEAST_STEPS = 800


def _class_table() -> np.ndarray:
    """Character class of each code point below 0x3000; higher ones count as letters without case."""
    out = np.full(0x3001, 2, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.islower():
            out[cp] = 0
        elif c.isupper():
            out[cp] = 1
        elif c.isalpha():
            out[cp] = 2
        elif c.isdigit():
            out[cp] = 3
        elif c in "\n\r":
            out[cp] = 5
        elif c.isspace():
            out[cp] = 4
        elif c == ".":
            out[cp] = 6
        elif c in ",;:":
            out[cp] = 7
        elif c in "!?":
            out[cp] = 8
        elif c in "'\"()[]-«»“”‘’–":
            out[cp] = 9
        elif c in "#$%&*+=@^~":
            out[cp] = 10
        elif c in "|<>/\\_`{}":
            out[cp] = 11
        else:
            out[cp] = 12
    return out


_TABLE = _class_table()


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text: square roots of class-pair shares, then repetition and length figures."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _TABLE[np.minimum(cps, 0x3000)].astype(np.intp)
        n = len(cls)
        if n > 1:
            pairs = np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
            out[i, : CLASSES * CLASSES] = np.sqrt(pairs / (n - 1))
        words = text.split()
        lines = text.split("\n")
        w = max(1, len(words))
        counts: dict[str, int] = {}
        for x in words:
            counts[x] = counts.get(x, 0) + 1
        same = sum(map(str.__eq__, words, words[1:]))
        sizes = np.fromiter(map(len, words), np.float32, len(words)) if words else np.zeros(1, np.float32)
        distinct_lines = len(set(lines))
        out[i, CLASSES * CLASSES :] = (
            np.log1p(n) / 10, np.log1p(len(words)) / 10, len(counts) / w, np.log1p(len(counts)) / np.log1p(w + 1),
            same / w, max(counts.values(), default=0) / w, sizes.mean() / 10, sizes.std() / 10,
            sizes.max() / 100, distinct_lines / len(lines), np.log1p(len(lines)) / 10, w / max(1, len(lines)) / 100,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(features(texts)).astype(np.float64), -30, 30)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """Parts of the unbiased risk with the logistic loss: of the positives, and of the negatives among the unlabelled."""
    return float(prior * _softplus(-fp).mean()), float(_softplus(fu).mean() - prior * _softplus(fp).mean())


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Descent direction by the scores of positives and unlabelled rows.

    While the negatives' part is not below zero, the gradient of the whole risk; else that part is led back up.
    """
    down_p, down_u = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    if risk(fp, fu, prior)[1] < 0:
        return -down_p, -down_u
    return down_p - prior * _sigmoid(-fp) / len(fp), down_u


def _train(pos: np.ndarray, unl: np.ndarray, prior: float, nonneg: bool, hidden: int, epochs: int, seed: int, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam on the (non-negative) positive-unlabelled risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    p = {"w1": rng.normal(0, 1 / np.sqrt(d), (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, batch = 0, 256
    rounds = max(1, max(len(pos), len(unl)) // batch)
    for _ in range(max(epochs, -(-LEAST_STEPS // rounds))):
        po, uo = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(rounds):
            xp = pos[np.take(po, range(k * batch, (k + 1) * batch), mode="wrap")]
            xu = unl[np.take(uo, range(k * batch, (k + 1) * batch), mode="wrap")]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ p["w1"] + p["b1"])
            f = h @ p["w2"] + p["b2"]
            fp, fu = f[: len(xp)], f[len(xp) :]
            g = np.concatenate(risk_gradient(fp, fu, prior) if nonneg else (-_sigmoid(-fp) / len(xp), _sigmoid(fu) / len(xu)))
            g = g.astype(np.float32)
            gh = np.outer(g, p["w2"]) * (1 - h * h)
            grad = {"w1": x.T @ gh + decay * p["w1"], "b1": gh.sum(0), "w2": h.T @ g + decay * p["w2"], "b2": g.sum(keepdims=True)}
            step += 1
            for key, v in grad.items():
                m[key] = 0.9 * m[key] + 0.1 * v
                s[key] = 0.999 * s[key] + 0.001 * v * v
                p[key] = p[key] - 2e-3 * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.999**step)) + 1e-7)
    return p


def _forward(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]


def best_bin_prior(pos_scores: np.ndarray, unl_scores: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails, with a confidence margin."""
    if not len(pos_scores) or not len(unl_scores):
        return 0.5
    cuts = np.unique(np.quantile(pos_scores, np.linspace(0, 0.98, 200)))
    qp = 1 - np.searchsorted(np.sort(pos_scores), cuts, side="left") / len(pos_scores)
    qu = 1 - np.searchsorted(np.sort(unl_scores), cuts, side="left") / len(unl_scores)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unl_scores)) + 1 / np.sqrt(len(pos_scores)))
    best = int(np.argmin((qu + margin) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, hidden: int = 24, epochs: int = 12, seed: int = 7) -> QualityModel:
    """Fit from feature rows. Without positives or unlabelled rows the score is the constant prior."""
    both = np.concatenate([pos, unl])
    if not len(pos) or not len(unl):
        prior = 0.99 if len(pos) else 0.5
        return QualityModel(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), float(np.log(prior / (1 - prior))), prior)
    mean, scale = both.mean(0), both.std(0) + 0.02
    zp, zu = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (pos, unl))
    # prior: plain fit on even rows, best bin on odd rows
    first = _train(zp[::2], zu[::2], 0.5, False, hidden, max(2, epochs // 3), seed)
    prior = best_bin_prior(_forward(first, zp[1::2] if len(zp) > 1 else zp), _forward(first, zu[1::2] if len(zu) > 1 else zu))
    p = _train(zp, zu, prior, True, hidden, epochs, seed + 1)
    return QualityModel(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), prior)


def training_rows(docs: DataFrame, labels: DataFrame, max_positives: int, max_unlabelled: int) -> DataFrame:
    """(positive, text): a bounded, repeatable sample of the training fold.

    Positives are rows labelled 1; unlabelled rows are those without a label or, in a table that has none,
    those not labelled 1. The sample takes the rows of least id hash, by a top-k in every task and then over
    all.
    """
    docs = docs.select("doc_id", "text")
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id").distinct()
    marked = ids.join(good, "doc_id", "left").withColumn("_h", F.xxhash64("doc_id", F.lit("quality")))
    pos = marked.where("_quality = 1").orderBy("_h", "doc_id").limit(max_positives).select("doc_id", F.lit(True).alias("positive"))
    rest = marked.where("_quality is null")
    rest = rest if rest.limit(1).count() else marked.where("_quality <> 1")
    unl = rest.orderBy("_h", "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # at most max_positives + max_unlabelled rows of two columns
    return docs.join(F.broadcast(pos.union(unl)), "doc_id").select("positive", "text")


def _feature_column(texts: pa.Array) -> pa.Array:
    x = features(texts.to_pylist())
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))


def fit_from_tables(docs: DataFrame, labels: DataFrame, max_positives: int = 8_000, max_unlabelled: int = 16_000) -> QualityModel:
    """Fit on at most ``max_positives`` labelled and ``max_unlabelled`` unlabelled rows outside the test fold.

    Features are computed in the tasks; the driver holds at most 24,000 rows of 181 floats (17 MB).
    """
    to_features = F.arrow_udf(_feature_column, "array<float>")
    rows = training_rows(docs, labels, max_positives, max_unlabelled).select("positive", to_features("text").alias("x")).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    flag = np.asarray(rows["positive"].to_pylist(), bool)
    order = np.lexsort([*x.T[:6], flag])  # the order of arrival does not matter
    x, flag = x[order], flag[order]
    rng = np.random.default_rng(3)
    mix = rng.permutation(len(x))
    x, flag = x[mix], flag[mix]
    return fit(x[flag], x[~flag])


def quality_score(model: QualityModel, text: Column | str = "text") -> Column:
    """Estimated probability of quality 1 for each whole text."""

    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.score(texts.slice(a, 500).to_pylist()) for a in range(0, len(texts), 500)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(scored, "double")(F.col(text) if isinstance(text, str) else text)


def with_quality(docs: DataFrame, model: QualityModel, out: str = "quality_score", text: str = "text") -> DataFrame:
    return docs.withColumn(out, quality_score(model, text))
