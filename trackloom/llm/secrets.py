"""Secret scan with inferred credential formats.

Three fixed patterns give the base spans. The credentials they find are the labelled strings from which
a probabilistic automaton per kind is inferred: a prefix tree of the strings whose states are merged
while their outgoing frequencies are statistically compatible (Hoeffding bounds, recursively over the
states below). Every long run of credential characters that no base span touches is then scored by its
log-likelihood under the best automaton against a character-pair model of all such runs in the corpus,
and added as a span of kind ``grammar`` if the format explains it clearly better.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, sorted by
start and then by kind; repeated rows get equal spans; without any labelled credential nothing is added;
an empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.session import cut_lineage

# fixed values: the base patterns, in the order of their kinds
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: A candidate: a run of credential characters; access keys and hex strings lie inside such runs.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CODE = {c: i for i, c in enumerate(ALPHABET)}
#: Probability left for characters that a state has never emitted.
FLOOR = 1e-4
PLACEHOLDER = "<redacted>"


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, kind, end), labelled credentials (kind, string), other runs (start, end, string)."""
    if not text:
        return [], [], []
    spans, strings, runs = [], [], []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= LEAST_VALUE:
            spans.append((m.start(), 0, m.end()))
            strings.append((0, m[1]))
    for run in RUN.finditer(text):
        a, token = run.start(), run[0]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(token):
                spans.append((a + m.start(), kind, a + m.end()))
                strings.append((kind, m[0]))
        runs.append((a, run.end(), token))
    spans.sort()
    return spans, strings, _untouched(runs, spans) if spans else runs


def _untouched(runs: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Runs that meet no span; both are sorted and walked side by side, so the time is linear."""
    covered: list[list[int]] = []  # spans as disjoint stretches
    for a, _, b in spans:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, k = [], 0
    for run in runs:
        while k < len(covered) and covered[k][1] <= run[0]:
            k += 1
        if k == len(covered) or covered[k][0] >= run[1]:
            out.append(run)
    return out


@dataclass(frozen=True)
class Automaton:
    """moves[state][char] = (next state, log probability); ends[state] = log probability of stopping."""

    moves: tuple[dict[str, tuple[int, float]], ...]
    ends: tuple[float, ...]

    def log_likelihood(self, token: str) -> float:
        state, total = 0, 0.0
        miss = math.log(FLOOR)
        for c in token:
            step = self.moves[state].get(c)
            if step is None:
                total += miss
            else:
                state, p = step
                total += p
        return total + self.ends[state]


def infer(strings: dict[str, int], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of the prefix tree of weighted strings, in breadth-first order."""
    moves: list[dict[str, int]] = [{}]
    flow: list[dict[str, int]] = [defaultdict(int)]  # how often each character leaves a state
    stop = [0]
    for word, n in sorted(strings.items()):
        s = 0
        for c in word:
            if c not in moves[s]:
                moves[s][c] = len(moves)
                moves.append({})
                flow.append(defaultdict(int))
                stop.append(0)
            flow[s][c] += n
            s = moves[s][c]
        stop[s] += n
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def visits(s: int) -> int:
        return stop[s] + sum(flow[s].values())

    def alike(x: int, nx: int, y: int, ny: int) -> bool:
        return abs(x / nx - y / ny) <= bound * (nx**-0.5 + ny**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            nx, ny = visits(x), visits(y)
            if not nx or not ny:
                continue
            if not alike(stop[x], nx, stop[y], ny):
                return False
            for c in flow[x].keys() | flow[y].keys():
                if not alike(flow[x].get(c, 0), nx, flow[y].get(c, 0), ny):
                    return False
                if c in moves[x] and c in moves[y]:
                    todo.append((moves[x][c], moves[y][c]))
        return True

    def absorb(a: int, b: int) -> None:
        """Add the tree below b into a, keeping the automaton deterministic."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            stop[x] += stop[y]
            for c, n in flow[y].items():
                flow[x][c] += n
                if c in moves[x]:
                    todo.append((moves[x][c], moves[y][c]))
                else:
                    moves[x][c] = moves[y][c]

    kept = [0]
    settled = {0}
    while True:
        frontier = [(s, c) for s in kept for c in sorted(moves[s]) if moves[s][c] not in settled]
        if not frontier:
            break
        s, c = frontier[0]
        young = moves[s][c]
        for old in kept:
            if compatible(old, young):
                moves[s][c] = old
                absorb(old, young)
                break
        else:
            kept.append(young)
            settled.add(young)
    number = {s: i for i, s in enumerate(kept)}
    out, ends = [], []
    for s in kept:
        n = visits(s) or 1
        out.append({c: (number[t], math.log(max((1 - FLOOR) * flow[s][c] / n, FLOOR))) for c, t in moves[s].items()})
        ends.append(math.log(max(stop[s] / n, FLOOR)))
    return Automaton(tuple(out), tuple(ends))


@dataclass(frozen=True)
class FormatModel:
    automata: tuple[Automaton, ...]
    pairs: np.ndarray  # log probability of a character after another in ordinary runs
    least_total: float = 12.0
    least_mean: float = 0.5

    def gain(self, token: str) -> float:
        """Best log-likelihood ratio of a format against ordinary runs; zero if there is no format."""
        if not self.automata:
            return 0.0
        codes = np.fromiter((_CODE[c] for c in token), np.intp, len(token))
        plain = float(self.pairs[codes[:-1], codes[1:]].sum()) + math.log(1 / len(ALPHABET))
        return max(a.log_likelihood(token) for a in self.automata) - plain

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """Base and added spans (start, kind, end)."""
        base, _, runs = scan(text)
        added = []
        for a, b, token in runs:
            g = self.gain(token)
            if g >= self.least_total and g >= self.least_mean * len(token):
                added.append((a, 3, b))
        return sorted(base + added) if added else base

    def redact(self, text: str | None) -> str | None:
        found = self.spans(text)
        if not found:
            return text
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [text[at:a], PLACEHOLDER]
            at = max(at, b)
        return "".join(out) + text[at:]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n): credentials by kind, and character pairs of ordinary runs under kind -1."""
    for b in batches:
        found: Counter[tuple[int, str]] = Counter()
        for text in b["text"].to_pylist():
            _, strings, runs = scan(text)
            found.update(strings)
            for _, _, token in runs:
                found.update([(-1, x + y) for x, y in zip(token, token[1:])])
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([t for _, t in keys]), pa.array([found[k] for k in keys], pa.int64())], ["kind", "token", "n"]
        )


def fit_formats(docs: DataFrame, max_strings: int = 500, text: str = "text") -> FormatModel:
    """Infer one automaton per base kind from at most ``max_strings`` distinct credentials of it.

    All documents are surveyed. The driver gets the sampled credentials (those of least hash) and at
    most 66 x 66 pair counts.
    """
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_survey, "kind int, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    pairs = np.full((len(ALPHABET), len(ALPHABET)), 0.5)
    for r in counted.where("kind = -1").toArrow().to_pylist():
        pairs[_CODE[r["token"][0]], _CODE[r["token"][1]]] += r["n"]
    automata = []
    for kind in range(3):
        rows = counted.where(F.col("kind") == kind).orderBy(F.xxhash64("token"), "token").limit(max_strings).select("token").toArrow()["token"].to_pylist()
        if rows:
            automata.append(infer(dict.fromkeys(rows, 1)))
    return FormatModel(tuple(automata), np.log(pairs / pairs.sum(1, keepdims=True)))


SPANS = "array<struct<kind:int,start:int,end:int>>"


def secret_spans(model: FormatModel, text: Column | str = "text") -> Column:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in model.spans(t)] for t in texts.to_pylist()], kind)

    return F.arrow_udf(find, SPANS)(F.col(text) if isinstance(text, str) else text)


def redacted(model: FormatModel, text: Column | str = "text") -> Column:
    """The text with every span replaced by a fixed placeholder."""
    return F.arrow_udf(lambda texts: pa.array([model.redact(t) for t in texts.to_pylist()], pa.string()), "string")(F.col(text) if isinstance(text, str) else text)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; the spans are sorted already."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
