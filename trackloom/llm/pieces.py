"""Sentence pieces: N-best encoding over the piece lattice, and exact decoding.

A forward Viterbi pass gives the best score of reaching every position. These scores are exact
heuristics for an A* search that walks the lattice backwards from its end, so complete segmentations
leave the heap best first and the first N are the N best.

No piece of the vocabulary spans a change between letters, other characters and leading spaces (the few
that do are checked for, and a text that holds one is cut at spaces only). The lattice of a text thus
falls into chunks at which all its paths meet, and the N best of the text are those of the sum over its
chunks. The forward pass runs over the new chunks of many texts at once, position by position, and
carries the two best scores, so it also gives what a chunk's second best loses. At most N-1 chunks can
differ from their best in any of the N results, those that lose least: only they are searched.

Spaces are written as the vocabulary's space mark and a text gets one leading space, as its model does.
Characters without a piece, and the space mark itself, are spelt in byte pieces, so that decoding gives
back every text exactly.

The vocabulary's stored scores are ranks, not log-probabilities: a piece of rank r is scored
-log(r + 2), a fixed law of word frequencies. A vocabulary with log-probabilities is used as stored.

Defined results: null and empty texts have no pieces and one segmentation of score 0; ties go to the
segmentation that uses longer pieces later; texts of any length are encoded whole; an empty table gives
an empty result; other columns are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Where the cluster's machines hold the public vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(r" *(?:[^\W\d_]+|(?:[^\w ]|[\d_])+)| +")
BY_SPACE = re.compile(r" *[^ ]+| +")
#: Chunks that a worker remembers; the memory is emptied when full.
REMEMBERED = 150_000
#: Characters of the texts that are encoded together.
GROUP = 1_000_000
#: Chunks of one forward pass; bounds its working arrays (some 50 MB).
AT_ONCE = 20_000
#: Fixed odd multipliers of the string hash and its spread over 2**_SLOTS chains.
_MULTIPLIER, _SPREAD, _SLOTS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 19


def _room(column: np.ndarray, used: int, more: int) -> np.ndarray:
    """The column, or a longer copy with room for ``more`` entries."""
    if used + more <= len(column):
        return column
    out = np.zeros(max(used + more, 2 * len(column)), column.dtype)
    out[:used] = column[:used]
    return out


class Lattice:
    """The vocabulary, and the chunks searched so far."""

    def __init__(self, path: str, n_best: int) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i).replace(MARK, " ") for i in usable}
        stored = np.array([model.get_score(i) for i in usable])
        ranked = len(stored) > 1 and bool((stored <= 0).all() and stored.min() < -1000)
        scores = -np.log(2.0 - stored.clip(-1e6, 0)) if ranked else stored
        self.piece = {text[i]: (float(s), i) for i, s in zip(usable, scores)}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_score = float(scores.min()) - 10.0
        self.longest = max(map(len, self.piece))
        self.spell = [b""] * size
        for i in usable:
            self.spell[i] = text[i].encode()
        for b, i in self.byte.items():
            self.spell[i] = bytes([b])
        odd = [p for p in self.piece if len(CHUNK.findall(p)) > 1]
        self.crossing = re.compile("|".join(map(re.escape, odd))) if odd else None
        self.n_best = n_best
        self._index()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.score = np.zeros(1 << 14)
        self.gap = np.zeros(1 << 14)
        self.other: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def _index(self) -> None:
        """Hash chains over every beginning of a piece: rank -1 marks one that is no piece itself."""
        begins: dict[str, int] = {}
        for p, (_, i) in self.piece.items():
            for k in range(1, len(p)):
                begins.setdefault(p[:k], -1)
            begins[p] = i
        self.key = np.zeros(len(begins), np.uint64)
        for n, p in enumerate(begins):
            h = 0
            for c in p:
                h = (h * _MULTIPLIER + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.key[n] = h
        self.rank = np.fromiter(begins.values(), np.int64, len(begins))
        self.by_rank = np.zeros(len(self.spell))
        for _, (score, i) in self.piece.items():
            self.by_rank[i] = score
        slot = (self.key * np.uint64(_SPREAD)) >> np.uint64(64 - _SLOTS)
        self.head = np.full(1 << _SLOTS, -1, np.int32)
        self.next = np.full(len(begins), -1, np.int32)
        for n, at in enumerate(slot.tolist()):
            self.next[n], self.head[at] = self.head[at], n

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the beginnings, or -1."""
        at = self.head[(h * np.uint64(_SPREAD)) >> np.uint64(64 - _SLOTS)]
        out = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            cur = at[todo]
            same = self.key[cur] == h[todo]
            out[todo[same]] = cur[same]
            todo = todo[~same]
            at[todo] = self.next[at[todo]]
            todo = todo[at[todo] >= 0]
        return out

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """edges[j]: (start, score, ids) of the pieces that end at j."""
        n, get = len(chunk), self.piece.get
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
        for j in range(1, n + 1):
            ending = [(i, hit[0], (hit[1],)) for i in range(max(0, j - self.longest), j) if (hit := get(chunk[i:j]))]
            if not ending or ending[-1][0] != j - 1:
                raw = chunk[j - 1].encode()
                ending.append((j - 1, self.byte_score * len(raw), tuple(self.byte[b] for b in raw)))
            out.append(ending)
        return out

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a chunk, best first."""
        edges = self.edges(chunk)
        reach = [0.0]
        for j in range(1, len(edges)):
            reach.append(max(reach[i] + s for i, s, _ in edges[j]))
        heap = [(-reach[-1], 0, len(chunk), 0.0, None)]
        found, serial = [], 0
        while heap and len(found) < n:
            _, _, at, tail, path = heapq.heappop(heap)
            while at:  # walk on along the best edge, and put the others aside
                best = None
                for i, s, ids in edges[at]:
                    f = reach[i] + s + tail
                    if best is None or f > best[0]:
                        if best is not None:
                            serial += 1
                            heapq.heappush(heap, (-best[0], serial, best[1], best[2], best[3]))
                        best = (f, i, s + tail, (ids, path))
                    else:
                        serial += 1
                        heapq.heappush(heap, (-f, serial, i, s + tail, (ids, path)))
                _, at, tail, path = best
            ids = []
            node = path
            while node is not None:
                ids.extend(node[0])
                node = node[1]
            found.append((tail, tuple(ids)))
        return found

    def learn(self, chunks: list[str]) -> None:
        """Forward pass over many chunks: best ids and score of each, and the loss of its second best."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        cps = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        begin = np.cumsum(sizes) - sizes
        local = np.arange(len(cps)) - begin[chunk_of]
        left = sizes[chunk_of] - local
        node = np.arange(len(cps)) + chunk_of  # a chunk of n characters has n + 1 nodes
        starts, ends, scores, ranks = [], [], [], []
        alive, h = np.arange(len(cps)), np.zeros(len(cps), np.uint64)
        single = np.zeros(len(cps), bool)
        for k in range(1, self.longest + 1):
            fits = left[alive] >= k
            alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            h = h * np.uint64(_MULTIPLIER) + cps[alive + k - 1] + np.uint64(1)
            hit = self._find(h)
            on = hit >= 0
            alive, h, hit = alive[on], h[on], hit[on]
            rank = self.rank[hit]
            whole = rank >= 0
            at = alive[whole]
            if k == 1:
                single[at] = True
            starts.append(node[at])
            ends.append(node[at] + k)
            ranks.append(rank[whole])
            scores.append(self.by_rank[rank[whole]])
        bare = np.flatnonzero(~single)
        if len(bare):  # no piece of this one character: bytes, kept as a negative code point
            cp = cps[bare].astype(np.int64)
            width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
            starts.append(node[bare])
            ends.append(node[bare] + 1)
            ranks.append(-1 - cp)
            scores.append(self.byte_score * width)
        start, end, score, rank = map(np.concatenate, (starts, ends, scores, ranks))
        total = len(cps) + len(chunks)
        depth = np.zeros(total, np.int64)
        depth[node + 1] = local + 1
        order = np.lexsort((start, end, depth[end]))
        start, end, score, rank = start[order], end[order], score[order], rank[order]
        best, second = np.zeros(total), np.full(total, -np.inf)
        back = np.full(total, -1, np.int64)
        depths = depth[end]
        top = int(depths[-1]) if len(depths) else 0
        cuts = np.searchsorted(depths, np.arange(1, top + 2))
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            e = end[a:b]
            lead = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            one = best[start[a:b]] + score[a:b]
            two = second[start[a:b]] + score[a:b]
            peak = np.maximum.reduceat(one, lead)
            spans = np.diff(np.append(lead, b - a))
            equal = np.flatnonzero(one == np.repeat(peak, spans))
            owner = e[equal]
            firsts = equal[np.concatenate([[True], owner[1:] != owner[:-1]])]
            one[firsts] = -np.inf
            nodes = e[lead]
            best[nodes] = peak
            second[nodes] = np.maximum(np.maximum.reduceat(one, lead), np.maximum.reduceat(two, lead))
            back[nodes] = firsts + a
        final = begin + np.arange(len(chunks)) + sizes
        self._store(chunks, best[final], best[final] - second[final], final, begin + np.arange(len(chunks)), back, start, rank)

    def _store(self, chunks, score, gap, cur, stop, back, start, rank) -> None:
        steps, owners, codes = [], [], []
        open_ = np.flatnonzero(cur > stop)
        step = 0
        while len(open_):
            e = back[cur[open_]]
            owners.append(open_)
            codes.append(rank[e])
            steps.append(np.full(len(open_), -step))
            cur[open_] = start[e]
            open_ = open_[cur[open_] > stop[open_]]
            step += 1
        owner, code, step = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, codes, steps))
        order = np.lexsort((step, owner))
        owner, code = owner[order], code[order]
        raw = np.flatnonzero(code < 0)
        if len(raw):
            spelt = {int(c): [self.byte[b] for b in chr(-1 - int(c)).encode()] for c in np.unique(code[raw])}
            count = np.ones(len(code), np.int64)
            count[raw] = [len(spelt[c]) for c in code[raw].tolist()]
            wide = np.repeat(code, count)
            at = np.cumsum(count) - count
            for i, c in zip(at[raw].tolist(), code[raw].tolist()):
                wide[i : i + len(spelt[c])] = spelt[c]
            owner, code = np.repeat(owner, count), wide
        size = np.bincount(owner, minlength=len(chunks))
        k, m = len(self.known), len(chunks)
        self.flat = _room(self.flat, self.used, len(code))
        self.flat[self.used : self.used + len(code)] = code
        for name, value in (("first", self.used + np.cumsum(size) - size), ("size", size), ("score", score), ("gap", np.maximum(gap, 0))):
            column = _room(getattr(self, name), k, m)
            column[k : k + m] = value
            setattr(self, name, column)
        self.used += len(code)
        self.known.update(zip(chunks, range(k, k + m)))

    def chunks(self, text: str) -> list[str]:
        whole = " " + text
        return (BY_SPACE if self.crossing and self.crossing.search(whole) else CHUNK).findall(whole)

    def encode_many(self, texts: list[str | None]):
        """For each text (ids, score, [(loss, [(at, drop, ids), ...]), ...]): the best, and the others as edits of it."""
        todo, size = [], 0
        for t in texts:
            todo.append(t)
            size += len(t or "")
            if size >= GROUP:
                yield from self._encode_group(todo)
                todo, size = [], 0
        yield from self._encode_group(todo)

    def _encode_group(self, texts: list[str | None]):
        parts = [self.chunks(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(parts)) - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED and self.known:
            self.forget()
            fresh = set(chain.from_iterable(parts))
        new = sorted(fresh)
        for a in range(0, len(new), AT_ONCE):
            self.learn(new[a : a + AT_ONCE])
        get = self.known.__getitem__
        for own in parts:
            if not own:
                yield np.zeros(0, np.int32), 0.0, []
                continue
            at = np.fromiter(map(get, own), np.int64, len(own))
            size = self.size[at].astype(np.int64)
            ends = np.cumsum(size)
            ids = self.flat[np.arange(ends[-1]) + np.repeat(self.first[at] - (ends - size), size)]
            yield ids, float(self.score[at].sum()), self._others(own, self.gap[at], size)

    def encode(self, text: str | None):
        return next(iter(self._encode_group([text])))

    def _others(self, parts: list[str], gap: np.ndarray, size: np.ndarray):
        n = self.n_best
        if n < 2:
            return []
        order = np.flatnonzero(np.isfinite(gap))
        if len(order) > n - 1:
            limit = np.partition(gap[order], n - 2)[n - 2]
            below = order[gap[order] < limit]
            order = np.sort(np.concatenate([below, order[gap[order] == limit][: n - 1 - len(below)]]))
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for p in order.tolist():
            alternatives = self._alternatives(parts[p])
            base = alternatives[0][0]
            combos = sorted(
                ((loss + base - s, edits if k == 0 else (*edits, (p, ids))) for loss, edits in combos for k, (s, ids) in enumerate(alternatives)),
                key=lambda c: c[0],
            )[:n]
        starts = None
        out = []
        for loss, edits in combos[1:]:
            if starts is None:
                starts = np.concatenate([[0], np.cumsum(size)])
            out.append((loss, [(int(starts[p]), int(size[p]), list(ids)) for p, ids in edits]))
        return out

    def _alternatives(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        got = self.other.get(chunk)
        if got is None:
            if len(self.other) >= 5_000:
                self.other.clear()
            k = self.known[chunk]
            ids = tuple(self.flat[self.first[k] : self.first[k] + self.size[k]].tolist())
            rest = [x for x in self.search(chunk, self.n_best) if x[1] != ids]
            got = self.other[chunk] = [(float(self.score[k]), ids), *rest][: self.n_best]
        return got

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def lattice(path: str, n_best: int) -> Lattice:
    """One per worker process."""
    return Lattice(path, n_best)


EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
OTHER = pa.struct([("loss", pa.float64()), ("edits", pa.list_(EDIT))])
ENCODED = "ids array<int>, score double, round_trip boolean, others array<struct<loss:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"
#: Rows encoded and given out together.
ROWS = 500


def encode(df: DataFrame, text: str = "text", n_best: int = 4, path: str = VOCABULARY, prefix: str = "") -> DataFrame:
    """Add ids and score of the best segmentation, and the next ones as edits of it with their loss of score.

    ``round_trip`` tells whether decoding the ids gave back the text; it is done beside the encoding, for
    a second Python step would double the worker processes of a task. Results leave the task in small
    batches, and what a worker remembers is dropped at the end of its task. Columns of the same names
    are replaced.
    """
    added = [(prefix + f.split()[0], f.split(maxsplit=1)[1]) for f in ENCODED.split(", ")]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {n for n, _ in added}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(path, n_best)
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    yield pa.RecordBatch.from_arrays([*part.columns, *_encoded(tool, part[text].to_pylist())], [*part.schema.names, *(n for n, _ in added)])
        finally:
            tool.forget()

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in added)).fields])
    return kept.mapInArrow(run, schema)


def _encoded(tool: Lattice, rows: list[str | None]) -> list[pa.Array]:
    flat, ends, scores, same, others = [], [0], [], [], []
    for text, (ids, score, rest) in zip(rows, tool.encode_many(rows)):
        flat.append(ids)
        same.append(tool.decode(ids.tolist()) == (text or ""))
        ends.append(ends[-1] + len(ids))
        scores.append(score)
        others.append([{"loss": loss, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in edits]} for loss, edits in rest])
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return [lists, pa.array(scores, pa.float64()), pa.array(same, pa.bool_()), pa.array(others, pa.list_(OTHER))]


def decoded(ids: Column | str = "ids", path: str = VOCABULARY) -> Column:
    """The text of the pieces; no pieces give the empty text."""

    def run(rows: pa.Array) -> pa.Array:
        tool = lattice(path, 1)
        values = rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], rows.value_lengths().fill_null(0).to_numpy()]))
        return pa.array([tool.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    return F.arrow_udf(run, "string")(F.col(ids) if isinstance(ids, str) else ids)
