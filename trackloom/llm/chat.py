"""Chat formatting by incremental rendering of a black box.

A template is any function from a list of (role, text) to a string. Rendering every prefix of a
conversation and comparing consecutive outputs locates each turn's span: what prefix k adds to prefix
k-1. Rendering the last turn with two different probe texts locates the text inside its span. A prefix
that does not begin with the one before it shows that the template rewrites history: the turn is
reported, the spans before the first changed character stay, and the later ones are unknown.

A template given as :class:`Incremental`, a state and what the next turn adds, cannot rewrite history.
Its conversations are rendered in pieces of at most ``PIECE`` turns that start from the state so far, so a
task holds one piece, whatever the conversation's length. Any other function may look at every turn: it is
given the true whole prefixes, and a conversation is one piece, which a task holds whole and renders three
times for each of its turns. Rows stream in order after one shuffle by conversation. The digest of a
conversation's turns is a running hash, hence sequential.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, and
repeated rows are turns of their own; rows with a null id form one conversation; an empty table gives an
empty result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Message = tuple[str, str]
Render = Callable[[list[Message]], str]

PIECE = 64
END = "</turn>\n"
TITLES = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
_ROLE = {v: k for k, v in TITLES.items()}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break the control strings: every # and the slash of a closing mark get a backslash, which is itself doubled."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return TITLES.get(role) or "### role=" + escape(role).replace(":", "\\:") + ": "


def role_of(head: str) -> str:
    return _ROLE[head] if head in _ROLE else unescape(head[len("### role=") : -2])


@dataclass(frozen=True)
class Incremental:
    """A template that only appends: ``step(state, message)`` gives what the turn adds, and the next state.

    The state says all that later turns need of the earlier ones; it should not grow with them.
    """

    step: Callable[[Any, Message], tuple[str, Any]]
    start: Any = None

    def __call__(self, messages: list[Message]) -> str:
        return self.run(self.start, messages)[0]

    def run(self, state: Any, messages: list[Message]) -> tuple[str, Any]:
        """(what the messages add after the state, state after them)."""
        out = []
        for m in messages:
            added, state = self.step(state, m)
            out.append(added)
        return "".join(out), state


def _marked_turn(state: None, message: Message) -> tuple[str, None]:
    role, text = message
    return header(role) + escape(text) + END, None


#: The default template: a marked header, the escaped text and a closing mark for each turn.
marked = Incremental(_marked_turn)


@dataclass(frozen=True)
class Span:
    """A turn's place in the output: the whole of it, and its text. None where history was rewritten."""

    start: int | None
    end: int | None
    text_start: int | None
    text_end: int | None


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def locate(render: Render, messages: list[Message], known: int = 0, probes: tuple[str, str] = ("q", "Z")) -> tuple[str, list[Span], list[int]]:
    """(output, span of each message after the first ``known``, messages at which history was rewritten)."""
    out = before = render(messages[:known])
    spans: list[Span] = []
    rewritten: list[int] = []
    for k in range(known, len(messages)):
        out = render(messages[: k + 1])
        if not out.startswith(before):
            rewritten.append(k)
            same = _common(before, out)
            spans = [s if s.end is not None and s.end <= same else Span(None, None, None, None) for s in spans]
            spans.append(Span(None, None, None, None))
        else:
            role = messages[k][0]
            one, two = (render([*messages[:k], (role, p)]) for p in probes)
            head = _common(one, two)
            tail = _common(one[::-1], two[::-1])
            spans.append(Span(len(before), len(out), head, max(head, len(out) - tail)))
        before = out
    return out, spans, rewritten


PIECES = (
    "conv_id long, piece int, formatted string, rewritten array<int>, "
    "turns array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"
)
_TURN = pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end"))])
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("rewritten", pa.list_(pa.int32())), ("turns", pa.list_(_TURN))])


def _pieces(rows: Iterator[tuple[int | None, str, str]], render: Render, size: int) -> Iterator[dict]:
    """One record per piece from rows in order; only an incremental template is cut into pieces."""
    cut = isinstance(render, Incremental)

    def finish(conv, number, state, part) -> dict:
        out, spans, rewritten = locate((lambda m: render.run(state, m)[0]) if cut else render, part)
        turns = [{"role": m[0], "start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end} for m, s in zip(part, spans)]
        return {"conv_id": conv, "piece": number, "formatted": out, "rewritten": [k + number * size for k in rewritten], "turns": turns}

    first = render.start if cut else None
    at, number, state, part, open_ = None, 0, first, [], False
    for conv, role, text in rows:
        if not open_ or conv != at:
            if open_:
                yield finish(at, number, state, part)
            at, number, state, part, open_ = conv, 0, first, [], True
        elif cut and len(part) == size:
            yield finish(at, number, state, part)
            number, state, part = number + 1, render.run(state, part)[1], []
        part.append((role, text))
    if open_:
        yield finish(at, number, state, part)


def format_conversations(conversations: DataFrame, render: Render = marked, size: int = PIECE) -> DataFrame:
    """Formatted pieces with the span of every turn, in order within a conversation.

    Pieces hold ``size`` turns if ``render`` is :class:`Incremental`, else a whole conversation.
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()))
        yield from _batched(_pieces(stream, render, size), _PIECES, lambda x: len(x["formatted"]))

    return rows.mapInArrow(run, PIECES)


def _batched(records: Iterator[dict], schema: pa.Schema, weight: Callable[[dict], int], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += weight(r) + 200
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewritten long"
_DIGESTS = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewritten")])


def read_back(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """Digests of each conversation, parsed from the formatted text and the loss mask alone.

    ``formatted`` comes from :func:`format_conversations`, whose pieces follow each other in a partition.
    """

    def records(rows: Iterator[dict]) -> Iterator[dict]:
        at, state = None, None
        for r in rows:
            if state is None or r["conv_id"] != at or r["piece"] == 0:
                if state is not None:
                    yield state.close()
                at, state = r["conv_id"], _Digest(r["conv_id"], trained)
            state.add(r["formatted"], r["turns"], len(r["rewritten"]))
        if state is not None:
            yield state.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(records(r for b in batches for r in b.to_pylist()), _DIGESTS, lambda x: 0)

    return formatted.mapInArrow(run, DIGESTS)


class _Digest:
    def __init__(self, conv: int | None, trained: str) -> None:
        self.conv, self.trained = conv, trained
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.rewritten = 0

    def add(self, formatted: str, turns: list[dict], rewritten: int) -> None:
        self.chars += len(formatted)
        self.rewritten += rewritten
        for t in turns:
            self.n += 1
            if t["start"] is None:
                continue
            role = role_of(formatted[t["start"] : t["text_start"]])
            text = unescape(formatted[t["text_start"] : t["text_end"]])
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == self.trained:
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def close(self) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "n_rewritten": self.rewritten,
        }
