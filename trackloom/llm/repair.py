"""Structure repair of conversations: the cheapest edits after which roles read ``(system? (user assistant)+)?``.

Rows of a conversation and the states of that pattern span a lattice. Keeping, re-roling or deleting a row
leads to the next row, inserting an empty turn stays before it; all costs are whole numbers. The cheapest
way is found by an auction: every node has a price, at most the cost of each arc plus the price at its end.
A path grows from the origin along arcs that meet its last node's price; where none does, the price rises
to the best arc and the path gives that node up. When it reaches the end, prices along it are the exact
costs to go, every cheapest way runs over tight arcs (cost = price difference), and the least string of
edits is read off by walking tight arcs that lead to the end, in letter order.

A conversation is solved in segments of 64 rows, from its last to its first: the prices at the head of a
segment are the exit costs of the one before. Segments bound the auction's work, which may grow with the
square of a lattice's length. Rows reach the auction as a role initial, a fault and the digest of their
text; whole texts are shuffled once, to be edited. One conversation is one stream, sorted by Spark: a task
holds one segment and the edits of the conversation (some ten bytes a row).

Defined results: a null role or text is one space (a blank row); rows are taken by turn, nulls first, then
by role and by the MD5 digest of the text; a null conv_id is a conversation; repeated rows are duplicates;
an empty role fits no place of the pattern; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\f\r"
#: Rows of one lattice.
SEGMENT = 64
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
KEEPABLE, BLANK, DUPLICATE, TRUNCATED = range(4)

# states of the role pattern: nothing yet, after system, after user, after assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """Reproducible faults by crc32 of ``conv_id:turn`` modulo 20; lost rows stay, with ``lost`` set."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(one("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text")).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _read(rows: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role"), one("text"), lost.alias("lost"))
    return read.withColumn("digest", F.md5("text"))


_PLAN = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_edits(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of every conversation of (conv_id, turn, role, text[, lost]).

    ``audit`` has one letter per edit in order: Keep, Rerole, Delete, Insert. Rows marked ``lost`` only name
    their conversation. ``gaps`` counts turn numbers missing between the first and the last.
    """
    read = _read(rows)
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), KEEPABLE).otherwise(TRUNCATED)
    light = read.select("conv_id", "turn", "role", "digest", "lost", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    # the first turn of each role and text; nulls come first in a struct
    first = light.where("not lost").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], F.col("_first.turn").alias("_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "digest")]
    later = F.coalesce(F.col("turn") > F.col("_turn"), F.col("turn").isNotNull() & F.col("_turn").isNull())
    known = light.join(first, same, "left").withColumn("later", later).drop("_conv_id", "_role", "_digest", "_turn")
    back = [F.asc_nulls_first("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest")]
    columns = ["conv_id", "turn", "role", "digest", "lost", "initial", "fault", "later"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Plan | None = None
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in columns)):
                if at is None or at.conv != row[0]:
                    if at is not None:
                        out.append(at.close())
                    at = _Plan(row[0])
                at.add(*row[1:])
            if len(out) >= 1_000:
                yield _batch(out, _PLAN)
                out = []
        if at is not None:
            out.append(at.close())
        yield _batch(out, _PLAN)

    return known.select(columns).repartition("conv_id").sortWithinPartitions(*back).mapInArrow(run, _PLAN)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)


class _Plan:
    """A conversation read from its last row to its first."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.counts = [0, 0, 0, 0]
        self.turns = self.illegal = 0
        self.low = self.high = None
        self.held: tuple | None = None  # a row waits for the one before it, which may be its equal
        self.segment: list[tuple[str, int]] = []
        self.exits: list[int] | None = None
        self.ways: list[list[tuple[str, int] | None]] = []

    def add(self, turn: int | None, role: str, digest: str, lost: bool, initial: str, fault: int, later: bool) -> None:
        if lost:
            return
        if turn is not None and turn != self.low:
            self.turns += 1
            self.low = turn
            self.high = turn if self.high is None else self.high
        if self.held:
            self._take(self.held[:3] == (turn, role, digest))
            self.illegal += initial + self.held[3] not in ("su", "ua", "au")
        self.held = (turn, role, digest, initial, fault, later)

    def _take(self, repeated: bool) -> None:
        _, _, _, initial, fault, later = self.held
        if fault != BLANK and (later or repeated):
            fault = DUPLICATE
        self.counts[fault] += 1
        if len(self.segment) == SEGMENT:
            self._solve(range(4))
        self.segment.append((initial, fault))

    def _solve(self, entries) -> None:
        self.exits, ways = solve(self.segment[::-1], self.exits, entries)
        self.ways.append(ways)
        self.segment = []

    def close(self) -> tuple:
        if self.held:
            self._take(False)
            self._solve([_START])
        audit, state = [], _START
        for ways in reversed(self.ways):
            letters, state = ways[state]
            audit.append(letters)
        n = sum(self.counts)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, n, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.exits[_START] if n else 0, "".join(audit)


def solve(rows: list[tuple[str, int]], exits: list[int] | None, entries) -> tuple[list[int], list[tuple[str, int] | None]]:
    """Auction over the lattice of some rows (initial, fault).

    ``exits`` are the costs beyond the last row by state, None at the end of a conversation. Gives the cost
    from each entry state and, for it, the least edits and the state in which they leave.
    """
    m = len(rows)
    end = 4 * (m + 1)
    arcs: list[list[tuple[str, int, int]]] = []  # letter, cost and end of the arcs of node 4 * row + state, by letter
    for i, (initial, fault) in enumerate(rows):
        for q in range(4):
            out = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + _NEXT[q])]
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF * (fault == TRUNCATED)
                kept = _KEEP.get((q, initial))
                if kept is not None:
                    out.append(("K", more, 4 * i + 4 + kept))
                out.append(("R", REROLE + more, 4 * i + 4 + _NEXT[q]))
            arcs.append(out)
    for q in range(4):  # behind the last row; only there a conversation may end, and inserts belong to the row they precede
        out = [("", exits[q], end)] if exits else [("I", INSERT, 4 * m + _NEXT[q])]
        if not exits and q in (_START, _ASSISTANT):
            out.insert(0, ("", 0, end))
        arcs.append(out)
    # first prices: what the rows cost whatever their roles, which no way can undercut
    price = [0] * (end + 1)
    least = min(exits) if exits else 0
    price[4 * m : end] = [least] * 4
    for i in range(m - 1, -1, -1):
        least += DELETE if rows[i][1] else 0
        price[4 * i : 4 * i + 4] = [least] * 4
    for q in entries:
        path = [q]
        while path[-1] != end:
            node = path[-1]
            best, step = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(step)
    # nodes from which tight arcs lead to the end
    alive = [False] * end + [True]
    for i in range(m, -1, -1):
        for _ in range(3):  # an insert may lead to a state of the same row
            for node in range(4 * i, 4 * i + 4):
                alive[node] = alive[node] or any(alive[to] and price[node] == cost + price[to] for _, cost, to in arcs[node])
    ways: list[tuple[str, int] | None] = [None] * 4
    for q in entries:
        letters, node = [], q
        while node != end:
            letter, last = next((a, to) for a, cost, to in arcs[node] if alive[to] and price[node] == cost + price[to])
            letters.append(letter)
            if last == end:
                ways[q] = ("".join(letters), node - 4 * m)
            node = last
    return price[:4], ways


_REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows that the edits leave: (conv_id, place, edit, role, text), places from 0; deleted rows are gone."""
    read = _read(rows).where("not lost").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    null = lambda t: F.lit(None).cast(t)
    heads = plans.where("audit <> ''").select("conv_id", F.lit(0).alias("kind"), null("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"))
    order = [F.asc_nulls_first("conv_id"), F.asc("kind"), F.asc_nulls_first("turn"), "role", "digest"]
    both = heads.unionByName(read).repartition("conv_id").sortWithinPartitions(*order)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, tail, k, place, state = None, "", 0, 0, 0, _START
        for b in batches:
            for c, kind, role, text in zip(*(b[n].to_pylist() for n in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    conv, audit, tail, k, place, state = c, text, len(text.rstrip("I")), 0, 0, _START
                    continue
                own = False  # inserts before this row, then its own edit, then inserts behind the last row
                while k < len(audit) and (not own or k >= tail):
                    edit, own = audit[k], own or audit[k] != "I"
                    k += 1
                    if edit != "D":
                        state = _KEEP[state, role[:1]] if edit == "K" else _NEXT[state]
                        yield conv, place, edit, role if edit == "K" else _NAMES[state], "" if edit == "I" else text
                        place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for row in turns(batches):
            out.append(row)
            chars += len(row[4]) + 50
            if chars > 8_000_000:
                yield _batch(out, _REPAIRED)
                out, chars = [], 0
        yield _batch(out, _REPAIRED)

    return both.select("conv_id", "kind", "role", "text").mapInArrow(run, _REPAIRED)


_DIGEST = "conv_id long, repaired_sha256 string"


def turn_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of a conversation's turns by place, joined by newlines; a running hash, no text is held."""
    sorted_turns = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for b in batches:
            for c, place, role, text in zip(*(b[n].to_pylist() for n in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
        if digest:
            out.append((conv, digest.hexdigest()))
        yield _batch(out, _DIGEST)

    return sorted_turns.mapInArrow(run, _DIGEST)


def with_digest(plans: DataFrame, digests: DataFrame) -> DataFrame:
    """Plans next to the digest of their repaired turns; none left is the digest of nothing."""
    found = digests.withColumnRenamed("conv_id", "_conv")
    empty: Column = F.lit(hashlib.sha256().hexdigest())
    return plans.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
