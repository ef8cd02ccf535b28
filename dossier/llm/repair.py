"""Conversation structure repair by a dynamic program over persistent audits.

A conversation's turns are edited so that the roles read (s?(ua)+)?: kept, given the other role, deleted, or turns are inserted. States are what may come next; of each
state the cheapest audit (the edits' initials) is kept. Audits are linked nodes that share their prefixes; each node has its ancestors at distances 1, 2, 4 ...
and a rolling hash, and of two equally dear audits the least is told by a search for their longest common prefix, which is then verified.
Two audits of one state and equal cost have met as many turns, and each insertion costs, so that none is the other's beginning and the least prefix stays the least.

Turns are numbered by a range sort, and chunks of at most CHUNK turns give the cheapest audit between each two states; these are joined along each conversation, so that
a conversation of any length is worked on by many tasks. What passes one task for each conversation is its chunks' audits, a letter a turn, as the result holds them in
one row, and the stream of its repaired turns, as one hash over all of them is asked for; neither is held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: Turns that one task works on at a time.
CHUNK = 4096
#: Costs of the edits, and of a turn that stays though it breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: States: at the start, after the system turn, after a user turn, after an assistant turn. The roles may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State after a user or assistant turn was put in, by the state before.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BASE, MOD = 1_000_003, (1 << 61) - 1


class Node:
    """An audit: its parent's with a piece added. up holds the ancestors at distances 1, 2, 4 ... ; size and hash are of the whole audit."""

    __slots__ = ("hash", "piece", "size", "up")

    def __init__(self, parent: Node | None, piece: str) -> None:
        self.piece, self.up = piece, []
        self.size, self.hash = (parent.size + len(piece), rolled(parent.hash, piece)) if parent else (0, 0)
        while parent is not None:
            self.up.append(parent)
            parent = parent.up[len(self.up) - 1] if len(parent.up) >= len(self.up) else None

    def reaching(self, size: int) -> Node:
        """The first node on the way here whose audit has so many letters."""
        node = self
        for k in reversed(range(len(self.up))):
            if k < len(node.up) and node.up[k].size >= size:
                node = node.up[k]
        return node

    def prefix(self, size: int) -> int:
        """Hash of the first letters."""
        node = self.reaching(size)
        return node.hash if node.size == size else rolled(node.up[0].hash, node.piece[: size - node.up[0].size])

    def letters(self, size: int) -> Iterator[tuple[int, str, Node]]:
        """Place and letter of the first letters, last one first, each with its node."""
        node = self.reaching(size)
        while node.up:
            for place in range(min(size, node.size) - 1, node.up[0].size - 1, -1):
                yield place, node.piece[place - node.up[0].size], node
            node = node.up[0]

    def text(self) -> str:
        node, parts = self, []
        while node.up:
            parts.append(node.piece)
            node = node.up[0]
        return "".join(reversed(parts))


def rolled(value: int, piece: str) -> int:
    for letter in piece:
        value = (value * BASE + ord(letter)) % MOD
    return value


def common_prefix(a: Node, b: Node) -> int:
    """Letters that two audits have in common at their beginning: searched for by hashes, then verified letter by letter up to the node that they share."""
    low, high = 0, min(a.size, b.size)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.prefix(mid) == b.prefix(mid) else (low, mid - 1)
    for (place, x, at), (_, y, other) in zip(a.letters(low), b.letters(low), strict=True):
        if at is other:
            break
        if x != y:  # equal hashes of different letters
            low = place
    return low


def less(a: Node, b: Node) -> bool:
    if a is b:
        return False
    n = common_prefix(a, b)
    if n == min(a.size, b.size):
        return a.size < b.size
    letter = lambda node: next(node.letters(n + 1))[1]
    return letter(a) < letter(b)


Cells = dict[int, tuple[int, Node]]


def offer(cells: Cells, state: int, cost: int, parent: Node, piece: str) -> None:
    """The state's audit becomes this one if it is cheaper, or as cheap and less."""
    if state not in cells or cost < cells[state][0]:
        cells[state] = cost, Node(parent, piece)
    elif cost == cells[state][0] and less(node := Node(parent, piece), cells[state][1]):
        cells[state] = cost, node


def insert(cells: Cells) -> None:
    """Turns put in where the cells are; two in turn at most, as a third would lead back."""
    before = dict(cells)
    for state in (START, SYSTEM, ASSISTANT):
        if state in before:
            offer(cells, USER, before[state][0] + INSERT, before[state][1], "I")
    if USER in cells:
        offer(cells, ASSISTANT, cells[USER][0] + INSERT, cells[USER][1], "I")


def kept_state(state: int, initial: str) -> int | None:
    """Where a turn of this initial leads, None where it may not be."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def step(cells: Cells, initial: str, must_go: bool, truncated: bool) -> Cells:
    """The cells after one more turn."""
    insert(cells)
    out: Cells = {}
    for state, (cost, node) in cells.items():
        offer(out, state, cost + DELETE, node, "D")
        if not must_go:
            stays = cost + TRUNCATED * truncated
            if (to := kept_state(state, initial)) is not None:
                offer(out, to, stays, node, "K")
            offer(out, NEXT[state], stays + REROLE, node, "R")
    return out


def chunk_audits(turns: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """Of turns (initial, must go, truncated): first state, last state, cost and least of the cheapest audits between them."""
    out = []
    for start in starts:
        cells: Cells = {start: (0, Node(None, ""))}
        for turn in turns:
            cells = step(cells, *turn)
        out += [(start, end, cost, node.text()) for end, (cost, node) in cells.items()]
    return out


class Joined:
    """The audit along a conversation's chunks, and its counts."""

    def __init__(self) -> None:
        self.cells: Cells = {START: (0, Node(None, ""))}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.bases: list[int] = []
        self.low = self.high = self.turn = self.initial = None
        self.distinct = 0

    def add(self, row: dict) -> None:
        for name in self.counts:
            self.counts[name] += row[name]
        self.counts["illegal"] += self.initial is not None and self.initial + row["first_initial"] not in LEGAL
        self.distinct += row["distinct"] - (row["first_turn"] is not None and row["first_turn"] == self.turn)
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else min(self.low, row["low"])
            self.high = row["high"] if self.high is None else max(self.high, row["high"])
        self.initial, self.turn = row["last_initial"], row["last_turn"]
        self.bases.append(row["base"])
        cells: Cells = {}
        for a in row["audits"]:
            if a["start"] in self.cells:
                cost, node = self.cells[a["start"]]
                offer(cells, a["end"], cost + a["cost"], node, a["audit"])
        self.cells = cells

    def end(self) -> tuple[dict, list[tuple[int, str]]]:
        """Counts, cost and audit; and of each chunk its first place and its part of the audit."""
        insert(self.cells)
        last: Cells = {}
        for state in ENDS:
            if state in self.cells:
                offer(last, START, self.cells[state][0], self.cells[state][1], "")
        cost, node = last[START]
        audit, parts = node.text(), []
        while node.up:
            parts.append(node.piece)
            node = node.up[0]
        parts.reverse()
        pieces = parts[: len(self.bases) - 1] + ["".join(parts[len(self.bases) - 1 :])]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": audit}, list(zip(self.bases, pieces, strict=True))


LEGAL = ("su", "ua", "au")
_CHUNKS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, audits array<struct<start: int, end: int, cost: bigint, audit: string>>"


def _chunk(rows: list[tuple], first: bool) -> dict:
    """rows: turn, initial, blank, duplicate, truncated; in order. first: whether the conversation begins with them for certain."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1] for r in rows]
    starts = (START,) if first else (START, SYSTEM, USER, ASSISTANT)
    return {
        "blank": sum(r[2] for r in rows), "duplicate": sum(r[3] for r in rows), "truncated": sum(r[4] for r in rows), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "distinct": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "first_turn": rows[0][0], "last_turn": rows[-1][0], "first_initial": initials[0], "last_initial": initials[-1],
        "audits": [{"start": s, "end": e, "cost": c, "audit": a} for s, e, c, a in chunk_audits([(r[1], r[2] or r[3], r[4]) for r in rows], starts)],
    }


def _groups(each_key, names: list[str], close, most: int = 512):
    """A function for map_batches: rows of a key, which follow each other, are given to close(key, rows), whose dicts become columns."""

    def make():
        key, held = None, []

        def flush(out: list[dict]):
            if held:
                out += close(key, held)
                held.clear()

        def each(batch: pa.RecordBatch | None):
            nonlocal key
            out: list[dict] = []
            if batch is None:
                flush(out)
            else:
                for row in batch.to_pylist():
                    if (now := each_key(row)) != key:
                        flush(out)
                        key = now
                    held.append(row)
                    if len(out) >= most:
                        yield {n: [r.get(n) for r in out] for n in names}
                        out = []
            yield {n: [r.get(n) for r in out] for n in names}

        return each

    return make


class Repair:
    """The turns of docs, repaired conversation by conversation.

    conversations has one row for each: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; turns are the repaired turns: conv_id, at, step (place
    among those that one turn became), role, text; hashes has the SHA-256 of each conversation's repaired `role:text`, joined by newlines.

    Turns go by number, nulls first; equal numbers by role, then by the SHA-256 of the text; equal rows as they come. Null roles and texts are one space; an empty role has no initial
    that may stay. Null conversation ids are one conversation. Texts may be of any length; columns beside the four are not read; an empty table has no conversations.
    """

    def __init__(self, turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> None:
        fields = turns.select(turns[conv_id].alias("conv_id"), turns[turn].cast("bigint").alias("turn"), F.coalesce(turns[role], F.lit(" ")).alias("role"), F.coalesce(turns[text], F.lit(" ")).alias("text"))
        self.kind = fields.schema["conv_id"].dataType.simpleString()
        last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
        rows = fields.select("*", F.sha2("text", 256).alias("tie"), F.monotonically_increasing_id().alias("salt"), F.substring("role", 1, 1).alias("initial"), last.alias("last"))
        order = ["conv_id", "turn", "role", "tie", "salt"]
        sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        marks = ((F.col("last") == "").alias("blank"), (~F.col("last").isin("", ".", "!", "?")).alias("cut"))
        self.numbered = written(sorted_.select("conv_id", "turn", "role", "text", "tie", "initial", *marks, F.monotonically_increasing_id().alias("at")), "numbered")
        self.audited = written(self._audited(written(self._chunks(), "chunks")), "audited")

    def _flagged(self) -> DataFrame:
        """The turns without their texts; duplicate: an equal one stands before."""
        narrow = self.numbered.select("conv_id", "turn", "at", "initial", "blank", "cut", "role", "tie")
        first = narrow.where(~F.col("blank")).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tie").alias("t")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("tie") == F.col("t"))
        duplicate = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
        return narrow.join(first, same, "left").select("conv_id", "turn", "at", "initial", "blank", duplicate.alias("duplicate"), (F.col("cut") & ~duplicate).alias("cut"))

    def _chunks(self) -> DataFrame:
        size = CHUNK

        def close(key, rows):
            # a conversation that begins within a chunk's places has no chunk before
            yield {"conv_id": key[0], "base": rows[0]["at"], **_chunk([(r["turn"], r["initial"], r["blank"], r["duplicate"], r["cut"]) for r in rows], rows[0]["at"] % size > 0)}

        rows = self._flagged().withColumn("chunk", F.floor(F.col("at") / size))
        schema = f"conv_id {self.kind}, base bigint, {_CHUNKS}"
        names = ["conv_id", "base", *re.findall(r"(\w+) (?:bigint|string|array)", _CHUNKS)]
        return map_batches(rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "at"), _groups(lambda r: (r["conv_id"], r["chunk"]), names, close, most=16), schema, tail=True)

    def _audited(self, chunks: DataFrame) -> DataFrame:
        """A row for each conversation, and one for each turn with its edits: insertions before it, its own, and at the end those after it."""
        names = ["conv_id", "at", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

        def make():
            key, joined = None, None

            def done():
                found, pieces = joined.end()
                yield {n: [v] for n, v in ({"conv_id": key, "at": None, "edits": None} | found).items()}
                for base, piece in pieces:
                    own = re.findall(r"I*[KRD]", piece)
                    own[-1] += piece[len("".join(own)) :]
                    for i in range(0, len(own), 512):
                        part = own[i : i + 512]
                        yield {n: pa.nulls(len(part)) for n in names} | {"conv_id": [key] * len(part), "at": list(range(base + i, base + i + len(part))), "edits": part}

            def each(batch: pa.RecordBatch | None):
                nonlocal key, joined
                for row in [None] if batch is None else batch.to_pylist():
                    if joined is not None and (row is None or row["conv_id"] != key):
                        yield from done()
                        joined = None
                    if row is not None:
                        key, joined = row["conv_id"], joined or Joined()
                        joined.add(row)

            return each

        schema = f"conv_id {self.kind}, at bigint, edits string, " + ", ".join(f"{n} bigint" for n in names[3:-1]) + ", audit string"
        return map_batches(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "base"), make, schema, tail=True)

    @property
    def conversations(self) -> DataFrame:
        return self.audited.where("at IS NULL").drop("at", "edits")

    def _stream(self) -> DataFrame:
        """Edits and turns of each conversation in order, the edits of a turn before it."""
        edits = self.audited.where("at IS NOT NULL").select("conv_id", "at", F.lit(0).alias("part"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits")
        turns = self.numbered.select("conv_id", "at", F.lit(1).alias("part"), "role", "text", F.lit(None).cast("string").alias("edits"))
        return edits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")

    @property
    def turns(self) -> DataFrame:
        def make():
            follow = _follow()

            def each(batch: pa.RecordBatch):
                out = list(follow(batch))
                yield {n: [r[i] for r in out] for i, n in enumerate(("conv_id", "at", "step", "role", "text"))}

            return each

        return map_batches(self._stream(), make, f"conv_id {self.kind}, at bigint, step int, role string, text string")

    @property
    def hashes(self) -> DataFrame:
        """conv_id, repaired_sha256; conversations of which nothing is left have the hash of nothing."""

        def make():
            follow, key, sha, some = _follow(), None, None, False

            def each(batch: pa.RecordBatch | None):
                nonlocal key, sha, some
                out = []
                for now, _, _, role, text in [(None,) * 5] if batch is None else follow(batch, mark=True):
                    if sha is not None and (batch is None or now != key):
                        out.append((key, sha.hexdigest()))
                        sha = None
                    if batch is not None:
                        if sha is None:
                            key, sha, some = now, hashlib.sha256(), False
                        if role is not None:
                            sha.update(("\n" * some + f"{role}:{text}").encode())
                            some = True
                yield {"conv_id": [k for k, _ in out], "repaired_sha256": [h for _, h in out]}

            return each

        return map_batches(self._stream(), make, f"conv_id {self.kind}, repaired_sha256 string", tail=True)


def _follow():
    """A function that gives the repaired turns of the rows of _stream(), batch by batch; with mark, for deleted turns a row without role."""
    key, state, edits = (), START, ""

    def follow(batch: pa.RecordBatch, mark: bool = False) -> Iterator[tuple]:
        nonlocal key, state, edits
        for row in batch.to_pylist():
            if (row["conv_id"],) != key:
                key, state = (row["conv_id"],), START
            if row["part"] == 0:
                edits = row["edits"]
                continue
            if mark and edits == "D":
                yield row["conv_id"], row["at"], 0, None, None
            for place, edit in enumerate(edits):
                if edit == "K":
                    state = kept_state(state, row["role"][:1])
                    yield row["conv_id"], row["at"], place, row["role"], row["text"]
                elif edit in "IR":
                    state = NEXT[state]
                    yield row["conv_id"], row["at"], place, NAMES[state], row["text"] if edit == "R" else ""

    return follow
