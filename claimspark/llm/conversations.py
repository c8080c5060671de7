"""Repair of the structure of conversations at least cost.

A repaired conversation's role initials read s?(ua)+ or are empty. Rows may be kept (K, cost 0), given the role user or
assistant (R, 2) or deleted (D, 3), and empty rows of user or assistant inserted anywhere (I, 2); blank rows and repeats
of an earlier role and text must go, and a truncated row that stays costs 1. Of the cheapest edits those whose initials,
in order, come first in ASCII are taken.

Rows are dealt by conversation and sorted by turn within their partition; Spark's sort spills, whatever a conversation
holds. A task streams them through Arrow batches and carries the state of a dynamic program: for each of four places in the
pattern the least cost and the rank of its edits. States that cost over SLACK more than the cheapest can't win any more
and are given up, so that states and ranks are few and each step is looked up once it is known. A row leaves three
bytes of back pointers. Between two rows at most two insertions can pay. Edits up to a row hold one letter for each row and
end in it, so that none begins with another: the ranks of the states order whatever follows.

The texts of a conversation are held until it ends, up to HELD_BYTES. Beyond that they are let go and the back pointers
are written out in blocks; a second pass reads the blocks from the last to the first and finds the edits, a third streams the
rows again beside them. The edits themselves are one letter for each row, in one column of the result.

Defined cases: nulls of any column count as one space (a null conv_id is a conversation, its result has a null conv_id); a null
turn comes first; rows of one turn are ordered by role and text; a row whose role's first letter is none of s, u, a
cannot be kept; an empty table gives no rows. Columns beyond the four are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Bytes of text of one conversation that a task holds.
HELD_BYTES = 16 << 20
#: Rows whose back pointers make a block, in conversations beyond that.
BLOCK_ROWS = 1_000_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any state's best continuation can cost beyond that of another state.
SLACK = 6
FAR = 1 << 30
#: Places in the pattern: nothing yet, after s, after u, after a. A conversation may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DKR"
SPACES = " \t\n\x0b\f\r"

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TRACE = T.StructType().add("kind", "integer").add("block", "integer").add("pointers", "binary")
SUMMARY = T.StructType()
for _c in COUNTS:
    SUMMARY = SUMMARY.add(_c, "long")
SUMMARY = SUMMARY.add("audit", "string").add("repaired_sha256", "string")
#: Kinds of rows of the first pass: a whole conversation; a block of back pointers; the end of a conversation in blocks.
WHOLE, BLOCK, END = range(3)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the checksum of conversation and turn. Rows that are dropped stay as
    markers with gone set, so that their conversation is not lost."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("way") <= 1, "").when(F.col("way") == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    out = rows.select("conv_id", "turn", "role", "text", way.alias("way"))
    out = out.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), "way")
    return out.withColumn("__copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__copy", "way")


def prepared(rows: DataFrame) -> DataFrame:
    """rows with gone (false where there is no such column), nulls as one space, and fault: 1 blank, 2 a repeat of an
    earlier role and text, 3 truncated, else 0. Dealt by conversation; one exchange serves this and the streams."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    blank = F.lit(" ")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), gone.alias("gone"))
    same = Window.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), "role", "text").orderBy("turn")
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", 1).when(F.row_number().over(same) > 1, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    return plain.repartition("conv_id").withColumn("fault", fault.cast("int"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text")


@functools.cache
def _moves(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row the ways to it: (state before, cost, edits)."""
    ways: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
    for before in range(4):
        state = before
        for inserts in range(3):
            front, paid = "I" * inserts, INSERT * inserts
            ways[state].append((before, paid + DELETE, front + "D"))
            if not must_go:
                extra = TRUNCATED if truncated else 0
                if (state, initial) in KEPT:
                    ways[KEPT[state, initial]].append((before, paid + extra, front + "K"))
                ways[INSERTED[state]].append((before, paid + REROLE + extra, front + "R"))
            state = INSERTED[state]
    return ways


def _packed(before: int, edits: str) -> int:
    """Six bits: the state before, the number of insertions, the letter."""
    return before << 4 | len(edits) - 1 << 2 | LETTERS.index(edits[-1])


@functools.cache
def _step(costs: tuple, ranks: tuple, initial: str, must_go: bool, truncated: bool) -> tuple[tuple, tuple, int, bytes]:
    """Costs above the least, ranks, what the least grew by, and the back pointers, after one more row."""
    best = []
    for ways in _moves(initial, must_go, truncated):
        found = [(costs[b] + c, ranks[b], e, b) for b, c, e in ways if costs[b] < FAR]
        best.append(min(found, default=(FAR, 4, "", 0)))
    least = min(b[0] for b in best)
    reached = [b[0] - least <= SLACK for b in best]
    order = sorted({b[1:3] for b, r in zip(best, reached, strict=True) if r})
    pointers = 0
    for b, r in zip(best, reached, strict=True):
        pointers = pointers << 6 | (_packed(b[3], b[2]) if r else 0)
    new_costs = tuple(b[0] - least if r else FAR for b, r in zip(best, reached, strict=True))
    return new_costs, tuple(order.index(b[1:3]) if r else 4 for b, r in zip(best, reached, strict=True)), least, pointers.to_bytes(3, "big")


def _last(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """(cost, state, insertions) of the cheapest end."""
    found = []
    for before in range(4):
        state = before
        for inserts in range(3):
            if costs[before] < FAR and state in ENDS:
                found.append((costs[before] + INSERT * inserts, ranks[before], inserts, before))
            state = INSERTED[state]
    cost, _, inserts, before = min(found)
    return cost, before, inserts


def traced(pointers: bytes | bytearray, state: int) -> tuple[str, int]:
    """The edits of rows from their back pointers and the state after the last, and the state before the first."""
    out = []
    for at in range(len(pointers) - 3, -1, -3):
        six = int.from_bytes(pointers[at : at + 3], "big") >> 6 * (3 - state) & 63
        out.append("I" * (six >> 2 & 3) + LETTERS[six & 3])
        state = six >> 4
    return "".join(reversed(out)), state


class Editor:
    """Applies edits: takes letters and rows in order and gives the rows that stay."""

    def __init__(self) -> None:
        self.state = START

    def inserted(self) -> tuple[str, str]:
        self.state = INSERTED[self.state]
        return ROLE_OF[self.state], ""

    def row(self, letter: str, role: str, text: str) -> tuple[str, str] | None:
        if letter == "D":
            return None
        if letter == "R":
            return self.inserted()[0], text
        self.state = KEPT[self.state, role[:1]]
        return role, text


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the repaired conversation."""
    editor, rows = Editor(), iter(rows)
    for letter in audit:
        made = editor.inserted() if letter == "I" else editor.row(letter, *next(rows))
        if made:
            yield letter, *made


class Digest:
    """SHA-256 of role:text lines joined by line breaks."""

    def __init__(self) -> None:
        self._sha, self._begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self._sha.update(f"{chr(10) if self._begun else ''}{role}:{text}".encode())
        self._begun = True

    def hex(self) -> str:
        return self._sha.hexdigest()


class _Conversation:
    """One conversation on its way through the first pass."""

    def __init__(self, conv_id, held_bytes: int, block_rows: int) -> None:
        self.conv_id, self._most, self._block = conv_id, held_bytes, 3 * block_rows
        self.texts: list[tuple[str, str]] | None = []
        self._held, self.blocks, self.pointers = 0, 0, bytearray()
        self._costs, self._ranks, self._cost = (0, FAR, FAR, FAR), (0, 4, 4, 4), 0
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self._initial: str | None = None
        self._turns: list[int | None] = [None, None, 0]  # the first, the last, how many

    def add(self, turn: int | None, role: str, text: str, fault: int) -> bytes | None:
        """Takes a row; gives a full block of back pointers where texts are no longer held."""
        initial = role[:1]
        if self._initial is not None and self._initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self._initial = initial
        if turn is not None:
            if self._turns[0] is None:
                self._turns[0] = turn
            if turn != self._turns[1]:
                self._turns[1] = turn
                self._turns[2] += 1
        self.faults[fault] += 1
        self._costs, self._ranks, more, six = _step(self._costs, self._ranks, initial if initial in ("s", "u", "a") else "", fault in (1, 2), fault == 3)
        self._cost += more
        self.pointers += six
        if self.texts is not None:
            self.texts.append((role, text))
            self._held += len(role) + len(text)
            if self._held > self._most:
                self.texts = None
        if self.texts is None and len(self.pointers) >= self._block:
            full, self.pointers = bytes(self.pointers), bytearray()
            self.blocks += 1
            return full
        return None

    def end(self) -> tuple[dict, int, int]:
        cost, state, inserts = _last(self._costs, self._ranks)
        first, last, n = self._turns
        gaps = 0 if first is None else last - first + 1 - n
        return dict(zip(COUNTS, (gaps, *self.faults[1:], self.illegal, self._cost + cost), strict=True)), state, inserts


def _first_pass(rows: DataFrame, held_bytes: int, block_rows: int) -> DataFrame:
    schema = T.StructType([rows.schema["conv_id"], *_TRACE, *SUMMARY])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: _Conversation | None = None

        def block(pointers: bytes, number: int) -> None:
            out.append((now.conv_id, BLOCK, number, pointers, *[None] * len(SUMMARY)))

        def close() -> None:
            counts, state, inserts = now.end()
            if now.texts is None:
                if now.pointers:
                    block(bytes(now.pointers), now.blocks)
                out.append((now.conv_id, END, state, bytes([inserts]), *counts.values(), None, None))
                return
            audit, _ = traced(now.pointers, state)
            audit += "I" * inserts
            digest = Digest()
            for _, role, text in edited(audit, now.texts):
                digest.add(role, text)
            out.append((now.conv_id, WHOLE, 0, None, *counts.values(), audit, digest.hex()))

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        close()
                    now = _Conversation(conv_id, held_bytes, block_rows)
                if not gone:
                    full = now.add(turn, role, text, fault)
                    if full is not None:
                        block(full, now.blocks - 1)
            if out:
                yield handed()
        if now is not None:
            close()
            yield handed()

    ordered = _in_order(rows).select("conv_id", "turn", "role", "text", "gone", "fault")
    return ordered.mapInArrow(work, schema)


def _second_pass(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, audit): the edits of each block, from blocks and ends of the first pass."""
    schema = T.StructType([blocks.schema["conv_id"], T.StructField("block", T.IntegerType()), T.StructField("audit", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, tail = START, ""
        for batch in batches:
            out = []
            for conv_id, kind, number, pointers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == END:
                    state, tail = number, "I" * pointers[0]
                else:
                    audit, state = traced(pointers, state)
                    out.append((conv_id, number, audit + tail))
                    tail = ""
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.string()), strict=True)], names=schema.names)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind").desc(), F.col("block").desc())
    return ordered.select("conv_id", "kind", "block", "pointers").mapInArrow(work, schema)


def _beside(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """rows, without the gone, with the edits of their conversation before them: (conv_id, row, block, turn, role, text)."""
    plain = rows.filter("NOT gone").select("conv_id", F.lit(1).alias("row"), F.lit(0).alias("block"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    edits = audits.select("conv_id", F.lit(0).alias("row"), "block", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = plain.unionByName(edits)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", "block", "turn", "role", "text").select("conv_id", "row", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, audit, letter, role, text) of the rows that stay, and (conv_id, audit, None, None, None) at each end."""
    begun, conv_id, editor, audit, at = False, None, Editor(), "", 0

    def rest() -> Iterator[tuple]:
        """The insertions that come before the next row or the end."""
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield conv_id, audit, "I", *editor.inserted()

    for batch in batches:
        pieces: list[str] = []
        for key, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or key != conv_id:
                if begun:
                    audit, pieces = audit + "".join(pieces), []
                    yield from rest()
                    yield conv_id, audit, None, None, None
                begun, conv_id, editor, audit, at = True, key, Editor(), "", 0
            if not is_row:
                pieces.append(text)
                continue
            if pieces:
                audit, pieces = audit + "".join(pieces), []
            yield from rest()
            made = editor.row(audit[at], role, text)
            if made:
                yield conv_id, audit, audit[at], *made
            at += 1
        audit += "".join(pieces)
    if begun:
        yield from rest()
        yield conv_id, audit, None, None, None


def _third_pass(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of the conversations of audits; rows: theirs."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind, digest = first.schema.field(0).type, Digest()

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for conv_id, audit, letter, role, text in _streamed(again()):
            if letter:
                digest.add(role, text)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), pa.array([audit]), pa.array([digest.hex()])], names=schema.names)
                digest = Digest()

    return _beside(rows, audits).mapInArrow(work, schema)


def _known(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    ids = conversations.select(F.col("conv_id").alias("__id")).distinct()
    return rows.join(ids, F.col("conv_id").eqNullSafe(F.col("__id")), "left_semi")


def summaries(rows: DataFrame, held_bytes: int = HELD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation of rows(conv_id, turn, role, text, and gone if there is such a column): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    traces = cut(_first_pass(prepared(rows), held_bytes, block_rows), "conversation-traces")
    out = traces.filter(F.col("kind") == WHOLE).select("conv_id", *SUMMARY.names)
    split = traces.filter(F.col("kind") != WHOLE)
    if split.isEmpty():
        return out
    audits = cut(_second_pass(split), "conversation-edits")
    ends = split.filter(F.col("kind") == END).select("conv_id", *COUNTS)
    gone = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    hashed = _third_pass(_known(gone, ends), audits).withColumnRenamed("conv_id", "__id")
    more = ends.join(hashed, F.col("conv_id").eqNullSafe(F.col("__id"))).select("conv_id", *SUMMARY.names)
    return out.unionByName(more)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text), inserted rows included, positions from 0.
    edits: (conv_id, audit) as summaries() gives them for the same rows."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType().add("position", "long").add("edit", "string").add("role", "string").add("text", "string")])
    gone = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, position, held = [], [], 0, 0

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field(0).type]
                yield b

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kinds[0], pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=schema.names)

        for conv_id, _, letter, role, text in _streamed(typed()):
            if not letter:
                position = 0
                continue
            out.append((conv_id, position, letter, role, text))
            position, held = position + 1, held + len(text)
            if held > HELD_BYTES // 4 or len(out) >= 10_000:
                held = 0
                yield handed()
        if out:
            yield handed()

    return _beside(gone, edits.select("conv_id", "audit", F.lit(0).alias("block"))).mapInArrow(work, schema)
