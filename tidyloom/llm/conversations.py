"""Repair of conversation structure by secondary-sorted streaming.

Rows are dealt out by conversation and sorted by turn, last turn first. One pass over
the sorted stream carries the state of a dynamic program across Arrow batches: for each
of four states (nothing yet, after the system message, after a user, after an assistant)
the least cost of mending what follows. What is best at a row takes two bits a state, so
backpointers are one byte a row; when the first row of a conversation has gone by, they
are followed from front to back. Backpointers and messages of a giant conversation go
to temporary files of the task and are read again backwards, so memory stays bounded by
``held`` bytes, apart from the audit itself (one letter an edit).

A legal conversation has role initials ``(s?(ua)+)?``. Edits: Keep costs 0, Rerole to user or
assistant 2, Delete 3, Insert of an empty message 2; a truncated message that is not deleted costs 1
more. Blank messages and repeats of an earlier message must be deleted. Every edit leads to
one state only, so among equally cheap edits the first letter decides, and taking the
least letter at each step gives the ASCII-least audit.

Defined cases: null roles and texts count as one space; rows without a turn come first;
rows of one turn are ordered by role, then text; a null conversation id is a conversation of
its own; a conversation without messages has zeros, an empty audit and nothing
repaired. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm.common import SPACES

#: Bytes of backpointers and of messages that a task holds before they go to a file.
HELD = 1 << 24

#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Letters by their number in a backpointer, in ASCII order.
LETTERS = "DIKR"
D, I, K, R = range(4)
#: States: nothing yet, after the system message, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant message in each state, and the role such a message has.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = (None, None, "user", "assistant")
#: Bits of a row's code: its initial (0 none of them, 1 s, 2 u, 3 a), blank, duplicate, truncated, no message at all.
BLANK, DUPLICATE, CUT, GONE = 4, 8, 16, 32
#: Adjacent initials that may stand as they are.
LEGAL = {(1, 2), (2, 3), (3, 2)}

SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv string, position long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) harmed by the checksum of ``conv_id:turn``.

    Of 20 remainders 0 takes the row away (it stays with ``gone``, so that its conversation
    remains known), 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes
    it a user's.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.pmod(F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")), F.lit(20))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))
    return rows.drop("copy")


def _code() -> Column:
    """What the program needs to know of a row, from role, text, nth (of its repeats) and gone."""
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    fault = (
        F.when(bare == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(0)
    )
    return F.when(F.col("gone"), GONE).otherwise(F.when(F.col("role") == "", 0).otherwise(initial) + fault)


def _sorted(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column) -> DataFrame:
    """(conv, turn, code, role, text), one conversation after the other, the last turn first."""
    space = F.lit(" ")
    rows = rows.select(
        F.col(conv).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
        F.coalesce(gone, F.lit(False)).alias("gone"),
    ).repartition("conv")
    # Repeats are numbered inside the parts of the one shuffle, by digests.
    alike = F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"))
    nth = F.row_number().over(Window.partitionBy("conv", "gone", "alike").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.withColumn("alike", alike).withColumn("nth", nth)
    rows = rows.select("conv", "turn", _code().cast("int").alias("code"), "role", "text", "nth")
    return rows.sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("nth").desc()
    ).select("conv", F.col("turn").cast("string").alias("turn"), "code", "role", "text")


class Backwards:
    """Records that are read again last to first; beyond ``held`` bytes they lie in a temporary file."""

    def __init__(self, held: int):
        self.held, self.recent, self.size, self.file, self.ends = held, [], 0, None, []

    def append(self, record: bytes) -> None:
        self.recent.append(record)
        self.size += len(record) + 8
        if self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        block = b"".join(struct.pack("<q", len(r)) + r for r in self.recent)
        self.file.write(block)
        self.ends.append(len(block))
        self.recent, self.size = [], 0

    def __iter__(self) -> Iterator[bytes]:
        yield from reversed(self.recent)
        at = sum(self.ends)
        for size in reversed(self.ends):
            at -= size
            self.file.seek(at)
            block, records, i = self.file.read(size), [], 0
            while i < size:
                (n,) = struct.unpack_from("<q", block, i)
                records.append(block[i + 8 : i + 8 + n])
                i += 8 + n
            yield from reversed(records)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


#: Costs after the last row: a conversation may end before its first message and after an assistant.
END = (0, 2 * INSERT, INSERT, 0)


def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row, of the costs after it, and the backpointer: two bits a state."""
    initial, cut = code & 3, TRUNCATED if code & CUT else 0
    best = []
    for state in range(4):
        options = [(DELETE + after[state], D)]
        if not code & (BLANK | DUPLICATE):
            keeps = initial == NEXT[state] or (initial == SYSTEM and state == START)
            if keeps:
                options.append((cut + after[initial], K))
            options.append((REROLE + cut + after[NEXT[state]], R))
        best.append(min(options))
    # An insert leads to another state before the same row; two in a row never come back for less.
    base = [cost for cost, _ in best]
    whole = list(base)
    whole[USER] = min(base[USER], INSERT + base[ASSISTANT])
    whole[ASSISTANT] = min(base[ASSISTANT], INSERT + base[USER])
    pointer, before = 0, []
    for state in range(4):
        cost, letter = min(best[state], (INSERT + whole[NEXT[state]], I))
        before.append(cost)
        pointer |= letter << (2 * state)
    return tuple(before), pointer


class Conversation:
    """State of the stream inside one conversation, from its last row to its first."""

    def __init__(self, conv: str | None, held: int, memo: dict):
        self.conv, self.memo = conv, memo
        self.costs, self.base = END, 0
        self.pointers, self.messages, self.block = Backwards(held), Backwards(held), bytearray()
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal = self.turns = 0
        self.after = self.low = self.high = None

    def add(self, turn: str | None, code: int, role: str, text: str) -> None:
        if code & GONE:
            return
        key = (self.costs, code)
        if key not in self.memo:
            costs, pointer = step(self.costs, code)
            least = min(costs)
            # Costs count from the least, so few tuples occur and each is worked out once.
            self.memo[key] = tuple(c - least for c in costs), pointer, least
        self.costs, pointer, least = self.memo[key]
        self.base += least
        self.block.append(pointer)
        if len(self.block) >= 1 << 16:
            self._flush()
        for fault in self.counts:
            if code & fault:
                self.counts[fault] += 1
        initial = code & 3
        if self.after is not None and (initial, self.after) not in LEGAL:
            self.illegal += 1
        self.after = initial
        if turn is not None:
            value = int(turn)
            self.turns += self.low is None or value != self.low
            self.low = value
            self.high = value if self.high is None else self.high
        gone = code & (BLANK | DUPLICATE)
        name = role.encode()
        self.messages.append(b"" if gone else struct.pack("<i", len(name)) + name + text.encode())

    def _flush(self) -> None:
        self.pointers.append(bytes(self.block))
        self.block = bytearray()

    def edits(self) -> Iterator[tuple[str, str | None, str]]:
        """(letter, role, text) of every edit, first message first; null roles are deleted."""
        self._flush()
        state, rows = START, iter(self.messages)
        for block in self.pointers:
            for pointer in reversed(block):
                while (letter := pointer >> (2 * state) & 3) == I:
                    state = NEXT[state]
                    yield "I", ROLE[state], ""
                record = next(rows)
                if letter == D:
                    yield "D", None, ""
                    continue
                (n,) = struct.unpack_from("<i", record)
                role, text = record[4 : 4 + n].decode(), record[4 + n :].decode()
                if letter == R:
                    state = NEXT[state]
                    yield "R", ROLE[state], text
                else:
                    state = SYSTEM if role.startswith("s") else NEXT[state]
                    yield "K", role, text
        while state not in (START, ASSISTANT):
            state = NEXT[state]
            yield "I", ROLE[state], ""

    def close(self) -> None:
        self.pointers.close()
        self.messages.close()

    def summary(self) -> tuple:
        audit, digest, first = [], hashlib.sha256(), True
        for letter, role, text in self.edits():
            audit.append(letter)
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = self.counts
        cost = self.base + self.costs[START]
        return (self.conv, gaps, counts[BLANK], counts[DUPLICATE], counts[CUT], self.illegal, cost, "".join(audit), digest.hexdigest())

    def repaired(self) -> Iterator[tuple]:
        kept = ((letter, role, text) for letter, role, text in self.edits() if role is not None)
        for position, (letter, role, text) in enumerate(kept):
            yield self.conv, position, letter, role, text


def _stream(held: int, columns: list[str], results: Callable[[Conversation], Iterator[tuple]], batch_rows: int = 5000):
    """Function for ``mapInPandas`` over sorted rows: results of every conversation in a part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        now: Conversation | None = None
        out: list[tuple] = []
        size = 0

        def full() -> bool:
            return len(out) >= batch_rows or size > held

        def frame() -> pd.DataFrame:
            nonlocal size
            made = pd.DataFrame(out, columns=columns)
            out.clear()
            size = 0
            return made

        def finish(conversation: Conversation) -> Iterator[pd.DataFrame]:
            nonlocal size
            try:
                for row in results(conversation):
                    out.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if full():
                        yield frame()
            finally:
                conversation.close()

        for batch in frames:
            # Nulls of text columns come as NaN or None.
            batch = batch.astype(object).where(batch.notna(), None)
            for conv, turn, code, role, text in zip(*(batch[c] for c in ("conv", "turn", "code", "role", "text")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield from finish(now)
                    now = Conversation(conv, held, memo)
                now.add(turn, code, role, text)
        if now is not None:
            yield from finish(now)
        if out:
            yield frame()

    return run


def _repair(rows: DataFrame, schema: str, results, conv: str, turn: str, role: str, text: str, gone: Column | None, held: int) -> DataFrame:
    kind = rows.schema[conv].dataType
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = _sorted(rows, conv, turn, role, text, F.lit(False) if gone is None else gone)
    out = rows.mapInPandas(_stream(held, columns, results), schema)
    return out.select(F.col("conv").cast(kind).alias(conv), *columns[1:])


def summaries(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, held: int = HELD
) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired messages.

    Rows for which ``gone`` is true are no messages and only name their conversation.
    """
    return _repair(rows, SUMMARY, lambda c: iter([c.summary()]), conv, turn, role, text, gone, held)


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, held: int = HELD
) -> DataFrame:
    """The messages of every conversation after the cheapest edits: position, edit (I, K or R), role, text."""
    return _repair(rows, MESSAGES, lambda c: c.repaired(), conv, turn, role, text, gone, held)
