"""Repair of the structure of conversations at least cost, with an audit of every edit.

Turns are kept, given another role, deleted, or joined by inserted empty turns, until the initials of the roles read
``(s?(ua)+)?``. Of all cheapest ways the one whose audit, the initials of its edits in order, is least in ASCII order counts.

A dynamic program goes over the turns of a conversation, in layers: after each turn there are at most four states (nothing
yet, after the system turn, after a user, after an assistant). One step of a layer is a macro edit: a run of inserts and the
edit of the turn. Its code is its letters, as in ``IIK``. No code is a prefix of another, so that no audit of a layer is a prefix
of another one either, and two audits compare as the ranks of their parents in the layer before, then as their codes. A state
is therefore kept as a cost and a rank; the audits are read back from parent pointers, four bytes a turn, at the end.

Two passes: ``audits`` moves no texts, only their digests and faults; ``repaired`` streams the turns of a conversation beside
its audit and holds neither. Repeated texts are found by an aggregate over digests, so that a text which many turns share is
one row a task. A conversation is one stream in one task (its digest is sequential), with constant state but for the pointers.

Defined results: a null role or text is one space; an empty role, like every other one that does not begin with s, u or a, fits nowhere
and is given another or goes; turns come by number, those without one first, and turns of one number by role and text (its first 64
characters, then its digest); a null conversation id names a conversation like any other; repeated rows are turns, of which the
later ones are duplicates; an empty input gives no rows; other columns are ignored; gaps beyond 64 bits are 2^63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import HOT_ROWS, prepare, saved, spread_join, table

# Costs, white space and sentence ends of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: More than two inserts in a run lead back to a state that costs less.
CODES = sorted("I" * n + x for n in range(3) for x in "DKR")
CODE = {c: i for i, c in enumerate(CODES)}
#: Faults of a turn, in the order in which they count.
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
NONE = 255
MOST = (1 << 63) - 1
Layer = tuple[tuple[int, int] | None, ...]
START: Layer = ((0, 0), None, None, None)


def _inserted(state: int) -> int:
    return NEXT[state, "a" if state == USER else "u"]


@lru_cache(maxsize=None)
def _macros(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(state before, state after, cost, code) of the macro edits of a turn."""
    out = []
    for before in range(4):
        at = before
        for n in range(3):
            paid = n * INSERT
            out.append((before, at, paid + DELETE, CODE["I" * n + "D"]))
            if fault in (OK, CUT_OFF):
                paid += TRUNCATED * (fault == CUT_OFF)
                if (at, initial) in NEXT:
                    out.append((before, NEXT[at, initial], paid + KEEP, CODE["I" * n + "K"]))
                out.append((before, _inserted(at), paid + REROLE, CODE["I" * n + "R"]))
            at = _inserted(at)
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, bytes]:
    """The next layer, with costs above its least one, that cost, and its four parent pointers (state and code)."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for before, after, cost, code in _macros(initial, fault):
        if (held := layer[before]) is not None:
            found = (held[0] + cost, held[1], code, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    ranks = {x: i for i, x in enumerate(sorted({(b[1], b[2]) for b in best if b}))}
    least = min(b[0] for b in best if b)
    return tuple(b and (b[0] - least, ranks[b[1], b[2]]) for b in best), least, bytes(b[3] << 4 | b[2] if b else NONE for b in best)


def _ended(layer: Layer, pointers: bytes | bytearray) -> tuple[int, str]:
    """Cost above the last layer's least and the audit of the best complete conversation."""
    ends = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
    cost, _, tail, state = min((layer[s][0] + INSERT * len(t), layer[s][1], t, s) for s, t in ends.items() if layer[s])
    codes = [tail]
    for i in range(len(pointers) - 4, -1, -4):
        p = pointers[i + state]
        codes.append(CODES[p & 15])
        state = p >> 4
    return cost, "".join(reversed(codes))


def best_edits(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit for the (role initial, fault) of each turn of one conversation."""
    layer, total, pointers = START, 0, bytearray()
    for initial, fault in turns:
        layer, cost, p = step(layer, initial if initial in "sua" else "", fault)
        total += cost
        pointers += p
    cost, audit = _ended(layer, pointers)
    return total + cost, audit


# --- first pass: faults and audits -----------------------------------------------------------------

STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of one conversation while its turns stream by."""

    def __init__(self, conv: Any):
        self.conv, self.layer, self.cost, self.pointers = conv, START, 0, bytearray()
        self.counts, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.first = self.turn = None  # least and newest turn number
        self.numbers, self.before = 0, None

    def add(self, turn: int | None, initial: str, fault: int, again: bool, digest: bytes, times: int) -> None:
        for _ in range(times):
            same = again or self.before == (turn, digest)
            self.before = (turn, digest)
            now = DUPLICATE if same and fault != BLANK else fault
            self.counts[now] += 1
            if self.last is not None and self.last + initial not in LEGAL:
                self.illegal += 1
            self.last = initial
            self.layer, cost, p = step(self.layer, initial if initial in ("s", "u", "a") else "", now)
            self.cost += cost
            self.pointers += p
        if times and turn is not None:
            if self.first is None:
                self.first = turn
            self.numbers += turn != self.turn or self.numbers == 0
            self.turn = turn

    def row(self) -> tuple:
        cost, audit = _ended(self.layer, self.pointers)
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.numbers, MOST)
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost + cost, audit)


def _flushed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out, schema = None, [], None
    for b in batches:
        schema = schema or pa.schema([("conv_id", b.schema.field(0).type), *((s, pa.int64()) for s in STATS), ("audit", pa.string())])
        for conv, *turn in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            now.add(*turn)
            if len(out) >= 1000:
                yield _flushed(out, schema)
                out = []
    if now is not None:
        yield _flushed([*out, now.row()], schema)


def _lined(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    times = F.col("times") if "times" in turns.columns else F.lit(1)
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), times.alias("times"))


def _order(rows: DataFrame) -> DataFrame:
    """With the columns by which turns of one number are told apart."""
    return rows.withColumns({"begin": F.left("text", F.lit(64)), "digest": F.unhex(F.sha2(F.to_json(F.struct("role", "text")), 256))})


def fault(text: Column) -> Column:
    """Blank, truncated or neither, of one text."""
    rest = F.rtrim(text, F.lit(SPACE))
    return F.when(rest == "", BLANK).when(~F.right(rest, F.lit(1)).isin(*ENDS), CUT_OFF).otherwise(OK)


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    A column ``times``, if there is one, says how often a row counts: rows of 0 are no turns, though their conversation is answered.
    """
    prepare(turns.sparkSession)
    rows = _order(_lined(turns, conv, turn, role, text))
    light = rows.select("conv_id", "turn", "role", "begin", "digest", F.left("role", F.lit(1)).alias("initial"), fault(F.col("text")).alias("fault"), "times", F.sha2(F.to_json(F.struct("conv_id", F.hex("digest"))), 256).alias("key"))
    # Whether a turn says what an earlier number said; turns of one number that say the same are neighbours in the stream.
    said = light.filter("times > 0 AND fault <> 1").groupBy("key").agg(F.min(F.struct("turn")).alias("since"), F.count("*").alias("n")).filter("n > 1")
    said = saved(said.select("key", F.col("since.turn").alias("since"), "n"))
    hot = said.filter(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).alias("parts"))
    light = spread_join(light, said.select("key", "since", F.lit(True).alias("found")), "key", hot, "left")
    again = F.col("found").isNotNull() & F.col("turn").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("turn")))
    light = light.withColumn("again", again).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "begin", "digest")
    kind = turns.schema[conv].dataType.simpleString()
    return light.select("conv_id", "turn", "initial", "fault", "again", "digest", "times").mapInArrow(_audit_batches, f"conv_id {kind}, " + "".join(f"{s} long, " for s in STATS) + "audit string")


# --- second pass: the repaired turns ---------------------------------------------------------------


class _Applied:
    """Turns of one conversation, given one by one, as its audit has them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _inserted(self.state)
            yield "I", ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.state = NEXT[self.state, role[0]] if edit == "K" else _inserted(self.state)
            yield edit, role if edit == "K" else ROLE[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """(the audit's row, its repaired turns) of each conversation; the turns are to be read before the next one."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    head = next(rows, None)
    while head is not None:
        after: list[tuple] = []

        def turns(head: tuple = head, after: list[tuple] = after) -> Iterator[tuple[str, str, str]]:
            way = _Applied(head[4])
            for r in rows:
                if r[4] is not None:  # the next conversation's audit
                    after.append(r)
                    break
                for _ in range(r[3]):
                    yield from way.turn(r[1], r[2])
            yield from way.end()

        yield head, turns()
        head = after[0] if after else None


def _turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, schema = [], 0, None

    def typed(it):
        nonlocal schema
        for b in it:
            schema = schema or pa.schema([("conv_id", b.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            yield b

    for head, turns in _applied(typed(batches)):
        for i, (edit, role, text) in enumerate(turns):
            out.append((head[0], i, edit, role, text))
            size += len(text)
            if len(out) >= 1000 or size > 1 << 22:
                yield _flushed(out, schema)
                out, size = [], 0
    if out:
        yield _flushed(out, schema)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, schema = [], None

    def typed(it):
        nonlocal schema
        for b in it:
            schema = schema or pa.schema([("conv_id", b.schema.field(0).type), *((s, pa.int64()) for s in STATS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield b

    for head, turns in _applied(typed(batches)):
        h = hashlib.sha256()
        for i, (_, role, text) in enumerate(turns):
            h.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
        out.append((head[0], *head[5:], head[4], h.hexdigest()))
        if len(out) >= 1000:
            yield _flushed(out, schema)
            out = []
    if out:
        yield _flushed(out, schema)


def _beside(turns: DataFrame, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Turns in order, each conversation's audit before its first one."""
    rows = _order(_lined(turns, *names)).withColumn("kind", F.lit(1))
    both = rows.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "begin", "digest")
    return both.select("conv_id", "role", "text", "times", "audit", *STATS)


def repaired(turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation once ``found``, its ``audits``, are applied."""
    kind = turns.schema[conv].dataType.simpleString()
    return _beside(turns, found, (conv, turn, role, text)).mapInArrow(_turn_batches, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``found`` with ``repaired_sha256``, of the repaired turns as ``role:text``, joined by line ends."""
    kind = turns.schema[conv].dataType.simpleString()
    schema = f"conv_id {kind}, " + "".join(f"{s} long, " for s in STATS) + "audit string, repaired_sha256 string"
    return _beside(turns, found, (conv, turn, role, text)).mapInArrow(_digest_batches, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): conversations with a known share of faults, by a checksum of conversation and turn."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(n == 1, "").when(n == 2, F.translate(one("text"), ENDS, "")).otherwise(one("text"))
    role = F.when(n == 4, "user").otherwise(one("role"))
    return turns.select("conv_id", "turn", role.alias("role"), F.when(n == 0, "").otherwise(text).alias("text"), F.when(n == 0, 0).when(n == 3, 2).otherwise(1).alias("times"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the rule of the contract, then audited and repaired."""
    turns = damaged(table(spark, sf_dir, "conversations"))
    return digests(turns, audits(turns))
