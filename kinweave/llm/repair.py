"""Repair of conversation structure by the lightest derivation of a good one.

Turns of a conversation are kept, given another role, deleted, or inserted without text, so that the initials of the roles
read ``(s?(ua)+)?`` and the edits cost least; among the cheapest, the edits whose initials come first in ASCII order win.

* An item ``(i, q)`` says: the first ``i`` rows are dealt with, and what was kept so far brought the grammar's automaton
  to state ``q``. Each edit is a deduction from one item to another, with a cost of its own and its initial. Items are
  popped from an agenda by (cost, audit), as in Knuth's generalisation of shortest paths: adding a cost of 0 or more, and a
  letter at the end, is monotone and never lessens the pair, so an item popped first is final. The goal item follows from
  the accepting states once all rows are dealt with; when it is popped the search ends.
* Monotone holds because two derivations of one item that cost the same never have one audit begin the other: the longer
  would only have more insertions, which cost. So lightest derivations can be joined from both sides.
* Rows are ranged by (conversation, turn, ...) and walked in order. A conversation that a task sees from end to end, of at
  most ``CHUNK`` rows, is repaired there. Any other is cut into pieces; for a piece the agenda runs from each of the
  four states, and pieces are then derived in order: ``(0, j, q')`` from ``(0, i, q)`` and the piece's ``(i, j, q, q')``.
  Their texts are repaired in parallel. What meets in one task for such a conversation are its audits (16 strings of its
  length) and, as a stream, its repaired texts, since a digest takes them one after the other.
* Repeated rows are told by a digest: the groups of more than one row are a table of one line each, joined to the rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinweave.functions.skew import join_by_key
from kinweave.llm.arrow import to_array
from kinweave.sources.shared import materialise

#: Rows and bytes of text that a piece of a conversation holds at most (a longer text is a piece by itself).
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Bytes of text that a range of rows holds about, and how many ranges there are at most.
RANGE_BYTES, RANGES = 8 << 20, 1 << 14
#: What edits cost; a truncated row that is not deleted costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: The automaton of ``(s?(ua)+)?``: at the start, after s, after u, after a.
START, S, U, A = range(4)
STEP = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
ACCEPT = (START, A)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Weight = tuple[int, str]


def fault_of(text: str, repeated: bool) -> int:
    shown = text.rstrip(_BLANKS)
    if not shown:
        return BLANK
    if repeated:
        return DUPLICATE
    return SOUND if shown[-1] in ".!?" else CUT


def lightest(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...] | None = None) -> dict[int, Weight]:
    """Cost and audit of the lightest way from state ``entry`` over all rows (role initial, fault) to each state, or with
    ``goals`` to the cheapest of those alone."""
    n = len(rows)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    done = [[False] * 4 for _ in range(n + 1)]
    out: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if done[i][state]:
            continue
        done[i][state] = True
        ways = STEP[state]
        if i == n:
            if goals is None:
                out[state] = (cost, audit)
                if len(out) == 4:
                    return out
            elif state in goals:
                return {state: (cost, audit)}
        else:
            initial, fault = rows[i]
            ahead = done[i + 1]
            if not ahead[state]:
                heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
            if fault != BLANK and fault != DUPLICATE:
                more = cost + (TRUNCATED if fault == CUT else 0)
                if initial in ways and not ahead[ways[initial]]:
                    heapq.heappush(agenda, (more, audit + "K", i + 1, ways[initial]))
                for new in "ua":
                    if new in ways and not ahead[ways[new]]:
                        heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, ways[new]))
        for new in "ua":
            if new in ways and not done[i][ways[new]]:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, ways[new]))
    return out


def applied(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits make of rows (role, text), beginning in ``state``."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            state = STEP[state][role[:1]]
        else:
            (initial,) = (x for x in STEP[state] if x in ROLE)
            role, state = ROLE[initial], STEP[state][initial]
        yield role, text


def derive(pieces: list[dict[tuple[int, int], Weight]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost and audit of a conversation from those of its pieces by (state before, state after), and for each piece the
    state before it and its part of the audit."""
    best: dict[int, Weight] = {START: (0, "")}
    came: list[dict[int, int]] = []
    for piece in pieces:
        new: dict[int, Weight] = {}
        before: dict[int, int] = {}
        for (a, b), (cost, audit) in piece.items():
            if a in best:
                weight = (best[a][0] + cost, best[a][1] + audit)
                if b not in new or weight < new[b]:
                    new[b], before[b] = weight, a
        # What all ways share is no longer compared.
        shared = len(os.path.commonprefix([w[1] for w in new.values()]))
        best = {b: (cost, audit[shared:]) for b, (cost, audit) in new.items()}
        came.append(before)
    state = min((best[s], s) for s in ACCEPT if s in best)[1]
    total, parts = best[state][0], []
    for piece, before in zip(reversed(pieces), reversed(came), strict=True):
        parts.append((before[state], piece[before[state], state][1]))
        state = before[state]
    parts.reverse()
    return total, "".join(p for _, p in parts), parts


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations as the contract damages them: by crc32(``conv_id:turn``) modulo 20,
    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes the role ``user``. A null role or
    text is one space, a null id or turn is one space in the checksum alone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _numbers(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STATE = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with ``repeated``: whether an equal role and text came earlier in the conversation. Rows are written first, so
    that the number that tells copies apart is the same each time it is read."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    noted = materialise(rows.withColumns({"digest": digest, "copy": F.monotonically_increasing_id()}), "turns").df
    group = noted.groupBy(F.struct(F.col("conv_id").alias("c")).alias("conv"), "digest")
    # Turn and copy as one number, which is reduced without sorting; a null turn comes before the smallest long.
    wide = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    place = F.coalesce(F.col("turn").cast("decimal(20,0)"), wide(-(1 << 63) - 1)) * wide(1 << 63) + F.col("copy").cast("decimal(20,0)")
    firsts = group.agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = join_by_key(noted.withColumn("conv", F.struct(F.col("conv_id").alias("c"))), firsts, ["conv", "digest"], "left")
    return both.select("conv_id", "turn", "role", "text", "digest", "copy", F.coalesce(place != F.col("first"), F.lit(False)).alias("repeated"))


class _Open:
    """The rows of one conversation that a task has seen since the last cut."""

    def __init__(self, part: int, number: int):
        self.part, self.number = part, number
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.size = 0
        self.low = self.high = None
        self.counts = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        fault = fault_of(text, repeated)
        initial = role[:1]
        if turn is not None:
            self.counts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.counts[("blank", "duplicate", "truncated")[fault - 1]] += 1
        if self.marks and self.marks[-1][0] + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.rows.append((role, text))
        self.marks.append((initial, fault))
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= CHUNK or self.size >= CHUNK_BYTES


def _said(rows: list[tuple[str, str]], audit: str, state: int) -> str:
    return "\n".join(f"{role}:{text}" for role, text in applied(rows, audit, state))


_WEIGHT = T.StructType([*_numbers("before", "after", "cost"), T.StructField("audit", T.StringType())])
_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _walked(key: T.StructField) -> T.StructType:
    """A line per repaired conversation (``whole``) or piece of one."""
    return T.StructType(
        [
            key, T.StructField("whole", T.BooleanType()), *_numbers("part", "number", *_STATE),
            T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), *_numbers("cost"),
            T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
            T.StructField("ways", T.ArrayType(_WEIGHT)), T.StructField("rows", T.ArrayType(_TURN)),
        ]
    )


def _records(lines: list[tuple], schema: T.StructType, kind: pa.DataType) -> pa.RecordBatch:
    """Lines as a batch; the first column, of any type, is a list of one-row arrays of type ``kind``."""
    columns = list(zip(*lines, strict=True))
    arrays = [pa.concat_arrays(columns[0]) if isinstance(columns[0][0], pa.Array) else to_array(columns[0], kind)]
    arrays += [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns[1:], schema.fields[1:], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _walk(schema: T.StructType):
    """Rows in order to lines of ``_walked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        held = 0
        now: _Open | None = None
        conv = kind = None
        edge, number = True, 0

        def close(ends: bool) -> None:
            """Hand on what is open; ``ends`` if the next row is another conversation's."""
            nonlocal now, number, held
            if now is None:
                return
            whole = ends and not edge and now.number == 0
            state = tuple({"low": now.low, "high": now.high, **now.counts}[c] for c in _STATE)
            ends_of = (now.marks[0][0], now.marks[-1][0])
            if whole:
                ((cost, audit),) = lightest(now.marks, START, ACCEPT).values()
                sha = hashlib.sha256(_said(now.rows, audit, START).encode()).hexdigest()
                lines.append((conv, True, now.part, 0, *state, *ends_of, cost, audit, sha, None, None))
            else:
                ways = [
                    {"before": a, "after": b, "cost": cost, "audit": audit}
                    for a in ((START,) if now.number == 0 and not edge else STEP) for b, (cost, audit) in lightest(now.marks, a).items()
                ]
                rows = [{"role": role, "text": text} for role, text in now.rows]
                lines.append((conv, False, now.part, now.number, *state, *ends_of, None, None, None, ways, rows))
                held += now.size
            number += 1
            now = None

        name = None
        for batch in batches:
            kind = batch.column(1).type
            parts, names, turns, roles, texts, repeated = (batch.column(k).to_pylist() for k in range(6))
            for row, part in enumerate(parts):
                if conv is None or names[row] != name:
                    close(True)
                    edge, number = conv is None, 0
                    conv, name = batch.column(1).slice(row, 1), names[row]
                if now is not None and now.full():
                    close(False)
                now = now or _Open(part, number)
                now.add(turns[row], roles[row], texts[row], repeated[row])
                if len(lines) >= 2000 or held >= CHUNK_BYTES:
                    yield _records(lines, schema, kind)
                    lines.clear()
                    held = 0
        close(False)
        if lines:
            yield _records(lines, schema, kind)

    return run


def _derived(pieces: DataFrame, key: T.StructField) -> DataFrame:
    """Of every conversation in pieces: a line per piece with ``before`` and ``audit``, and in that of the first piece the
    counts of the whole."""
    schema = T.StructType([key, *_numbers("part", "number", "before"), T.StructField("edits", T.StringType()), T.StructField("audit", T.StringType()), *_numbers(*_COUNTS)])
    # Texts stay behind: the columns of ``pieces`` that are read here are narrow but for the audits.
    ordered = pieces.select("conv_id", "part", "number", *_STATE, "first", "last", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        conv = kind = None

        def lines() -> pa.RecordBatch:
            cost, audit, parts = derive([{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in own])
            known = [p for p in own if p["low"] is not None]
            distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
            sums = [sum(p[c] for p in own) for c in ("blank", "duplicate", "truncated", "illegal")]
            sums[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
            out = [
                (conv, p["part"], p["number"], before, edits, *((audit, gaps, *sums, cost) if i == 0 else (None,) * 7))
                for i, (p, (before, edits)) in enumerate(zip(own, parts, strict=True))
            ]
            return _records(out, schema, kind)

        name = None
        for batch in batches:
            kind = batch.column(0).type
            for row, piece in enumerate(batch.to_pylist()):
                if conv is None or piece["conv_id"] != name:
                    if own:
                        yield lines()
                    own, conv, name = [], batch.column(0).slice(row, 1), piece["conv_id"]
                own.append(piece)
        if own:
            yield lines()

    return ordered.mapInArrow(run, schema)


def _digests(said: DataFrame, key: T.StructField) -> DataFrame:
    """``conv_id, repaired_sha256`` from the repaired pieces in order, streamed."""
    schema = T.StructType([key, T.StructField("repaired_sha256", T.StringType())])
    ordered = said.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = kind = name = sha = None
        some, lines = False, []
        for batch in batches:
            kind = batch.column(0).type
            for row, (own, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if conv is None or own != name:
                    if conv is not None:
                        lines.append((conv, sha.hexdigest()))
                    conv, name, sha, some = batch.column(0).slice(row, 1), own, hashlib.sha256(), False
                if text is not None:  # Null: the piece keeps no row.
                    sha.update((("\n" if some else "") + text).encode())
                    some = True
        if conv is not None:
            lines.append((conv, sha.hexdigest()))
        if lines:
            yield _records(lines, schema, kind)

    return ordered.mapInArrow(run, schema)


def _piece_texts(pieces: DataFrame, paths: DataFrame, key: T.StructField) -> DataFrame:
    schema = T.StructType([key, *_numbers("part", "number"), T.StructField("said", T.StringType())])
    joined = pieces.select("conv_id", "part", "number", "rows").join(paths.select("part", "number", "conv_id", "before", "edits").withColumnRenamed("conv_id", "c"), ["part", "number"])
    lines = joined.filter(F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "number", "rows", "before", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # A piece at a time: texts are large.
                p = batch.slice(row, 1).to_pylist()[0]
                turns = [(t["role"], t["text"]) for t in p["rows"]]
                kept = any(e != "D" for e in p["edits"])
                yield _records([(batch.column(0).slice(row, 1), p["part"], p["number"], _said(turns, p["edits"], p["before"]) if kept else None)], schema, batch.column(0).type)

    return lines.mapInArrow(run, schema)


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    Rows are ordered by turn (an integer; null first), then role, then the first 64 characters and the MD5 of role and
    text. A null role or text is one space. Rows with a null id are one conversation. A row's first fault counts: blank, a
    duplicate of an earlier row's role and text, truncated. Blank and duplicate rows can only be deleted. ``gaps`` are
    turns missing between the smallest and the largest one. No rows: no conversations.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    flagged = _flagged(rows)
    total = flagged.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, min(RANGES, -(-total // range_bytes)))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64)), F.col("digest"), F.col("copy")]
    ranged = flagged.repartitionByRange(n, *order).sortWithinPartitions(*order)
    key = rows.schema["conv_id"]
    schema = _walked(key)
    walked = ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "role", "text", "repeated").mapInArrow(_walk(schema), schema)
    lines = materialise(walked, "repairs").df
    gap = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps")
    whole = lines.filter("whole").select("conv_id", gap, *_COUNTS[1:], "audit", "repaired_sha256")
    pieces = lines.filter("NOT whole")
    paths = materialise(_derived(pieces, key), "paths").df
    digests = _digests(_piece_texts(pieces, paths, key), key).withColumnRenamed("conv_id", "c")
    totals = paths.filter("audit IS NOT NULL").select("conv_id", *_COUNTS, "audit")
    joined = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    return whole.unionByName(joined)


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """``repair`` of the rows that ``damaged`` leaves, with a line for every conversation of ``turns``: one without rows
    has zeros, an empty audit and the digest of an empty text."""
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
