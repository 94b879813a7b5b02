"""Repair of conversations at least cost, with equal endings worked out once.

Each row of a conversation is a letter: its role's initial, in capitals if its text breaks off, or ``x``
if it must go. What is cheapest from a place on depends on the letters that follow and on the state of the
grammar ``(s?(ua)+)?`` alone, so signatures share their ends: in the order of the signatures read backwards,
each differs from the one before in what comes before their common end, and a stack of the nodes of that end,
with the cost to go and the first edit of the best audit for each state, is all an automaton of shared suffixes
needs to be held. Every node is worked out once in a task, for all conversations of all tasks' ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States of the grammar: at the start, after ``s``, after ``u``, after ``a``. By state: the initials that may
#: be kept and where they lead, and where a row made user or assistant leads.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}

#: Costs of the edits, and of a broken-off text that stays.
DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5

# A node: by state the cost to go, the first edit of the best audit, and the state after it.
Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]

_LETTERS = "suao"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def node(letter: str | None, below: Node | None) -> Node:
    """The node of a letter before a suffix, or that of the empty suffix.

    An edit is the least by cost, then by its letter: from one state no two edits have the same.
    """
    best: list[tuple[float, str, int]] = []
    for state in range(4):
        if below is None or letter is None:
            best.append((0, "", state) if state in (0, 3) else (float("inf"), "~", state))
            continue
        to_go, options = below[0], [(DELETE + below[0][state], "D", state)]
        if letter != "x":
            extra = BROKEN if letter.isupper() else 0
            kept = KEEPS[state].get(letter.lower())
            if kept is not None:
                options.append((extra + to_go[kept], "K", kept))
            options.append((REROLE + extra + to_go[MADE[state]], "R", MADE[state]))
        best.append(min(options))
    # Insertions lead to another state of the same node, and cost too much to go in circles.
    for _ in range(3):
        for state in range(4):
            best[state] = min(best[state], (INSERT + best[MADE[state]][0], "I", MADE[state]))
    costs, edits, states = zip(*best, strict=True)
    return tuple(int(c) for c in costs), edits, states


def audits(reversed_signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature; given in order, backwards, each node is made once."""
    path, before = [node(None, None)], ""
    for back in reversed_signatures:
        shared = 0
        for one, other in zip(before, back, strict=False):
            if one != other:
                break
            shared += 1
        del path[shared + 1 :]
        for letter in back[shared:]:
            path.append(node(letter, path[-1]))
        before, depth, state, edits = back, len(back), 0, []
        while edit := path[depth][1][state]:
            edits.append(edit)
            state = path[depth][2][state]
            depth -= edit != "I"
        yield path[-1][0][0], "".join(edits)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by the checksum of ``conv_id:turn`` modulo 20; nulls read as one space.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
    filled = rows.select(
        "conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), kind.alias("_kind")
    )
    return filled.where("_kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """The columns that order a conversation's rows: turn (nulls first), role, digest of the text."""
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _filled("role").alias("role"),
        F.unhex(F.sha2(_filled("text"), 256)).alias("digest"),
        _filled("text").alias("text"),
    )


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "digest")]
    return rows.repartition("conv_id").sortWithinPartitions(*by)


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_COUNTED = (*_FACTS, "cost")


def _stream(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, start: Callable[..., Any], add: Callable, end: Callable
) -> Iterator[pa.RecordBatch]:
    """Walk over rows in the order of their first column, holding one group's state at a time."""
    state, current = None, None
    for batch in batches:
        made: list[dict] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or row[0] != current:
                if state is not None:
                    made += end(current, state)
                state, current = start(), row[0]
            made += add(state, row) or ()
        yield pa.RecordBatch.from_pylist(made, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist(end(current, state), schema=schema)


def _arrow(kind: T.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def signatures(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``ids`` (which may repeat): its ``signature`` and the counts of its faults.

    Texts do not move: rows are counted by turn, role and the digest of their text first, so that repeated rows
    are one, and then go by conversation as an initial and a fault each.
    """
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    initial = F.substring("role", 1, 1)
    facts = _ordered(rows).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("who"),
        F.when(ends == "", "blank").when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"),
    )
    known = ids.select("conv_id").select(
        "conv_id", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns[1:]]
    )
    # A row without an initial stands for the id alone.
    counted = facts.unionByName(known).groupBy(*facts.columns).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    repeated = (F.row_number().over(earlier) > 1) & F.col("who").isNotNull()
    marked = counted.withColumn(
        "fault", F.when(F.col("fault") == "blank", "blank").when(repeated, "duplicate").otherwise(F.col("fault"))
    )
    narrow = _in_order(marked).select("conv_id", "turn", "who", "fault", "n")

    schema = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("signature", T.StringType()),
            *[T.StructField(c, T.LongType()) for c in _FACTS],
        ]
    )
    arrow = _arrow(schema)

    def start() -> dict:
        return {"letters": [], "last": None, "turns": 0, "low": None, "high": None} | dict.fromkeys(_FACTS, 0)

    def add(state: dict, row: tuple) -> None:
        _, turn, who, fault, n = row
        if who is None:
            return
        if turn is not None and turn != state["high"]:
            state["low"] = turn if state["low"] is None else state["low"]
            state["high"], state["turns"] = turn, state["turns"] + 1
        state["illegal"] += state["last"] is not None and (state["last"], who) not in _LEGAL
        state["illegal"] += n - 1
        state["last"] = who
        if fault:
            state[fault] += 1
        letter = "x" if fault in ("blank", "duplicate") else who.upper() if fault else who
        state["letters"].append(letter + "x" * (n - 1))
        state["blank" if fault == "blank" else "duplicate"] += n - 1

    def end(conv_id: Any, state: dict) -> list[dict]:
        if state["turns"]:
            # At most what a long can hold.
            state["gaps"] = min(state["high"] - state["low"] + 1 - state["turns"], (1 << 63) - 1)
        facts = {c: state[c] for c in _FACTS}
        return [{"conv_id": conv_id, "signature": "".join(state["letters"])} | facts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stream(batches, arrow, start, add, end)

    return narrow.mapInArrow(run, schema)


def priced(signed: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of each distinct signature, dealt out in the order they have backwards."""
    back = signed.select(F.reverse("signature").alias("back")).distinct()
    back = back.repartitionByRange("back").sortWithinPartitions("back")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One walk over all batches of a task: the path of the last signature goes on.
        pending: list[str] = []

        def given() -> Iterator[str]:
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    pending.append(value)
                    yield value

        rows: list[tuple] = []
        for cost, audit in audits(given()):
            rows.append((pending.pop()[::-1], cost, audit))
            if len(rows) == 5000:
                yield _priced_batch(rows)
                rows = []
        yield _priced_batch(rows)

    return back.mapInArrow(run, "signature string, cost long, audit string")


def _priced_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["signature", "cost", "audit"])


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: its faults, the least ``cost`` of its repair, and the ``audit``.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not looked at. Nulls in role and
    text read as one space; a null id is a conversation too. Rows of one turn go by role, then by the SHA-256
    of the text. ``ids`` names further conversations, which may have no rows: those have zeros and an empty
    audit. Each edit of the audit is Keep, Rerole, Delete or Insert; of the cheapest, the least in ASCII.
    """
    signed = signatures(rows, rows if ids is None else ids)
    return signed.join(priced(signed), "signature").drop("signature")


def _repaired(rows: DataFrame, planned: DataFrame, schema: T.StructType, digest: bool) -> DataFrame:
    head = F.struct(*_COUNTED, "audit").alias("head")
    heads = planned.select("conv_id", F.lit(0).alias("kind"), head)
    texts = _ordered(rows).withColumn("kind", F.lit(1))
    both = heads.unionByName(texts, allowMissingColumns=True)
    given = _in_order(both, "kind").select("conv_id", "head", "role", "text")
    arrow = _arrow(schema)

    def start() -> dict:
        return {"head": None, "at": 0, "state": 0, "place": 0, "hash": hashlib.sha256()}

    def put(state: dict, conv_id: Any, edit: str, role: str, text: str) -> list[dict]:
        place, state["place"] = state["place"], state["place"] + 1
        if digest:
            state["hash"].update(f"{chr(10) if place else ''}{role}:{text}".encode())
            return []
        return [{"conv_id": conv_id, "place": place, "role": role, "text": text, "edit": edit}]

    def inserted(state: dict, conv_id: Any) -> list[dict]:
        made, audit = [], state["head"]["audit"]
        while state["at"] < len(audit) and audit[state["at"]] == "I":
            state["at"], state["state"] = state["at"] + 1, MADE[state["state"]]
            made += put(state, conv_id, "I", NAMES[state["state"]], "")
        return made

    def add(state: dict, row: tuple) -> list[dict]:
        conv_id, head, role, text = row
        if head is not None:
            state["head"] = head
            return []
        made = inserted(state, conv_id)
        edit = state["head"]["audit"][state["at"]]
        state["at"] += 1
        if edit == "K":
            state["state"] = KEEPS[state["state"]][role[0]]
            made += put(state, conv_id, edit, role, text)
        elif edit == "R":
            state["state"] = MADE[state["state"]]
            made += put(state, conv_id, edit, NAMES[state["state"]], text)
        return made

    def end(conv_id: Any, state: dict) -> list[dict]:
        made = inserted(state, conv_id)
        if not digest:
            return made
        return [{"conv_id": conv_id, **state["head"], "repaired_sha256": state["hash"].hexdigest()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stream(batches, arrow, start, add, end)

    return given.mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: ``conv_id, place, role, text, edit``.

    ``place`` counts from 0. What was inserted has an empty text. See :func:`plans` for what rows may hold.
    """
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("place", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")],
        ]
    )
    return _repaired(rows, plans(rows), schema, digest=False)


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """:func:`plans`, with ``repaired_sha256``, the digest of the repaired ``role:text`` joined by line ends.

    A digest is made in order, so the rows of one conversation go through one task, a batch at a time.
    """
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            *[T.StructField(c, T.LongType()) for c in _COUNTED],
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
        ]
    )
    return _repaired(rows, plans(rows, ids), schema, digest=True)
