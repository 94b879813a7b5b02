"""Repairs against all edit scripts of small conversations, and the query against a plain version."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm import conversations, queries

GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = " \t\n\v\f\r"
ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def all_scripts(letters):
    """The best of every script with at most two insertions in a place, by trying them all."""
    best = None
    inserts = ("", "I", "II")
    choices = [["D"] if c == "x" else ["K", "D", "Ru", "Ra"] for c in letters]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(letters) + 1):
            for names in itertools.product("ua", repeat=sum(map(len, gaps))):
                name, audit, made, cost = iter(names), [], [], 0
                for i, gap in enumerate(gaps):
                    for _ in gap:
                        audit.append("I")
                        made.append(next(name))
                        cost += 5
                    if i < len(letters):
                        edit, c = edits[i], letters[i]
                        audit.append(edit[0])
                        cost += {"K": 0, "D": 2, "R": 1}[edit[0]] + 5 * (c.isupper() and edit != "D")
                        made += [] if edit == "D" else [c.lower() if edit == "K" else edit[1]]
                if GRAMMAR.fullmatch("".join(made)):
                    best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
    return best


def plain_repair(letters):
    """Cost and audit by going through the rows from each place and state, with whole strings."""
    allowed = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def go(i, state, room):
        found = [(0, "")] if i == len(letters) and state in ("", "a") else []
        make = "a" if state == "u" else "u"
        if room:
            found += [(c + 5, "I" + a) for c, a in go(i, make, room - 1)]
        if i < len(letters):
            c, extra = letters[i], 5 * letters[i].isupper()
            found += [(n + 2, "D" + a) for n, a in go(i + 1, state, 3)]
            if c != "x":
                found += [(n + 1 + extra, "R" + a) for n, a in go(i + 1, make, 3)]
                if c.lower() in allowed[state]:
                    found += [(n + extra, "K" + a) for n, a in go(i + 1, c.lower(), 3)]
        return [min(found)] if found else []

    return go(0, "", 3)[0]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row] * (2 if kind == 3 else 1)
    return out


def plain_report(rows, ids):
    """What the query returns, one conversation after another."""
    groups = {i: [] for i in ids}
    for row in rows:
        groups[row[0]].append(row)
    out = {}
    for conv, given in groups.items():
        given.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        turns = {r[1] for r in given} - {None}
        counts, letters, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, _, role, text in given:
            ends = text.rstrip(BLANK)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = (
                "blank" if not ends else "duplicate" if (role, text) in seen
                else "truncated" if ends[-1] not in ".!?" else None
            )
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(given))
        cost, audit = plain_repair(letters)
        made, state, at = [], "", iter(given)
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            state = row[2][0] if edit == "K" else "a" if state == "u" else "u"
            role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            made.append(f"{role}:{row[3] if row else ''}")
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": illegal, "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest(),
        }
    return out


def priced(signatures):
    backwards = sorted({s[::-1] for s in signatures})
    return dict(zip((b[::-1] for b in backwards), conversations.audits(iter(backwards)), strict=True))


def test_least_of_all_scripts():
    letters = ["".join(x) for n in range(4) for x in itertools.product("suaoxUS", repeat=n)]
    found = priced(letters)
    for signature in random.Random(1).sample(letters, 40) + ["", "x", "s", "u", "a", "o", "U"]:
        assert found[signature] == all_scripts(signature) == plain_repair(signature), signature


def test_long_signatures():
    draw = random.Random(2)
    letters = ["".join(draw.choice("suauauaoxUAS") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    letters += ["ua" * n for n in range(40)] + ["u" * 90, "x" * 90, "a" * 90]
    assert priced(letters) == {s: plain_repair(s) for s in letters}


def test_common_ends_are_worked_out_once(monkeypatch):
    made = []
    plain = conversations.node
    monkeypatch.setattr(conversations, "node", lambda *x: made.append(x) or plain(*x))
    letters = ["ua" * n for n in range(40)] + ["s" + "ua" * n for n in range(40)]
    priced(letters)
    assert len(made) == 1 + len({s[i:] for s in letters for i in range(len(s))})


ODD = [
    (1, None, None, None), (1, None, "user", "A."), (1, 0, "system", "S."), (1, 3, "user", "B"), (1, 3, "user", "B"),
    (None, 1, "user", "Hi."), (None, None, "tool", "x."), (None, 2, "assistant", " \t\n"), (2, 5, "", "é!"),
    (3, -(1 << 63), "user", "Q?"), (3, (1 << 63) - 1, "assistant", "A. \n"), (4, 1, "usher", "x. "),
    *[(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(40)],
    *[(6, 7, "user", "same.")] * 50,
    *[(i, 0, "user", "Hi.") for i in range(100, 160)],
]


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    rows = spark.createDataFrame(ODD, ROWS).withColumn("head", F.lit(1)).withColumn("signature", F.lit("z"))
    given = plain_damage(ODD) if damage else [(c, t, r or (" " if r is None else ""), " " if x is None else x) for c, t, r, x in ODD]
    found = conversations.report(conversations.damaged(rows) if damage else rows, rows)
    expected = plain_report(given, {r[0] for r in ODD})
    if not damage:
        expected[3]["gaps"] = (1 << 63) - 1
    else:
        for report in expected.values():
            report["gaps"] = min(report["gaps"], (1 << 63) - 1)
    assert {r.conv_id: {k: r[k] for k in expected[1]} for r in found.collect()} == expected


def test_no_rows(spark):
    rows = spark.createDataFrame([], ROWS)
    assert conversations.report(rows).count() == conversations.repaired(rows).count() == 0
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in conversations.report(rows, ids).collect()} == {(i, 0, 0, 0, 0, 0, 0, "", empty) for i in (7, None)}


def test_repaired_turns(spark):
    rows = spark.createDataFrame(ODD, ROWS)
    turns = {}
    for r in conversations.repaired(rows).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for report in conversations.report(rows).collect():
        made = sorted(turns.get(report.conv_id, []))
        assert [m[0] for m in made] == list(range(len(made)))
        assert GRAMMAR.fullmatch("".join(role[0] for _, role, _ in made))
        text = "\n".join(f"{role}:{text}" for _, role, text in made)
        assert hashlib.sha256(text.encode()).hexdigest() == report.repaired_sha256


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*ROWS.names).collect()]
    expected = plain_report(plain_damage(rows), {r[0] for r in rows})
    found = queries.op13_conversations(spark, sf_dir).collect()
    assert len(found) == len(expected)
    assert {r.conv_id: {k: r[k] for k in expected[r.conv_id]} for r in found} == expected
