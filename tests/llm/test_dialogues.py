"""Repair of conversations against a search that writes out whole audits, rows in every order."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from wafermill.llm import queries
from wafermill.llm.common import table
from wafermill.llm.dialogues import damaged, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, who string, pos int"
SPACE = " \t\n\v\f\r"
LEGAL = re.compile(r"(s?(ua)+)?")
#: Beginnings of legal role initials, so that the search may leave a dead end early.
BEGINNING = re.compile(r"s?(ua)*u?")


def slow_damage(rows):
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, ids


def slow_repair(rows):
    """Cost, audit and repaired rows by a search over whole partial repairs, row after row."""
    # role initials so far -> (cost, audit, lines)
    live = {"": (0, "", ())}
    name = {"u": "user", "a": "assistant"}

    def put(into, initials, value):
        if BEGINNING.fullmatch(initials):
            # All that the grammar remembers of them: nothing, the system row, or the last role.
            short = initials if initials in ("", "s") else "u" if initials[-1] == "u" else "ua"
            if short not in into or value[:2] < into[short][:2]:
                into[short] = value

    def inserts(state):
        while True:
            new = dict(state)
            for initials, (cost, audit, lines) in state.items():
                for x in "ua":
                    put(new, initials + x, (cost + 3, audit + "I", (*lines, f"{name[x]}:")))
            if new == state:
                return state
            state = new

    for role, text, fault in rows:
        new = {}
        for initials, (cost, audit, lines) in inserts(live).items():
            put(new, initials, (cost + 4, audit + "D", lines))
            if fault not in ("b", "d"):
                late = 3 if fault == "t" else 0
                if role[:1]:
                    put(new, initials + role[:1], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                for x in "ua":
                    put(new, initials + x, (cost + 3 + late, audit + "R", (*lines, f"{name[x]}:{text}")))
        live = new
    done = [v for initials, v in inserts(live).items() if LEGAL.fullmatch(initials)]
    return min(done)


def slow(rows, damage=True):
    kept, ids = slow_damage(rows) if damage else ([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    convs = defaultdict(list)
    for conv, *row in kept:
        convs[conv].append(row)
    out = []
    for conv in ids:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in own} - {None}
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = slow_repair([(r, x, f) for (_, r, x), f in zip(own, faults)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest))
    return out


ORDER = lambda r: (r[0] is None, r[0] or 0)


def check(spark, rows, damage=True, **more):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA).repartition(6)
    got = repair_conversations(damaged(df), lost="lost", **more) if damage else repair_conversations(df, **more)
    got, want = sorted(map(tuple, got.collect()), key=ORDER), sorted(slow(rows, damage), key=ORDER)
    assert got == want


def some_rows(rng, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", "Assistant", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "open end", "  ", "", None, "Done. \n", f"Number {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [9, 1, 0])
def test_random_conversations(spark, bits):
    check(spark, some_rows(random.Random(bits), 150, 9), stretch_bits=bits)


def test_long_conversation(spark):
    rows = some_rows(random.Random(5), 2, 700)
    check(spark, rows, stretch_bits=5)
    check(spark, rows, damage=False)


def test_odd_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [
        (lost, 1, "user", "Gone."), (None, None, None, None), (None, 1, "user", "Hi."), (2000, None, "user", "x" * 200_000),
        (2001, 5, "user", "Twice."), (2001, 5, "user", "Twice."), (2001, 9, "assistant", "ok.\x00"), (2002, -3, "système", "é."),
    ]
    check(spark, rows)
    assert slow([(lost, 1, "user", "Gone.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert repair_conversations(damaged(spark.createDataFrame([], SCHEMA)), lost="lost").collect() == []


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(slow(rows), key=ORDER)
    assert got.where(F.col("cost") > 0).count() > 10
