"""Repeated lines against a plain version, with filters that hold next to nothing and odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF_DIR

from compare import compare, duck_connection
from wafermill.llm.lines import _masks, drop_repeated_lines, twice_seen

SCHEMA = "doc_id bigint, text string, key string, id string, gone string"
SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(parts)


def check(spark, rows, **more):
    got = drop_repeated_lines(frame(spark, rows), **more)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(slow(rows), key=order)


@pytest.mark.parametrize("words", [None, 4096, 1])
def test_random_lines(spark, words):
    rng = random.Random(3)
    pool = [f"Line number {k} of the pool{'É' * (k % 3)}" for k in range(80)] + ["short", "", "  ", "ééééééééé", "éééééééééé"]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 12))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\v ", "\f"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    check(spark, rows, words=words)


def test_odd_rows(spark):
    line = "the same line in many documents"
    rows = [(k, line) for k in range(400)] + [
        (5, line), (5, f"{line}\nand this one here"), (9, None), (9, ""), (None, line), (None, None), (-3, f"{line}\n{line}"),
        (700, "a very long line " * 60_000), (701, "A VERY long line " * 60_000 + "\n"), (702, "only here " * 5), (703, "\n\n\n"),
        (704, "no-break space ends here "), (705, "no-break space ends here"), (706, "İstanbul lines ÄÖ"), (707, "İstanbul lines äö"),
    ]
    check(spark, rows)


def test_keep_and_names(spark):
    docs = spark.createDataFrame([(1, "one line for all", "a"), (2, "One line for all ", "b"), (3, None, None)], "n int, body string, text string")
    got = drop_repeated_lines(docs, "n", "body", keep=("text",)).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, 0, "one line for all"), (2, "b", 1, 1, ""), (3, None, 1, 0, "")]


def test_empty_table(spark):
    assert drop_repeated_lines(frame(spark, [])).collect() == []


def test_filter_holds_all_repeats_and_little_else(spark):
    rows = [(k, f"a line of document {k}\na line that {k // 2} shares") for k in range(4000)]
    docs = frame(spark, rows, 16).selectExpr("doc_id AS id", "text")
    table = twice_seen(docs, 4096, 10)
    h = lambda keys: np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], np.uint64)
    passed = lambda x: (table[(x & np.uint64(4095)).astype(np.int64)] & _masks(x)) == _masks(x)
    assert passed(h([f"a line that {k} shares" for k in range(2000)])).all()
    assert passed(h([f"a line of document {k}" for k in range(4000)])).mean() < 0.1


def test_query_on_more_rows(spark):
    assert SF_DIR
    assert compare(spark, duck_connection("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op13_line_dedup") is None
