"""Substring removal against plain windows, on texts that stress runs, edges and copies."""

import random
import re

from conftest import SF_DIR

from compare import duck_connection, compare
from wafermill.llm.substrings import remove_repeats

SCHEMA = "doc_id bigint, text string, _id string"


def slow(rows, window):
    """(id, text) rows -> list of (words, removed, kept text) in the order of the rows."""
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, t), words in zip(rows, split):
        if i is not None and t is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, t), words in zip(rows, split):
        gone = set()
        if i is not None and t is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def check(spark, rows, window=13):
    got = remove_repeats(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(5), window)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted([(r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in got.collect()], key=key) == sorted(slow(rows, window), key=key)


def test_runs_few_words_and_shifts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        kind = i % 4
        if kind == 0:
            words = [w for _ in range(rng.randint(1, 8)) for w in [rng.choice("ab")] * rng.randint(1, 20)]
        elif kind == 1:
            words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        else:
            words = [rng.choice(["of", "the", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 80))]
        if rows and rng.random() < 0.6:
            other = (rng.choice(rows)[1] or "").split()
            if other:
                a = rng.randrange(len(other))
                at = rng.randint(0, len(words))
                words[at:at] = other[a : a + rng.randint(10, 40)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    check(spark, rows)


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [
        (5, passage), (5, passage), (5, "x " + passage), (1, None), (2, ""), (3, " \n "), (None, passage), (9, passage + " z"),
        (7, "short text"), (8, "short text"), (4, "w " * 50_000), (6, "w " * 30_000 + passage),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_more_rows(spark):
    assert SF_DIR
    assert compare(spark, duck_connection("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op5_substring_dedup") is None
