"""Spelling variants against a plain dictionary of words with a letter left out."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_DIR

from wafermill.llm import queries
from wafermill.llm.common import table
from wafermill.llm.spelling import group_variants, trie_nodes, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, least=7):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def slow_near(counts):
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    return near


def slow_groups(counts, ratio=10):
    near, form = slow_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def check(spark, counts, parts=5):
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n bigint, path string, id int").repartition(parts)
    got = group_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(counts) and set(rows) == slow_groups(counts)


def test_few_letters(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(900)}
    check(spark, {w: rng.choice([1, 2, 5, 10, 50, 100, 1000, 20_000]) for w in words}, 12)


def test_runs_chains_and_long_words(spark):
    counts = {"aaaaaaaa": 3, "aaaaaaaaa": 30, "aaaaaaaaaa": 300, "aaaaaaaaaaa": 3000, "aaaaaaabaaaa": 30_000, "ÿ" * 9: 2, "ÿ" * 8 + "þ": 20}
    counts |= {"x" * 3000 + "y" + "z" * 3000: 4, "x" * 3000 + "z" * 3000: 50, "alone": 7}
    check(spark, counts)


def test_tie_takes_the_smaller_word(spark):
    check(spark, {"letters": 1, "lettérs": 10, "letterz": 10, "better": 10, "etters": 10})


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    df = spark.createDataFrame([(w, 1) for w in words], "path string, n bigint").repartitionByRange(9, "path")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["path"]: r["nodes"] for r in trie_nodes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbers = defaultdict(set)
    for w in words:
        assert len(got[w]) == len(w)
        for k, x in enumerate(got[w]):
            numbers[w[: k + 1]].add(x)
    assert all(len(x) == 1 for x in numbers.values())
    assert len({min(x) for x in numbers.values()}) == len(numbers)
    assert [got[w][-1] for w in words] == sorted(got[w][-1] for w in words)
    assert len({x >> 40 for w in words for x in got[w]}) > 3


def test_counts_of_odd_texts(spark):
    rows = [(1, "Déjàvus déjàvus; DÉJÀVUS short words_andlonger"), (None, "Nothing nothing"), (2, None), (3, ""), (4, "a" * 300_000), (5, "Straßenbahn×÷ ŒuvreŒ naïveté٣naïveté" * 400), (5, "again " * 9)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, word string")
    assert {tuple(r) for r in word_counts(df).collect()} == set(slow_counts(rows).items())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert group_variants(word_counts(docs)).collect() == []
    odd = spark.createDataFrame([(None, 3), ("", 4), ("word", None), ("alone", 1)], "word string, n bigint")
    assert [tuple(r) for r in group_variants(odd).collect()] == [("alone", None, "alone", 1, 0, None)]


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_spelling_variants"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n")
    counts = {w: n for w, n in slow_counts(docs).items() if n >= 2}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(counts) and set(rows) == slow_groups(counts)
    assert any(r[1] for r in rows)
