"""Decontamination against plain word windows, and re-parameterised questions."""

import re

from conftest import SF_DIR

from wafermill.llm import queries
from wafermill.llm.decontam import drop_leaks, find_leaks

DOCS = "doc_id bigint, text string, item_id bigint, slots string"
ITEMS = "item_id bigint, text string, words string"
ASK = "In the morning Anna bought 12 apples and 7 pears at the market, then she gave 5 apples to Bert before walking 3 km back home."


def ids(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def run(spark, docs, items):
    return ids(find_leaks(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)))


def test_query_equals_plain_windows(spark):
    words = lambda t: re.findall(r"[^\W_]+(?:[.,'’-][^\W_]+)*", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = ids(queries.QUERIES["op1_decontaminate"](spark, "/root/testdata/sf0.01"))
    # Whole items in a document are all found; nothing is found that shares few literal windows.
    for d, w in docs:
        own = grams(w, 6)
        for i, v in items:
            shared = len(own & grams(v, 6)) / max(1, len(grams(v, 6)))
            if shared > 0.9:
                assert (d, i) in got, (d, i, shared)
            if shared < 0.02:
                assert (d, i) not in got, (d, i, shared)
    assert SF_DIR and len(got) >= 20


def test_other_numbers_and_names(spark):
    other = ASK.replace("12", "30").replace("7", "eleven").replace("5", "9").replace("3 km", "8 miles").replace("Anna", "Carla").replace("Bert", "Dora")
    two_for_one = ASK.replace("5 apples to Bert", "5 apples to Anna")
    docs = [(1, "Some words first. " + other), (2, ASK.upper()), (3, "Nothing of this kind stands here, only a few other words about a market."), (4, None), (None, ASK), (5, ""), (6, "x " * 100_000 + ASK), (6, "x " * 100_000 + ASK)]
    assert run(spark, docs, [(1, ASK), (7, ASK), (2, None), (3, ""), (4, "of the")]) == {(1, 1), (2, 1), (None, 1), (6, 1)}
    # The item repeats a name; a document that puts two names there does not fit the item.
    twice = "On the first day Anna counted all the green apples, on the second day Anna counted all the green pears, on the last day Anna ate them."
    mixed = twice.replace("Anna", "Carla", 1).replace("Anna", "Dora", 1).replace("Anna", "Eve", 1)
    short = "the day Anna and Anna said so to everyone here"
    assert run(spark, [(1, twice.replace("Anna", "Carla"))], [(1, twice)]) == {(1, 1)}
    assert run(spark, [(1, mixed)], [(1, twice)]) == set()
    assert run(spark, [(1, short.replace("Anna", "Bea")), (2, short.replace("Anna", "Bea", 1))], [(1, short)]) == {(1, 1)}
    assert two_for_one != ASK


def test_empty_and_drop(spark):
    items = spark.createDataFrame([(1, ASK, "x")], ITEMS)
    docs = spark.createDataFrame([(1, ASK, 1, "x"), (1, "clean text", 1, "x"), (None, ASK, 1, "x"), (2, None, 1, "x")], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in drop_leaks(docs, items).collect()) == [(1, "clean text"), (2, None)]
    assert find_leaks(docs.where("false"), items).collect() == []
    assert find_leaks(docs, items.where("false")).collect() == []
    assert drop_leaks(docs, items.where("false")).count() == 4


def test_literal_copies_full_of_names_and_numbers(spark):
    items = [
        "The Treaty of Versailles was signed on June 28, 1919 by Germany and the Allied Powers.",
        "Who was the first President of the United States of America, George Washington or John Adams?",
        "Calculate 15 + 27 - 9 + 33.", "What is 12 times 7?", "Who wrote Romeo and Juliet?", "Convert 5 km 300 m to m.",
    ]
    docs = [(i, f"Some other words stand here. {t} And more words follow it.") for i, t in enumerate(items)]
    docs += [(10, items[0].upper()), (20, "What is 13 times 8?"), (21, "Calculate 15 + 27 - 9 + 34."), (22, "Who wrote Hamlet and Macbeth?")]
    assert run(spark, docs, list(enumerate(items))) == {(i, i) for i in range(6)} | {(10, 0)}


def test_numbers_may_coincide_and_windows_follow_each_other(spark):
    ask = "Anna has 12 green apples and 7 red pears in her basket, how many apples and pears are in the basket after 2 days if she eats 2 apples each day?"
    again = ask.replace("12", "9").replace("7", "9").replace("after 2", "after 3").replace("eats 2", "eats 4")
    parted = again.replace("how many", "so tell me now how many")
    assert run(spark, [(1, again), (2, parted)], [(1, ask)]) == {(1, 1), (2, 1)}
    # Single windows of an item, far apart or in another order, are no copy of it.
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    parts = [" ".join(words[8 * i : 8 * i + 8]) for i in range(8)]
    far = (" ".join(["filler"] * 300)).join(f" {p} " for p in parts)
    turned = " and ".join(reversed(parts))
    assert run(spark, [(1, far), (2, turned), (3, " ".join(words))], [(1, " ".join(words))]) == {(3, 1)}
