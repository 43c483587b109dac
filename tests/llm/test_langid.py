"""Language identification: held-out accuracy, mixed texts, and the path against brute force."""

import itertools

import numpy as np

from wafermill.llm import langid, queries
from wafermill.llm.langid import best_path, identify, train

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, spans string"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op9_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def total(scores, labels, penalty):
    return sum(scores[i, x] for i, x in enumerate(labels)) - penalty * sum(a != b for a, b in itertools.pairwise(labels))


def plain_viterbi(scores, penalty):
    value = scores[0].copy()
    for row in scores[1:]:
        value = row + np.maximum(value, value.max() - penalty)
    return value.max()


def test_path_is_the_best(monkeypatch):
    rng = np.random.default_rng(4)
    for block in (3, 256):
        monkeypatch.setattr(langid, "BLOCK", block)
        sizes = np.array([1, 7, 0, 3, 20, 601, 4])
        scores = rng.normal(0, 3, (int(sizes.sum()), 3))
        labels = best_path(scores, sizes, 4.0)
        end = 0
        for n in sizes:
            part, own = scores[end : end + n], labels[end : end + n].tolist()
            end += n
            if n:
                assert np.isclose(total(part, own, 4.0), plain_viterbi(part, 4.0))
            if 0 < n <= 7:
                best = max(total(part, c, 4.0) for c in itertools.product(range(3), repeat=int(n)))
                assert np.isclose(total(part, own, 4.0), best)


def test_mixed_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    first = {r["lang"]: r["text"] for r in docs.where("length(text) > 600 and not text rlike '[0-9#$%&*|]'").orderBy("doc_id").collect()}
    mixed = first["en"][:300] + " " + first["de"][:900]
    rows = [(1, mixed, None, "x"), (2, None, "en", "x"), (3, "", "en", None), (4, "123 !!", "en", "x"), (None, "the and of with", None, "x"), (5, "Ж 漢", "en", "x"), (6, "the and of " * 30_000, "en", "x"), (6, "the and of " * 30_000, "en", "x")]
    got = {}
    for r in identify(spark.createDataFrame(rows, SCHEMA), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["lang_pred"] == "de" and {s["lang"] for s in got[1][0]["spans"]} >= {"en", "de"}
    assert abs(got[1][0]["score"] - 0.75) < 0.1
    assert [got[i][0]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[2][0]["score"] == 0
    assert got[None][0]["lang_pred"] == "en" and len(got[6]) == 2 and got[6][0]["lang_pred"] == "en"
    assert got[5][0]["lang_pred"] in model.languages
    assert identify(spark.createDataFrame([], SCHEMA), model).collect() == []
    nothing = train(spark.createDataFrame([], SCHEMA))
    assert [r["lang_pred"] for r in identify(docs.limit(2), nothing).collect()] == ["und", "und"]


def test_scripts_narrow(spark):
    rows = [(i, t, x, None) for i, (t, x) in enumerate([("мама мыла раму снова", "ru"), ("der die das und", "de"), ("the of and to", "en")] * 3)]
    model = train(spark.createDataFrame(rows, SCHEMA))
    got = identify(spark.createDataFrame([(1, "мыло the раму", None, None), (2, "die den der", None, None)], SCHEMA), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "ru", 2: "de"}
