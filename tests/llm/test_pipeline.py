"""The pipeline's stages: what goes, what stays, and the columns they return."""

import numpy as np
import public_tokenizers
from conftest import SF_DIR
from test_simhash import jaccard
from test_substrings import slow
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(df):
    return sorted((tuple(r) for r in df.select(*pipeline.COLUMNS).collect()), key=str)


def test_stages_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = pipeline.language_id(spark, docs, sf).cache()
    assert set(one.columns) == set(docs.columns)
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    # Every given document has a language.
    assert len(left) >= 0.99 * len(before) and all(before[i] == t for i, t in left.items())
    two = pipeline.near_dedup(spark, one, sf).cache()
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    assert len(set(kept.values())) == len(kept)
    by_text = {}
    for i, t in sorted(left.items()):
        by_text.setdefault(t, i)
    # What goes is a copy, or close to a text that stays or went for the same reason.
    for i in set(left) - set(kept):
        if by_text[left[i]] == i:
            assert max(jaccard(left[i], t) for j, t in left.items() if j != i) > 0.65, i
    three = pipeline.substring_dedup(spark, two, sf).cache()
    want = {i: t for i, n, gone, t in slow(list(kept.items()), 13) if gone and t} | {i: kept[i] for i, n, gone, t in slow(list(kept.items()), 13) if not gone}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == want
    four = pipeline.decontaminate(spark, three, sf).cache()
    clean = {r["doc_id"]: r["text"] for r in four.collect()}
    assert 0 < len(clean) < len(want) and all(want[i] == t for i, t in clean.items())
    five = pipeline.encode(spark, four, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in five:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(clean[r["doc_id"]], add_special_tokens=False).ids


def test_run_is_registered(spark):
    assert entry_module.queries()["pipeline"] is pipeline.run
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    got = pipeline.run(spark, SF_DIR)
    assert got.count() > 50 and {"doc_id", "n_tokens", "ids"} <= set(got.columns)


def test_odd_rows(spark):
    text = "the of and to in is that for it with as was on be at by this are from or an have not they which one you were all her she there would"
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "12 34 !!", None, "s", 8), (None, text, None, None, None), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (5, text + " " + "long " * 50_000, "en", None, 2)]
    docs = spark.createDataFrame(odd, SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        if name == "language":
            assert [r[0] for r in rows(docs)] == [4, 4, 5, None] or len(rows(docs)) == 4
        if name == "near_dedup":
            assert len(rows(docs)) == 2
        if name == "substring_dedup":
            assert docs.where("doc_id = 5").first()["n_chars"] == docs.where("doc_id = 5").first()["text"].__len__()
    assert docs.count() == 2
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, SF_DIR)
    assert none.collect() == []
