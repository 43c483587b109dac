"""The corpus pipeline: stages over the documents table, each one of the numbered operators.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
the columns of documents; the last one returns token ids. All stages accept nulls in any column,
empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafermill.llm.bpe import encode_documents
from wafermill.llm.common import stored, table
from wafermill.llm.decontam import drop_leaks
from wafermill.llm.langid import UNDECIDED, identify, train
from wafermill.llm.simhash import drop_near_duplicates
from wafermill.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, empty, without letters, or mixed so that no language has
    half of the letters. A missing ``lang`` is filled in with the predicted one."""
    docs = docs.select(*COLUMNS)
    found = identify(docs, train(docs), keep=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs.select(*COLUMNS), similarity=0.8, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words or more that an earlier document has too. Texts that lose words
    become their other words, joined by one space; a document of which nothing is left goes."""
    found = remove_repeats(docs.select(*COLUMNS), window=13)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    kept = found.where((F.col("_n_removed") == 0) | (F.col("_kept") != ""))
    kept = kept.withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers, names or units."""
    return drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Removal of repeats could be said in SQL, but not language, fingerprints' components or templates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; each result is written before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
