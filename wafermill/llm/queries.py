"""The named queries of this subpackage: one per operator, over the whole of its table.

Each query calls its operator with production parameters and derives the digest columns that
the comparison needs. ``ORACLES`` holds DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafermill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    from wafermill.llm.bpe import encode_documents

    got = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# The rules of the comparison, and listed sites that the rules leave open.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URL_LISTED = [
    ("ads-track.example.com", "/"), ("spam-farm.example.org", "/"), ("casino-win.example.net", "/"),
    ("adult-x.example.com", "/"), ("cheap-pills.example.net", "/"), ("cheap-pills.example.com", "/"),
    ("free-bets.example.net", "/"),
]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    from wafermill.llm.urlfilter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(URL_LISTED, "host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, listed)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


ORACLES["op8_url_filter"] = f"""
WITH rules(h, p, v) AS (VALUES {_values(URL_RULES)}),
listed(h, p) AS (VALUES {_values(URL_LISTED)}),
parts AS (
    SELECT page_id,
           translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
judged AS (
    SELECT u.host, u.path,
           arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
    FROM urls u JOIN rules r ON ('.' || u.host) LIKE ('%.' || r.h) AND starts_with(u.path, r.p)
    GROUP BY ALL),
hit AS (
    SELECT DISTINCT u.host, u.path
    FROM urls u JOIN listed l ON ('.' || u.host) LIKE ('%.' || l.h) AND starts_with(u.path, l.p))
SELECT page_id, a.host, a.path, rule,
       coalesce(v, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       h.host IS NOT NULL AS listed
FROM parts a LEFT JOIN judged j ON a.host = j.host AND a.path = j.path
LEFT JOIN hit h ON a.host = h.host AND a.path = h.path
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document of its component."""
    from wafermill.llm.simhash import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many go as repeats, and a digest of what stays."""
    from wafermill.llm.substrings import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return got.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLES["op5_substring_dedup"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT k, min(doc_id) AS lo FROM windows GROUP BY k),
gone AS (
    SELECT DISTINCT doc_id, i + j AS p
    FROM (SELECT w.doc_id, i FROM windows w JOIN firsts f ON w.k = f.k WHERE w.doc_id > f.lo), range(13) r(j)),
kept AS (
    SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.p) AS t, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) d
    ANTI JOIN gone g ON g.doc_id = d.doc_id AND g.p = d.p
    GROUP BY d.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""


@query
def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to a Huffman-coded file and read them back."""
    from wafermill.llm.tokenfile import read_token_file, write_token_file
    from wafermill.session import scratch_path

    path = scratch_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_file(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def held_out():
    """One document in five is never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from four fifths of the labelled ones."""
    from wafermill.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it."""
    from wafermill.llm.decontam import find_leaks

    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "n_windows", "n_item_windows", "literal")


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    from wafermill.llm.htmltext import extract_text

    got = extract_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with what they save and how their wording differs."""
    from wafermill.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every twentieth vector."""
    from wafermill.llm.neighbours import nearest_neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go as repeats, and a digest of what stays."""
    from wafermill.llm.lines import drop_repeated_lines

    got = drop_repeated_lines(table(spark, sf_dir, "documents"), least=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
    SELECT doc_id, p, line,
           translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
firsts AS (
    SELECT k, min(doc_id) AS lo FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (doc_id > lo))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (lo IS NULL OR doc_id <= lo), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k
GROUP BY doc_id
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the audit of its cheapest repair."""
    from wafermill.llm.dialogues import damaged, repair_conversations

    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), lost="lost")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter lost, and the frequent word that each is a variant of."""
    from wafermill.llm.spelling import group_variants, word_counts

    counts = word_counts(table(spark, sf_dir, "documents"), least=7, erase=31).where("n >= 2")
    return group_variants(counts, ratio=10)
