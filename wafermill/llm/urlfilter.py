"""URL rules and lists: a blocked Bloom filter in front of an exact hash join.

Every entry (a rule or a listed site) becomes one canonical key, host plus path. A URL has few
possible keys: the last labels of its host times the beginnings of its path, for the label
counts and path lengths that entries have. The filter holds 256 bits a block and one bit in
each of its four words; keys that it passes go to a hash join with the entries themselves,
which removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The filter never has more blocks than this (16 MB sent to each executor), whatever the list's
#: length. A longer list only lets more false positives through to the exact join.
MOST_BLOCKS = 1 << 18
WORDS = 4


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _bits() -> list[Column]:
    """One bit of each of the four words, from different parts of a key's digest."""
    spread = F.xxhash64("_key", F.lit("bits"))
    at = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    # The function of the DataFrame API takes a fixed distance only; SQL's takes a column.
    return [F.call_function("shiftleft", F.lit(1).cast("long"), k) for k in at]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of ``keys(_key)``: one row per used block with its four words."""
    words = [F.bit_or(bit).alias(f"_w{i}") for i, bit in enumerate(_bits())]
    return keys.groupBy(_block(blocks).alias("_block")).agg(*words)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(blocks).cast("long"))


def _passed() -> Column:
    good = F.lit(True)
    for i, bit in enumerate(_bits()):
        good = good & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    return good


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judge every row of ``pages`` by its URL.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block); ``listed`` has ``host`` and
    ``path`` of sites or pages to block. An entry fits its host and all subdomains if the URL's
    path starts with the entry's. Among the rules the longest (host and path together; ties: the
    longer host, then block before allow) decides; without one, a listed entry blocks and
    anything else is allowed.

    Returns one row per row of ``pages``: the columns in ``keep``, ``host``, ``path``, ``rule``
    (host and path of the deciding rule, else null), ``verdict`` and ``listed`` (does a listed
    entry fit?). A null URL, or one without ``://``, has empty host and path and is allowed.
    Repeated rows stay repeated. Entries with a null or empty host are ignored, a null path
    counts as empty, repeated entries count once. An empty table gives an empty result, empty
    lists allow everything. Only the URL and ``keep`` are read of ``pages``, so other columns
    cannot clash.

    The URLs move once, in the join with the verdicts of distinct URLs; a hot URL is split there
    by the adaptive skew join, as the verdicts are a written table.
    """
    spark = pages.sparkSession
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    entry = [host.alias("_h"), path.alias("_p")]
    entries = (
        rules.select(*entry, F.col("verdict").alias("_v"))
        .union(listed.select(*entry, F.lit(None).cast("string")))
        .where("_h <> ''")
        .distinct()
        .select(F.concat("_h", "_p").alias("_key"), F.length("_h").alias("_n"), "_v", _labels(F.col("_h")).alias("_d"), F.length("_p").alias("_l"))
    )
    entries = stored(entries, "url-entries")
    # One row for each pair of label count and path length that occurs: their number is bounded
    # by how long hosts (253 characters) and listed paths are, not by how many entries there are.
    shapes = [(r["_d"], r["_l"]) for r in entries.select("_d", "_l").distinct().collect()]
    blocks = 1
    while blocks * 16 < entries.count() and blocks < MOST_BLOCKS:
        blocks *= 2
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*own, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        judged = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow")).withColumn("listed", F.lit(False))
    else:
        depth, length, n = _labels(F.col("host")), F.length("path"), F.col("host")
        keys = F.array(
            *[
                F.when((depth >= d) & (length >= size) & (n != ""), F.concat(F.substring_index("host", ".", -d), F.substring("path", 1, size)))
                for d, size in shapes
            ]
        )
        possible = (
            rows.select("host", "path", F.explode(F.array_compact(keys)).alias("_key"))
            .withColumn("_block", _block(blocks))
            .join(F.broadcast(bloom_filter(entries.select("_key").distinct(), blocks)), "_block")
            .where(_passed())
            .select("host", "path", "_key")
            .distinct()
        )
        ruled = F.col("_v").isNotNull()
        best = F.struct(F.length("_key"), F.col("_n"), (F.col("_v") == "block"), F.col("_key").alias("key"), F.col("_v").alias("verdict"))
        verdicts = (
            possible.join(entries.select("_key", "_n", "_v"), "_key")
            .groupBy("host", "path")
            .agg(F.max(F.when(ruled, best)).alias("_best"), F.bool_or(~ruled).alias("_listed"))
        )
        verdicts = stored(verdicts.select("host", "path", "_best.key", F.col("_best.verdict").alias("_verdict"), "_listed"), "url-verdicts")
        judged = rows.join(verdicts, ["host", "path"], "left").select(
            *[c for c in rows.columns],
            F.col("key").alias("rule"),
            F.coalesce("_verdict", F.when(F.col("_listed"), "block"), F.lit("allow")).alias("verdict"),
            F.coalesce("_listed", F.lit(False)).alias("listed"),
        )
    return judged.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict", "listed")
