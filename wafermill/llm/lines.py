"""Repeated lines behind two Bloom filters: only suspected repeats are shuffled and confirmed.

Every task hashes the line keys of its documents into two blocked Bloom filters: keys seen once
and keys seen twice. Two tasks' filters are merged by words: what either holds twice, or both
hold at all, is twice-seen. A key of two documents is therefore always in the merged twice-seen
filter, so only keys that it passes leave their task; grouping them by the key itself removes the
false positives and finds the first document. Documents without a confirmed suspect never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.llm.common import discard, slices, stored

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bits of each filter for every line of the corpus, and bits that a key sets in its 64-bit word.
BITS_A_LINE = 16
BITS_A_KEY = 3

#: No filter is longer than this many 64-bit words (128 MB sent to each executor), whatever the
#: corpus. In a fuller filter more lines pass as suspects; the exact step gives the same rows.
MOST_WORDS = 1 << 24
STRETCH = 1 << 12
FLUSH = 1 << 20
FAN_IN = 1024


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode()) >= least)


def _keys(text: bytes | None, least: int) -> set[bytes]:
    found = {line_key(line) for line in (text or b"").split(b"\n")}
    return {k for k in found if _long_enough(k, least)}


def _masks(hashes: np.ndarray) -> np.ndarray:
    """The bits of each key in its word, from the upper parts of its hash."""
    out = np.zeros(len(hashes), np.uint64)
    for i in range(BITS_A_KEY):
        out |= np.uint64(1) << ((hashes >> np.uint64(40 + 6 * i)) & np.uint64(63))
    return out


def _packed(words: np.ndarray, once: np.ndarray, twice: np.ndarray, salt: int) -> pa.RecordBatch:
    """Used words of both filters as one row for each stretch of words."""
    stretch = (words // STRETCH).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]) if len(words) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(words)]
    inside = (words % STRETCH).astype("<u2")
    return pa.record_batch(
        {
            "stretch": pa.array(stretch[starts], pa.int64()),
            "salt": pa.array(np.full(len(starts), salt, np.int64)),
            "at": pa.array([inside[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "once": pa.array([once[a:b].astype("<u8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "twice": pa.array([twice[a:b].astype("<u8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
        }
    )


FILTER_SCHEMA = "stretch bigint, salt bigint, at binary, once binary, twice binary"


def _gather(hashes: list[int], words: int, salt: int) -> pa.RecordBatch:
    """Both filters of some keys: a hash that comes twice sets its bits in both."""
    unique, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
    at = unique & np.uint64(words - 1)
    order = np.argsort(at, kind="stable")
    at, masks, repeated = at[order], _masks(unique[order]), counts[order] > 1
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    once = np.bitwise_or.reduceat(masks, starts)
    twice = np.bitwise_or.reduceat(np.where(repeated, masks, np.uint64(0)), starts)
    return _packed(at[starts], once, twice, salt)


def _fill(words: int, least: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() // FAN_IN
        hashes: list[int] = []
        for batch in batches:
            for part in slices(batch, "text"):
                for i, text in zip(part.column("id").is_valid().to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    if i and text:
                        hashes.extend(xxhash.xxh64_intdigest(k) for k in _keys(text, least))
                        if len(hashes) >= FLUSH:
                            yield _gather(hashes, words, salt)
                            hashes = []
        if hashes:
            yield _gather(hashes, words, salt)

    return fill


def _merge(rows: pa.Table) -> pa.Table:
    """Merge stretches of both filters word by word."""
    once, twice = np.zeros(STRETCH, np.uint64), np.zeros(STRETCH, np.uint64)
    for at, o, t in zip(*(rows.column(c).to_pylist() for c in ("at", "once", "twice"))):
        at, o, t = np.frombuffer(at, "<u2"), np.frombuffer(o, "<u8"), np.frombuffer(t, "<u8")
        twice[at] |= t | (once[at] & o)
        once[at] |= o
    used = np.flatnonzero(once).astype(np.uint64)
    first = rows.column("stretch")[0].as_py()
    batch = _packed(used + np.uint64(first * STRETCH), once[used], twice[used], 0)
    return pa.Table.from_batches([batch])


def twice_seen(rows: DataFrame, words: int, least: int) -> np.ndarray:
    """The merged filter of keys seen twice in ``rows(id, text)``: 8 * ``words`` bytes. Tasks send
    used words only; they are merged in two steps, a thousand tasks at a time and then all."""
    parts = rows.mapInArrow(_fill(words, least), FILTER_SCHEMA)
    merged = parts.groupBy("stretch", "salt").applyInArrow(_merge, FILTER_SCHEMA)
    merged = merged.groupBy("stretch").applyInArrow(_merge, FILTER_SCHEMA)
    out = np.zeros(words, np.uint64)
    for row in merged.select("stretch", "at", "twice").toLocalIterator():
        at = np.frombuffer(row["at"], "<u2").astype(np.int64)
        out[row["stretch"] * STRETCH + at] = np.frombuffer(row["twice"], "<u8")
    return out


def _suspects(twice, least: int, schema: pa.Schema):
    """Add to every row the keys that the filter passes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = twice.value
        for batch in batches:
            for part in slices(batch, "text"):
                owner, keys = [], []
                for row, (i, text) in enumerate(zip(part.column("id").is_valid().to_pylist(), part.column("text").cast(pa.binary()).to_pylist())):
                    if i and text:
                        own = _keys(text, least)
                        keys.extend(own)
                        owner.extend([row] * len(own))
                hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
                masks = _masks(hashes)
                hit = np.flatnonzero((table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)] & masks) == masks)
                own: list[list[bytes]] = [[] for _ in range(part.num_rows)]
                for k in hit:
                    own[owner[k]].append(keys[k])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.list_(pa.binary()))], schema=schema)

    return find


def _cut(schema: pa.Schema):
    """Drop the lines whose key's digest is listed for the row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_lines, n_dropped, kept = [], [], []
                for text, listed in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("gone").to_pylist()):
                    lines = (text or b"").split(b"\n")
                    stay = lines
                    if listed:
                        gone = set(listed)
                        stay = [line for line in lines if xxhash.xxh3_128_digest(line_key(line)) not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                own = [part.column(i) for i in range(part.num_columns) if part.schema.field(i).name not in ("text", "gone")]
                results = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *results], schema=schema)

    return cut


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) with a 128-bit digest of the key beside it."""
    for batch in batches:
        digests = pa.array([xxhash.xxh3_128_digest(k) for k in batch.column("key").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), digests], names=["id", "key", "digest"])


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, keep: tuple[str, ...] = (), words: int | None = None
) -> DataFrame:
    """Drop the lines that an earlier document has too.

    A text is split at line feeds (null or empty: one empty line). A line's key is the line without
    space and the characters 9 to 13 at both ends, A-Z lower-cased. A key of at least ``least`` code
    points that is in two documents or more loses all its lines except those of the smallest id.

    Returns one row per row of ``docs``: the id, the columns in ``keep``, ``n_lines`` (before
    dropping), ``n_dropped`` and ``kept`` (the other lines, joined by line feeds; empty if none
    stay). Rows of one id are one document, so they keep each other's lines. Rows with a null id
    keep all lines and are no other document's first. An empty table gives an empty result. No
    column but the id, the text and ``keep`` is read, so other columns cannot clash; ``keep``
    must not name ``id_col`` or a column of the result.

    The filters grow with the number of lines up to ``MOST_WORDS``; ``words`` (a power of two)
    sets another length. A hot line is one row a document in a join with a written table, which
    the adaptive skew join splits; its first document comes from a pre-aggregated minimum.
    """
    spark = docs.sparkSession
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), *own, F.col(text_col).alias("text"))
    if words is None:
        lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        n = rows.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
        words = STRETCH
        while words * 64 < n * BITS_A_LINE and words < MOST_WORDS:
            words *= 2
    twice = spark.sparkContext.broadcast(twice_seen(rows.select("id", "text"), words, least))

    marked_type = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.BinaryType()))])
    marked = rows.mapInArrow(_suspects(twice, least, _arrow(marked_type)), marked_type)
    id_type = rows.schema["id"].dataType.simpleString()
    suspects = marked.select("id", F.explode("keys").alias("key"))
    firsts = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = stored(firsts.select("key", "first"), "line-firsts")
    gone = (
        suspects.join(firsts, "key")
        .where(F.col("id") > F.col("first"))
        .select("id", "key")
        .mapInArrow(_digested, f"id {id_type}, key binary, digest binary")
        .groupBy("id")
        .agg(F.collect_set("digest").alias("gone"))
    )
    gone = stored(gone.withColumnRenamed("id", "gone_id"), "line-gone")
    discard(firsts)

    moved = marked.where(F.size("keys") > 0).drop("keys")
    moved = moved.join(gone, F.col("id") == F.col("gone_id"), "left").drop("gone_id")
    still = marked.where(F.size("keys") == 0).drop("keys").withColumn("gone", F.lit(None).cast("array<binary>"))
    result_type = T.StructType(
        [f for f in rows.schema.fields if f.name != "text"]
        + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    )
    cut = moved.unionByName(still).mapInArrow(_cut(_arrow(result_type)), result_type)
    return cut.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_lines", "n_dropped", "kept")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
