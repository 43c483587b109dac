"""Repeated substrings by recompression: names of runs and pairs reveal long repeats.

Every word has a name, its digest. Naming goes in rounds: a run of one word gets a name, then
neighbouring names are joined to pairs, twice. Which neighbours join depends on their names
alone, so equal substrings get equal names inside, wherever they stand; a name is a digest of
what it stands for, hence the same in every task. Each window of words picks the longest such
symbol that its own words determine, and neighbouring windows with one pick form a span, which
is named in turn. Spark then counts names over the whole corpus:

1. spans that occur in several documents settle all their windows in all documents but the
   first;
2. what is left (the ends of repeats, and the first documents) is compared window by window,
   but only where the picked symbol also occurs in another document in another span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.llm.common import discard, gathered_filter, slices, stored

#: 64-bit words of the filter that travels with the tasks (16 MB). More names than it can tell
#: apart only let more rows through to the exact join.
FILTER_WORDS = 1 << 21
# Odd multipliers of the digests.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BASES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _paired(name, side, start, end, weight, left, right):
    """One round: join a symbol of the left side with a following one of the right side."""
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~side[:-1] & side[1:]
    taken = np.zeros(len(name), bool)
    taken[1:] = joins[:-1]
    first = np.flatnonzero(~taken)
    two = joins[first]
    second = np.minimum(first + 1, len(name) - 1)
    last = np.where(two, second, first)
    names = np.where(two, _mix(name[first] * _A + _mix(name[second]) + np.uint64(1)), name[first])
    return names, start[first], end[last], weight[first] + np.where(two, weight[second], 0), left[first], right[last]


@dataclass
class Spans:
    """Spans of a batch of texts: windows ``first`` to ``last`` of text ``doc``, by word number."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    symbol: np.ndarray
    name: np.ndarray
    begin: np.ndarray
    digests: tuple[np.ndarray, np.ndarray]


def find_spans(words: list[list[bytes]], window: int) -> Spans:
    """Cut the windows of the texts (lists of words) into spans and name them."""
    counts = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh3_64_intdigest
    flat = [w for text in words for w in text]
    # One gap before, between and after the texts, with a name that nothing else has.
    begin = np.cumsum(counts + 1) - counts
    total = int(counts.sum()) + len(words) + 1
    is_word = np.ones(total, bool)
    is_word[0] = False
    is_word[begin + counts] = False
    word = np.empty(total, np.uint64)
    word[is_word] = np.array(list(map(digest, flat)), np.uint64)
    word[~is_word] = np.arange(total - len(flat), dtype=np.uint64)
    size = np.zeros(total, np.int64)
    size[is_word] = np.fromiter(map(len, flat), np.int64, len(flat))

    # Runs of one word.
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    end = np.concatenate((start[1:], [total]))
    name = _mix(word[start] + _mix((end - start).astype(np.uint64)))
    weight = np.add.reduceat(size, start)
    # What a name depends on: one word more on each side shows where a run ends and which side joins.
    left, right = start - 1, end + 1
    side = (_mix(word[start]) & np.uint64(1)).astype(bool)
    name, start, end, weight, left, right = _paired(name, side, start, end, weight, left, right)
    # In the second round a name also depends on the symbols beside it.
    left = np.concatenate(([-1], left[:-1]))
    right = np.concatenate((right[1:], [total + 1]))
    side = (_mix(name ^ _A) & np.uint64(1)).astype(bool)
    name, start, end, weight, left, right = _paired(name, side, start, end, weight, left, right)

    gaps = np.concatenate(([0], np.cumsum(~is_word)))
    at = np.arange(max(total - window + 1, 0))
    at = at[gaps[at + window] == gaps[at]]
    low, high = np.searchsorted(left, at), np.searchsorted(right, at + window, side="right")
    best = np.full(len(at), -1)
    rank = (np.minimum(weight, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (name >> np.uint64(16))
    top = np.zeros(len(at), np.uint64)
    for k in range(int((high - low).max(initial=0))):
        j = low + k
        seen = np.flatnonzero(j < high)
        better = seen[rank[j[seen]] > top[seen]]
        best[better], top[better] = j[better], rank[j[better]]
    # Windows that determine no symbol stand for themselves.
    best = np.where(best < 0, -1 - at, best)

    prefix, back = [], []
    for base, source in zip(_BASES, (word, _mix(word ^ _B)), strict=True):
        power = np.cumprod(np.full(total, base, np.uint64))
        inverse = np.cumprod(np.full(total, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        prefix.append(np.concatenate(([np.uint64(0)], np.cumsum(source * power, dtype=np.uint64))))
        back.append(inverse)

    def digests(which, a, b):
        return _mix((prefix[which][b] - prefix[which][a]) * back[which][a] + (b - a).astype(np.uint64) * _A)

    windows = tuple(digests(k, at, at + window) for k in (0, 1))
    if not len(at):
        none, names = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Spans(none, none, none, names, names, none, (names, names))
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)))
    opens = np.flatnonzero(new)
    closes = np.concatenate((opens[1:], [len(at)])) - 1
    first, last, pick = at[opens], at[closes], best[opens]
    own = pick < 0
    safe = np.where(own, 0, pick)
    # All words that a symbol depends on stand for it: they lie in every window that picks it.
    symbol = np.where(own, windows[0][opens], digests(0, np.maximum(left[safe], 0), np.minimum(right[safe], total)))
    offset = np.where(own, 0, start[safe] - first).astype(np.uint64)
    named = _mix(digests(1, first, last + window) + _mix(offset + np.uint64(7)))
    doc = np.searchsorted(begin, first, side="right") - 1
    return Spans(doc, first - begin[doc], last - begin[doc], symbol, named, opens, windows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _filter_bits(symbol: np.ndarray, name: np.ndarray, doc: np.ndarray | None = None):
    """Filter word and mask (three bits) of a span, or of a span in a given document."""
    h = _mix(symbol * _A + name)
    if doc is not None:
        h = _mix(h + doc.astype(np.int64).view(np.uint64) * _C)
    where = (h % np.uint64(FILTER_WORDS)).astype(np.int64)
    h = _mix(h)
    mask = np.zeros(len(h), np.uint64)
    for k in range(3):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return where, mask


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """(``_id``, ``_row``, ``_from``, ``_to``): word ranges covered by repeated windows.

    ``rows`` has ``_id`` (not null), ``_row`` (a digest of the row) and ``_text``.
    """
    spark = rows.sparkSession

    def parsed(batches):
        for whole in batches:
            for part in slices(whole, "_text"):
                yield part, find_spans([(t or "").encode().split() for t in part.column("_text").to_pylist()], window)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spans in parsed(batches):
            doc = part.column("_id").to_numpy()[spans.doc]
            # Of copies inside a batch only the first and the last document matter.
            order = np.lexsort((doc, spans.name, spans.symbol))
            s, n, d = spans.symbol[order], spans.name[order], doc[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
            opens = np.flatnonzero(new)
            closes = np.append(opens[1:], len(s))[: len(opens)] - 1
            keep = np.concatenate((opens, closes[d[closes] != d[opens]]))
            yield pa.RecordBatch.from_arrays([_signed(s[keep]), _signed(n[keep]), pa.array(d[keep], pa.int64())], names=["symbol", "name", "doc"])

    # Round 1: names over the whole corpus. One exchange serves both counts.
    named = rows.mapInArrow(names, "symbol bigint, name bigint, doc bigint").repartition("symbol")
    spans = named.groupBy("symbol", "name").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    symbols = named.groupBy("symbol").agg(
        ((F.min("doc") < F.max("doc")) & (F.min("name") < F.max("name"))).alias("check")
    )
    shared = stored(spans.join(symbols, "symbol").where("lo < hi OR check"), "span-names")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbol, name = (b.column(c).to_numpy().view(np.uint64) for c in ("symbol", "name"))
            lo, hi, check = b.column("lo").to_numpy(), b.column("hi").to_numpy(), b.column("check").to_numpy(zero_copy_only=False)
            both, some = lo < hi, check.astype(bool)
            w1, m1 = _filter_bits(symbol[both], name[both])
            w2, m2 = _filter_bits(symbol[some], name[some], lo[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((w1, w2))), _signed(np.concatenate((m1, m2)))], names=["word", "mask"])

    bloom = gathered_filter(shared.mapInArrow(bits, "word bigint, mask bigint"), FILTER_WORDS)
    sent = spark.sparkContext.broadcast(bloom)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = sent.value
        for part, s in parsed(batches):
            doc = part.column("_id").to_numpy()[s.doc]
            where, mask = _filter_bits(s.symbol, s.name)
            common = passed[where] & mask == mask
            where, mask = _filter_bits(s.symbol, s.name, doc)
            check = passed[where] & mask == mask
            keep = np.flatnonzero(common | check)
            sizes = np.where(check[keep], s.last[keep] - s.first[keep] + 1, 0)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            inside = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(s.begin[keep], sizes)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(d[inside])) for d in s.digests]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(s.symbol[keep]), _signed(s.name[keep]), pa.array(doc[keep], pa.int64()), part.column("_row").take(pa.array(s.doc[keep])),
                    pa.array(s.first[keep], pa.int64()), pa.array(s.last[keep], pa.int64()), *lists,
                ],
                names=["symbol", "name", "doc", "_row", "first", "last", "one", "two"],
            )

    schema = "symbol bigint, name bigint, doc bigint, _row bigint, first bigint, last bigint, one array<bigint>, two array<bigint>"
    # Round 2: spans of later documents are settled, first documents go on to be checked.
    met = rows.mapInArrow(occurrences, schema).join(shared, ["symbol", "name"]).where("doc > lo OR check")
    late = F.col("doc") > F.col("lo")
    met = stored(
        met.select("doc", "_row", "first", "last", late.alias("late"), F.when(~late, F.col("one")).alias("one"), F.when(~late, F.col("two")).alias("two")),
        "span-hits",
    )
    discard(shared)
    settled = met.where("late").select("doc", "_row", "first", "last")
    left = met.where("NOT late").select(
        "doc", "_row", "first", F.posexplode(F.arrays_zip("one", "two")).alias("i", "w")
    ).select("doc", "_row", (F.col("first") + F.col("i")).alias("first"), "w.one", "w.two")
    # Round 3: single windows. The table of repeated ones is written out, so that both sides of
    # the join are plain exchanges and a hot window can be split.
    repeated = stored(
        left.groupBy("one", "two").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi"), "windows"
    )
    single = left.join(repeated, ["one", "two"]).where("doc > lo").select("doc", "_row", "first", F.col("first").alias("last"))
    return settled.union(single).select(
        F.col("doc").alias("_id"), "_row", F.col("first").alias("_from"), (F.col("last") + window).alias("_to")
    )


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_n_words``, ``_n_removed`` and ``_kept``: texts without repeated substrings.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller id; windows are
    judged on the input. ``_kept`` joins the words that stay by one space.

    A null text has no words and gives the empty string. Rows with a null id neither remove
    nor lose words. Repeated rows, and different texts under one id, are judged row by row;
    rows of one id never remove from each other. Texts shorter than a window stay whole. Other
    columns pass through (their names must not be the three new ones). An empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(F.col(text_col), F.lit(1))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("_id"), row.alias("_row"), F.col(text_col).alias("_text")
    )
    found = repeated_spans(rows, window).distinct()
    ranges = found.groupBy("_id", "_row").agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))
    ranges = ranges.withColumn("_id", F.col("_id").cast(kind))
    whole = docs.withColumn("_row", row)
    joined = whole.join(ranges, (whole[id_col] == ranges["_id"]) & (whole["_row"] == ranges["_row"]), "left").select(
        *[whole[c] for c in docs.columns], "_ranges"
    )
    extra = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept", T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col):
                counts, removed, kept = [], [], []
                for text, ranges in zip(part.column(text_col).to_pylist(), part.column("_ranges").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    stay = np.ones(len(words), bool)
                    for r in ranges or ():
                        stay[r["_from"] : r["_to"]] = False
                    left = [words[i] for i in np.flatnonzero(stay)] if ranges else words
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                columns = [part.column(c) for c in part.schema.names if c != "_ranges"]
                names = [c for c in part.schema.names if c != "_ranges"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=[*names, "_n_words", "_n_removed", "_kept"],
                )

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *extra]))
