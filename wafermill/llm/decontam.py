"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

Documents and benchmark items are cut into windows of template words, and into windows of their own
words. A hash join finds equal windows, which count along one alignment: in the order of the item and
close together. A name that the item repeats must stand for one name there. So a question that was only given other numbers or names is found
as well as a literal copy.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import gathered_filter, slices, stored

TOKEN = re.compile(r"[^\W_]+(?:[.,'’-][^\W_]+)*|[.!?:;\n]")
NUMBER = re.compile(r"[+-]?\d[\d.,]*(?:st|nd|rd|th)?\Z")

# Words that count as numbers, and units that follow a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h "
    "hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh "
    "degree degrees celsius fahrenheit joule joules watt watts volt volts byte bytes kb mb gb tb".split()
)
LITERAL, NUM, NAME, UNIT = range(4)
#: 64-bit words of the filter of benchmark windows that travels with the tasks (4 MB). Windows
#: that it lets through by mistake are removed by the exact join.
FILTER_WORDS = 1 << 19
_MARKS = np.array([0, 0x9B1A615F2C7E9D01, 0x6C8E9CF570932BD5, 0xE19B01AA9D42C633], np.uint64)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _templates(texts: list[str | None]):
    """(text number, kind, template digest, own digest, word) of all template words of the texts, in order."""
    found = [TOKEN.findall(t or "") for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    place: dict[str, int] = {}
    at = np.fromiter((place.setdefault(w, len(place)) for f in found for w in f), np.int64, int(sizes.sum()))
    words = list(place)
    low = [w.lower() for w in words]
    n = len(words)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in low), np.uint64, n)
    stop = np.fromiter((len(w) == 1 and w in ".!?:;\n" for w in words), bool, n)
    number = np.fromiter((w in NUMBER_WORDS or bool(NUMBER.match(w)) for w in low), bool, n)
    unit = np.fromiter((w in UNITS for w in low), bool, n)
    # One capital and the rest small: words written all in capitals are no names.
    name = np.fromiter((len(w) > 1 and w[0].isupper() and w[1:] == w[1:].lower() for w in words), bool, n)
    text = np.repeat(np.arange(len(texts)), sizes)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, low
    opens = np.concatenate(([True], (text[1:] != text[:-1]) | stop[at[:-1]]))
    after = np.concatenate(([False], number[at[:-1]] & (text[1:] == text[:-1])))
    kind = np.where(number[at], NUM, np.where(unit[at] & after, UNIT, np.where(name[at] & ~opens, NAME, LITERAL)))
    keep = np.flatnonzero(~stop[at])
    text, at, kind = text[keep], at[keep], kind[keep]
    return text, kind, np.where(kind == LITERAL, digest[at], _MARKS[kind]), digest[at], at, low


def _windows(text, kind, digest, size: int, least: int, salt: int = 0):
    """(first word, two digests) of the windows of ``size`` words with at least ``least`` literal ones."""
    n = max(len(text) - size + 1, 0)
    one, two = np.full(n, size + salt, np.uint64), np.full(n, size + salt, np.uint64)
    for k in range(size):
        one = one * _BASES[0] + digest[k : k + n]
        two = (two ^ digest[k : k + n]) * _BASES[1] + (one >> np.uint64(29))
    literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    good = (text[:n] == text[size - 1 :][:n]) & (literal[size : size + n] - literal[:n] >= least)
    first = np.flatnonzero(good)
    return first, one[first], two[first]


def _bits(one, two):
    mixed = (one ^ (two >> np.uint64(31))) * _BASES[1]
    mask = (np.uint64(1) << (mixed & np.uint64(63))) | (np.uint64(1) << ((mixed >> np.uint64(6)) & np.uint64(63)))
    return ((mixed >> np.uint64(20)) % np.uint64(FILTER_WORDS)).astype(np.int64), mask


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


SCHEMA = "_id bigint, _row bigint, size int, pos bigint, one bigint, two bigint, own boolean, slots array<string>, words bigint, usable bigint"
#: Keeps digests of own words apart from those of template words.
OWN_SALT = 1 << 20


def _window_rows(part: pa.RecordBatch, window: int, sizes: list[int] | None, literals: int, bloom: np.ndarray | None):
    """Windows of a batch (``_id``, ``_row``, ``_text``): of template words, with at least ``literals``
    literal ones, and (``own``) of the words as they are, whatever their kind. ``usable`` counts the template
    windows of the text. Without ``sizes`` every text is cut into windows of min(its words, ``window``) words."""
    text, kind, template, plain, at, low = _templates(part.column("_text").to_pylist())
    counts = np.bincount(text, minlength=part.num_rows)
    begin = np.concatenate(([0], np.cumsum(counts)))
    for size in sizes if sizes is not None else range(1, window + 1):
        usable = None
        for own in (False, True):
            first, one, two = _windows(text, kind, plain if own else template, size, 0 if own else min(literals, size), OWN_SALT * own)
            if usable is None:
                usable = np.bincount(text[first], minlength=part.num_rows)
            if bloom is not None:
                where, mask = _bits(one, two)
                keep = np.flatnonzero(bloom[where] & mask == mask)
            else:
                keep = np.flatnonzero(np.minimum(counts[text[first]], window) == size)
            first, one, two = first[keep], one[keep], two[keep]
            if not len(first):
                continue
            slots = [[] if own else [f"{kind[j]}{low[at[j]]}" for j in range(a, a + size) if kind[j] != LITERAL] for a in first.tolist()]
            rows = text[first]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id").take(pa.array(rows)), part.column("_row").take(pa.array(rows)),
                    pa.array(np.full(len(first), size, np.int32)), pa.array(first - begin[rows]), _signed(one), _signed(two),
                    pa.array(np.full(len(first), own)), pa.array(slots, pa.list_(pa.string())), pa.array(counts[rows]), pa.array(usable[rows]),
                ],
                names=["_id", "_row", "size", "pos", "one", "two", "own", "slots", "words", "usable"],
            )


def _chain(found: list[tuple]) -> list[tuple]:
    """The most windows (place in the document, place in the item, ...) that follow each other in both."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(found)
    # Of windows at one place of the document one can count: later places of the item first.
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1]))
    for i in order:
        at = bisect_left(ends, found[i][1])
        before[i] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [found[i][1]], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(found[i])
        i = before[i]
    return out[::-1]


def _agreeing(found: list[tuple]) -> list[tuple]:
    """The windows (place in the document, place in the item, slots, item's slots) without those that were
    changed at a name which stands for several names in them."""
    stands: dict[str, set[str]] = {}
    for _, _, slots, own in found:
        for mine, other in zip(own, slots, strict=True):
            if mine.startswith(str(NAME)):
                stands.setdefault(mine, set()).add(other)
    return [f for f in found if f[2] == f[3] or all(len(stands.get(mine, ())) <= 1 for mine in f[3])]


def aligned(found: list[tuple]) -> Iterator[list[tuple]]:
    """Alignments of a stretch of a document: windows at one shift, and at all shifts in order."""
    shifts: dict[int, list[tuple]] = {}
    for f in found:
        shifts.setdefault(f[0] - f[1], []).append(f)
    for own in shifts.values():
        yield _agreeing(own)
    if len(shifts) > 1:
        yield _agreeing(_chain(found))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col), F.lit(2)).alias("_row"), F.col(text_col).alias("_text")
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    literals: int = 5,
    run: int = 6,
    share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item, literally or with other numbers, names or units.

    A window has ``window`` words; an item with fewer words is one window of its own length (items
    under four words cannot be told from chance and are left out). All windows are looked for with
    their own words; those with at least ``literals`` literal words also as templates, in which
    numbers, names and units stand for any others. A document is reported for an item if it holds,
    with the item's own words, ``run`` of the item's windows or ``share`` of all of them,
    whichever is less, or, as templates, ``run`` or ``share`` of those that can be templates.
    Windows count along one alignment of document and item: those at one shift, or those that follow
    each other in both, within a stretch of the document of twice the item's words. Numbers and units
    stand for any; windows of a name that stands for several names in the alignment count only
    with the item's own words.

    Returns ``id_col``, ``text_digest``, ``item_id``, ``n_windows`` (of the item, found
    along the best alignment), ``n_item_windows`` and ``literal`` (were all those found with the item's own words?). ``item_id`` is
    the smallest of the items with one text. Null texts hold nothing; rows with a null id are
    reported under it; rows are told apart by id and text, so repeated rows give one result.
    Empty tables on either side give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    least = min(4, window)
    # Equal items are one: the smallest id stands for them.
    items = benchmark.where(F.col(item_text_col).isNotNull()).groupBy(F.col(item_text_col).alias("_text")).agg(F.min(item_col).cast("bigint").alias("_id"))
    items = items.select("_id", F.lit(0).cast("bigint").alias("_row"), "_text")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text"):
                yield from _window_rows(part, window, None, literals, None)

    own = items.mapInArrow(item_windows, SCHEMA).where(F.col("size") >= least)
    own = stored(own.select("size", "one", "two", F.col("_id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "words", "usable"), "item-windows")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most ``window`` rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, mask = _bits(*(b.column(c).to_numpy().view(np.uint64) for c in ("one", "two")))
            yield pa.RecordBatch.from_arrays([pa.array(where), _signed(mask)], names=["word", "mask"])

    bloom = gathered_filter(own.select("one", "two").mapInArrow(bits, "word bigint, mask bigint"), FILTER_WORDS)
    sent = spark.sparkContext.broadcast(bloom)

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text"):
                yield from _window_rows(part, window, sizes, literals, sent.value)

    met = _keyed(docs, id_col, text_col).mapInArrow(doc_windows, SCHEMA).drop("words", "usable").join(own, ["size", "one", "two"]).distinct()
    met = stored(met.select("_id", "_row", "item_id", "pos", "item_pos", "own", "slots", "item_slots", "words", "usable", "size"), "leak-windows")
    # Stretches of twice the item's words that overlap by half: a copy with as many words put in is whole in one.
    stretch = F.floor(F.col("pos") / F.greatest(F.col("words"), F.lit(window)))
    near = met.withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    held = near.groupBy("_id", "_row", "item_id", "stretch").agg(
        F.collect_list(F.struct("pos", "item_pos", "own", "slots", "item_slots")).alias("found"),
        F.first(F.col("words") - F.col("size") + 1).cast("bigint").alias("n_item_windows"), F.first("usable").alias("usable"),
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, literals_ = [], [], []
            for k, (found, total, usable) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("found", "n_item_windows", "usable")), strict=True)):
                best = (0, False)
                template = {(f["pos"], f["item_pos"]) for f in found if not f["own"]}
                places = {(f["pos"], f["item_pos"]): (f["pos"], f["item_pos"], f["slots"], f["item_slots"]) for f in sorted(found, key=lambda f: f["own"])}
                for kept in aligned(list(places.values())):
                    n = len({f[1] for f in kept})
                    n_own = len({f[1] for f in kept if f[2] == f[3]})
                    n_template = len({f[1] for f in kept if f[:2] in template})
                    if n_own >= min(run, math.ceil(total * share)) or usable and n_template >= min(run, math.ceil(usable * share)):
                        best = max(best, (n, n == n_own))
                if best[0]:
                    rows.append(k)
                    counts.append(best[0])
                    literals_.append(best[1])
            part = batch.select(["_id", "_row", "item_id", "n_item_windows"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(counts, pa.int64()), pa.array(literals_, pa.bool_())], names=[*part.schema.names, "n_windows", "literal"]
            )

    passed = held.mapInArrow(counted, "_id bigint, _row bigint, item_id bigint, n_item_windows bigint, n_windows bigint, literal boolean")
    best = F.max(F.struct("n_windows", "literal", "n_item_windows")).alias("best")
    found = passed.groupBy("_id", "_row", "item_id").agg(best).select("_id", "_row", "item_id", "best.*")
    return found.select(F.col("_id").alias(id_col), F.col("_row").alias("text_digest"), "item_id", "n_windows", "n_item_windows", "literal")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that :func:`find_leaks` reports; all other rows stay unchanged."""
    bad = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    bad = bad.select(F.col(id_col).alias("_bad_id"), F.col("text_digest").alias("_bad_row")).distinct()
    return docs.join(
        bad, F.col(id_col).cast("bigint").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col), F.lit(2)) == F.col("_bad_row")), "left_anti"
    )
