"""SimHash fingerprints and their near pairs through a vantage-point tree.

Each node of the tree splits fingerprints by their Hamming distance to a vantage point. Two
fingerprints within ``radius`` of each other have distances to it that differ by ``radius`` at
most, so a fingerprint only has to visit the other side of a split if it lies that close to the
boundary: everything else is pruned. The leaves are shards. Every distinct fingerprint lives in
one leaf and is sent as a guest to the leaves that its ball overlaps; exact distances are taken
inside a leaf only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.llm.common import discard, slices, stored
from wafermill.plans.components import connected_components

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints that shape the tree (those with the smallest digests). All fingerprints are sorted into it.
TREE_SAMPLE = 8192
#: Fingerprints a shard should hold; most residents and guests of one cell (a shard with more, which
#: distances do not split, is cut into blocks); size from which distances are taken without
#: splitting further.
LEAF, MOST, SMALL = 32768, 131072, 1024
#: A split is worth it if at most this share of the points would have to visit both sides.
WORTH = 0.8


#: Odd numbers that turn a shingle's hash into further hashes, for fingerprints over 64 bits.
TURNS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every word shingle of a text; A-Z count as small letters."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    wide = max(len(words) - width + 1, 1)
    spans = zip(starts[:wide].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of a text as a signed number."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 5, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", words: int = 1) -> DataFrame:
    """The columns in ``keep`` and the fingerprint of every row: ``fp`` (signed 64 bits), ``more`` (further
    64-bit words up to ``words``, as bytes) and ``shingles`` (how many there are).

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are ``width`` words
    joined by one space and count as often as they occur. A text with fewer words is one shingle; a
    null text or one without words has fingerprint 0. Whole texts, no shuffle.
    """
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*own, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text"):
                prints, more, sizes = [], [], []
                for text in part.column("_text").to_pylist():
                    hashes = shingle_hashes(text, width)
                    prints.append(majority(hashes))
                    others = []
                    for turn in TURNS[1:words]:
                        mixed = (hashes ^ (hashes >> np.uint64(31))) * turn
                        others.append(majority((mixed ^ (mixed >> np.uint64(29))) * TURNS[1]))
                    more.append(np.array(others, "<i8").tobytes())
                    sizes.append(len(hashes))
                columns = [part.column(f"_k{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(prints, pa.int64()), pa.array(more, pa.binary()), pa.array(sizes, pa.int64())],
                    names=[*(f"_k{i}" for i in range(len(keep))), "fp", "more", "shingles"],
                )

    kinds = [T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = T.StructType([*kinds, T.StructField("fp", T.LongType()), T.StructField("more", T.BinaryType()), T.StructField("shingles", T.LongType())])
    return rows.mapInArrow(run, out).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "fp", "more", "shingles")


class VantageTree:
    """The top of a vantage-point tree as arrays, small enough to travel with the tasks."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros(1 << depth, np.uint64)
        self.cut = np.full(1 << depth, 64, np.int64)
        held = {1: np.unique(sample)}
        for node in range(1, 1 << depth):
            points = held.pop(node, np.zeros(0, np.uint64))
            found = _split(points, radius) if len(points) else None
            if found is not None:
                self.vantage[node], self.cut[node] = found
            inner = np.bitwise_count(points ^ self.vantage[node]) <= self.cut[node]
            held[2 * node], held[2 * node + 1] = points[inner], points[~inner]

    def route(self, prints: np.ndarray, guests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, guest) for the home leaf of each fingerprint and the leaves it visits, or, for
        ``guests``, all leaves that its ball overlaps.

        A link across a boundary is found by its inner end visiting the outer side, so residents
        of the outer side need not visit the inner one.
        """
        row, node = np.arange(len(prints)), np.ones(len(prints), np.int64)
        guest = np.full(len(prints), guests)
        for _ in range(self.depth):
            far = np.bitwise_count(prints[row] ^ self.vantage[node]).astype(np.int64)
            cut = self.cut[node]
            inner, near = far <= cut, far > cut - self.radius
            into_inner = inner | (guest & (far <= cut + self.radius))
            into_outer = ~inner | near
            row, node, guest = (
                np.concatenate((row[into_inner], row[into_outer])),
                np.concatenate((2 * node[into_inner], 2 * node[into_outer] + 1)),
                np.concatenate((guest[into_inner], guest[into_outer] | inner[into_outer])),
            )
        return row, node, guest


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and distance with the fewest points at the boundary, halves being 1 to 2 at
    most; nothing if even then most points are at the boundary, so that the bounds prune nothing."""
    best = None
    for v in points[:: max(1, len(points) // 12)]:
        below = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65))
        for cut in range(64):
            small = min(below[cut], len(points) - below[cut])
            # Points whose ball reaches over the boundary have to visit both sides.
            both = below[min(cut + radius, 64)] - (below[cut - radius] if cut >= radius else 0)
            key = (small * 3 < len(points), both if small * 3 >= len(points) else -small, cut)
            if best is None or key < best[0]:
                best = (key, v, cut, both, small)
    _, v, cut, both, small = best
    return (v, cut) if small and both <= WORTH * len(points) else None


@dataclass
class Prints:
    """Fingerprints of a cell: first words, further words, numbers of shingles."""

    first: np.ndarray
    more: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Prints:
        first = table.column("fp").to_numpy().view(np.uint64)
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), "<u8")
        more = more.reshape(len(first), len(more) // max(1, len(first)))
        return Prints(first, more, table.column("shingles").to_numpy())


@dataclass(frozen=True)
class Rule:
    """Two fingerprints link if their first words differ in ``radius`` bits at most, all words in
    ``total``, and the numbers of shingles are within ``ratio`` of each other (0: any)."""

    radius: int
    total: int | None = None
    ratio: float = 0.0

    def exact(self, a: Prints, i: int, b: Prints, near: np.ndarray) -> np.ndarray:
        """Which of ``near`` (close in their first word) link with row ``i``."""
        if self.total is not None:
            bits = np.bitwise_count(a.first[i] ^ b.first[near]).astype(np.int64) + np.bitwise_count(a.more[i] ^ b.more[near]).sum(axis=1, dtype=np.int64)
            near = near[bits <= self.total]
        if self.ratio:
            small, large = np.minimum(a.sizes[i], b.sizes[near]), np.maximum(a.sizes[i], b.sizes[near])
            near = near[small >= self.ratio * large]
        return near

    def bucket(self, sizes: np.ndarray) -> np.ndarray:
        """Linked fingerprints are in one bucket of sizes or in neighbouring ones."""
        if not self.ratio:
            return np.zeros(len(sizes), np.int64)
        return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(self.ratio)).astype(np.int64) + (sizes > 0)


def _links(data: Prints, guests: Prints, among: bool, rule: Rule) -> list[tuple[bool, int, int]]:
    """(is a guest, row, data row) links that join the same fingerprints as all pairs that the rule
    links do, about one per fingerprint.

    Guests are compared with the data; data among themselves if ``among``. The shard is split by
    vantage points in memory, with the same bounds as the tree above it.
    """
    radius = rule.radius
    label = np.arange(len(data.first))
    met: list[tuple[int, int]] = []

    def merge(members: np.ndarray) -> int:
        found = np.unique(label[members])
        for other in found[1:]:
            label[label == other] = found[0]
        return int(found[0])

    def visit(own: np.ndarray, sent: np.ndarray, again: np.ndarray, within: bool) -> None:
        """Compare ``own`` with itself (if ``within``), with guests ``sent`` and with data ``again``."""
        found = _split(data.first[own[:: max(1, len(own) // 4096)]], radius) if len(own) > SMALL else None
        if found is not None:
            vantage, cut = found
            far = np.bitwise_count(data.first[own] ^ vantage).astype(np.int64)
            inner = far <= cut
            if inner.any() and not inner.all():
                sides = []
                for values, which in ((data.first, again), (guests.first, sent)):
                    gone = np.bitwise_count(values[which] ^ vantage).astype(np.int64)
                    sides.append((which[gone <= cut + radius], which[gone > cut - radius]))
                # A link across the boundary is found by its inner end on the outer side.
                edge = own[inner & (far > cut - radius)] if within else own[:0]
                visit(own[inner], sides[1][0], sides[0][0], within)
                visit(own[~inner], sides[1][1], np.concatenate((sides[0][1], edge)), within)
                return
        here = data.first[own][None, :]
        for values, which, guest in ((data, np.concatenate((own, again)) if within else again, False), (guests, sent, True)):
            for at in range(0, len(which), 256):
                rows = which[at : at + 256]
                close = np.bitwise_count(values.first[rows][:, None] ^ here) <= radius
                for i in np.flatnonzero(close.any(axis=1)):
                    near = own[np.flatnonzero(close[i])]
                    if not guest:
                        near = near[label[near] != label[rows[i]]]
                    near = rule.exact(values, rows[i], data, near)
                    if guest and len(near):
                        met.append((int(rows[i]), merge(near)))
                    elif len(near):
                        merge(np.append(near, rows[i]))

    visit(np.arange(len(data.first)), np.arange(len(guests.first)), np.zeros(0, np.int64), among)
    return [(False, int(i), int(k)) for i, k in enumerate(label) if i != k] + [(True, i, int(label[k])) for i, k in met]


def near_links(prints: DataFrame, rule: Rule) -> DataFrame:
    """Links (``u``, ``v``) between ``node`` numbers that connect the distinct fingerprints
    ``prints(node, fp, more, shingles)`` as all pairs that the rule links would: every fingerprint
    with a partner has a link, dense groups give one link a member and not all pairs.

    Shards with many residents (dense groups that no distance splits) are cut into blocks of about
    MOST residents and as many guests, so that a task's cell stays small whatever the data.
    """
    total = prints.count()
    sample = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = min(max(0, int(np.ceil(np.log2(max(total, 1) / LEAF)))), 11)
    tree = VantageTree(sample, depth, rule.radius)
    leaves = 2 << depth

    def routed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, guest): a shard is a bucket of sizes and a leaf."""
        values = batch.column("fp").to_numpy().view(np.uint64)
        bucket = rule.bucket(batch.column("shingles").to_numpy())
        row, leaf, guest = tree.route(values)
        shard = bucket[row] * leaves + leaf
        if rule.ratio:
            # Larger partners are met in the next bucket.
            row2, leaf2, guest2 = tree.route(values, guests=True)
            row, guest = np.concatenate((row, row2)), np.concatenate((guest, guest2))
            shard = np.concatenate((shard, (bucket[row2] + 1) * leaves + leaf2))
        return row, shard, guest

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                _, shard, guest = routed(batch.slice(at, 4096))
                for g in (0, 1):
                    n = np.bincount(shard[guest == g], minlength=len(sums[g]))
                    n[: len(sums[g])] += sums[g]
                    sums[g] = n
        for g in (0, 1):
            used = np.flatnonzero(sums[g])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), g)), pa.array(sums[g][used])], names=["shard", "guest", "n"])

    # At most two rows a shard: 2,048 leaves, and a bucket for each power of 1 / ratio.
    sizes = prints.mapInArrow(counted, "shard bigint, guest bigint, n bigint").groupBy("shard", "guest").agg(F.sum("n").alias("n")).collect()
    most = max([r["shard"] for r in sizes], default=0) + 1
    residents, visits = np.zeros(most, np.int64), np.zeros(most, np.int64)
    for r in sizes:
        if r["guest"]:
            visits[r["shard"]] = r["n"]
        else:
            residents[r["shard"]] = -(-r["n"] // MOST)
    # Residents of other blocks of a shard come as guests too.
    visits = np.maximum(1, -(-(visits + np.maximum(residents - 1, 0) * MOST) // MOST))
    first = np.concatenate(([0], np.cumsum(residents * visits)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part, cell, guest, rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(np.full(len(rows), guest)), *(part.column(c).take(pa.array(rows)) for c in ("node", "fp", "more", "shingles"))],
                names=["cell", "guest", "node", "fp", "more", "shingles"],
            )

        def spread(value):  # even, and the same on every attempt
            return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, shard, guest = routed(part)
                used = residents[np.minimum(shard, most - 1)] * (shard < most) > 0
                row, shard, guest = row[used], shard[used], guest[used]
                own = part.column("node").to_numpy().view(np.uint64)[row]
                block, chunk = spread(own) % residents[shard], spread(own ^ np.uint64(0x5851F42D4C957F2D)) % visits[shard]
                # A resident is data in all chunks of its block, and a guest of the later blocks.
                home = np.flatnonzero(~guest)
                times = visits[shard[home]]
                who = np.repeat(home, times)
                step = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield out(part, first[shard[who]] + block[who] * visits[shard[who]] + step, False, row[who])
                start = np.where(guest, 0, block + 1)
                times = np.maximum(residents[shard] - start, 0)
                who = np.repeat(np.arange(len(own)), times)
                step = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + start[who]
                yield out(part, first[shard[who]] + step * visits[shard[who]] + chunk[who], True, row[who])

    def compared(cell: pa.Table) -> pa.Table:
        number = cell.column("cell")[0].as_py()
        guest = cell.column("guest").to_numpy()
        shard = int(np.searchsorted(first, number, side="right")) - 1
        among = (number - first[shard]) % visits[shard] == 0
        data, guests = cell.filter(pa.array(~guest)), cell.filter(pa.array(guest))
        nodes, others = data.column("node").to_numpy(), guests.column("node").to_numpy()
        links = _links(Prints.of(data), Prints.of(guests), bool(among), rule)
        u = [int(others[i] if far else nodes[i]) for far, i, _ in links]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array([int(nodes[k]) for _, _, k in links], pa.int64())})

    cells = prints.select("node", "fp", "more", "shingles").mapInArrow(placed, "cell bigint, guest boolean, node bigint, fp bigint, more binary, shingles bigint")
    return cells.groupBy("cell").applyInArrow(compared, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, width: int = 5, radius: int = 4, words: int = 1, total: int | None = None, ratio: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(``id_col``, ``keep``, ``fp``, ``component``, ``component_id``) for every row of ``docs``.

    Fingerprints link if their first 64 bits differ in ``radius`` bits or fewer and, where asked
    for, all ``words`` * 64 bits in ``total`` or fewer and their numbers of shingles are within
    ``ratio`` of each other. ``component_id`` is the smallest id reachable over links, its own
    included; ``component`` numbers the component. Null and empty texts share fingerprint 0, which
    links like any other; equal texts and repeated rows share their fingerprint. A null id is
    never a component's id unless the component has no other. An empty table gives an empty
    result. Only the named columns are read, so others cannot clash.

    Copies are merged to distinct fingerprints before any comparison, whatever their number.
    """
    marked = fingerprints(docs, width, (id_col, *keep), text_col, words)
    if not ratio:
        marked = marked.withColumn("shingles", F.lit(0).cast("bigint"))
    node = F.when(F.lit(words == 1 and not ratio), F.col("fp")).otherwise(F.xxhash64("fp", "more", "shingles"))
    marked = stored(marked.withColumn("node", node), "simhash")
    distinct = stored(marked.groupBy("node", "fp", "more", "shingles").agg(F.min(id_col).alias("_first")), "simhash-distinct")
    links = stored(near_links(distinct.drop("_first"), Rule(radius, total, ratio)), "simhash-links")
    joined = connected_components(links, [])
    labelled = distinct.join(joined.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("_first").alias("component_id"))
    named = stored(labelled.join(smallest, "label").select("node", F.col("label").alias("component"), "component_id"), "simhash-components")
    discard(links, distinct)
    return marked.join(named, "node").select(id_col, *keep, "fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id (ties:
    the smallest text digest; equal rows are one).

    Texts count as near duplicates from a Jaccard similarity of about ``similarity`` of their
    ``width``-word shingles on. Fingerprints have 256 bits here, since 64 are too few to tell 0.8
    from 0.7: the bits that differ follow from the angle that belongs to the similarity, plus a
    tenth for chance. The first 64 bits bound the search, three standard deviations wider.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = round(256 * share * 1.1)
    radius = round(64 * share * 1.1 + 3 * math.sqrt(48 * share * (1 - share)))
    rows = docs.withColumn("_digest", F.xxhash64(F.col(text_col), F.lit(4)))
    found = near_duplicates(rows, width, radius, 4, total, similarity - 0.05, id_col, text_col, keep=("_digest",))
    order = Window.partitionBy("component").orderBy(F.col(id_col).asc_nulls_last(), "_digest")
    best = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col(id_col).alias("_best"), F.col("_digest").alias("_best_digest"))
    kept = rows.join(stored(best, "near-kept"), F.col(id_col).eqNullSafe(F.col("_best")) & F.col("_digest").eqNullSafe(F.col("_best_digest")), "left_semi")
    return kept.drop("_digest").dropDuplicates([id_col, text_col])
