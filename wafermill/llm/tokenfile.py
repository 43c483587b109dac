"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A file is a folder with two Parquet tables that Spark can read from any store:

- ``codes``: ``id``, ``n`` (how often), ``length`` (bits). Codes are canonical: numbered by
  (length, id), so the lengths are all a reader needs.
- ``blocks``: whole documents in ascending id order. ``part`` and ``seq`` order the blocks,
  ``before`` counts the ids of earlier blocks of the part. ``docs`` and ``sizes`` name the
  documents, ``bits`` is the code stream (big-endian 32-bit words) and ``marks`` holds, for
  every STRIDE ids, how many bits they take: summed up, the bit offsets at which decoding may
  start. A block needs nothing from other blocks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafermill.llm.bpe import TextCodec, packed
from wafermill.llm.common import discard, slices, stored

#: Ids between two bit-offset marks, and ids after which a block ends (documents stay whole).
STRIDE, BLOCK = 128, 1 << 18


#: Bytes of text that are encoded at a time, and bytes of a piece that is merged together with others.
SLICE, SHORT = 1 << 22, 64
NO_PAIR = (1 << 31) - 1


class PieceMerger:
    """Merges by rank of many short pieces at a time: in each round every piece merges the leftmost of its
    pairs with the lowest rank, until none of its pairs is known."""

    def __init__(self, spec: dict, symbols: list[str]):
        model = spec["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.usable = model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        ) and all(s in vocab for s in symbols)
        if not self.usable:
            return
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[s] for s in symbols], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stand one behind the other in the bytes ``raw`` (no piece is empty), and how
        many each has."""
        ids, counts = self.first[raw], np.zeros(len(sizes), np.int64)
        number = np.arange(len(sizes))
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(ids), NO_PAIR, np.int64)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[starts + sizes - 1] = NO_PAIR
        done_ids, done_of = [], []
        while len(number):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            ready = best >> 32 == NO_PAIR
            counts[number[ready]] = sizes[ready]
            done_ids.append(ids[np.repeat(ready, sizes)])
            done_of.append(np.repeat(number[ready], sizes[ready]))
            at = best[~ready] & 0xFFFFFFFF
            ids[at] = self.merged[best[~ready] >> 32]
            stay = np.repeat(~ready, sizes)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            ids, rank = ids[stay], rank[stay]
            number, sizes = number[~ready], sizes[~ready] - 1
            starts = np.cumsum(sizes) - sizes
            last = at == starts + sizes - 1
            rank[at] = NO_PAIR
            inner = at[~last]
            rank[inner] = self._rank(ids[inner], ids[inner + 1])
            inner = at[at > starts]
            rank[inner - 1] = self._rank(ids[inner - 1], ids[inner])
        if not done_ids:
            return np.zeros(0, np.int64), counts
        order = np.argsort(np.concatenate(done_of), kind="stable")
        return np.concatenate(done_ids)[order], counts


class LibraryCodec(TextCodec):
    """Cuts texts as :class:`TextCodec` does; the library's own model encodes the pieces, or short pieces
    of many texts are merged together by the same ranks.

    The texts of a slice are cut at spaces together, each distinct chunk is encoded once, and the ids of
    all texts are gathered from those of their chunks. Texts in which a chunk is not of the
    plain kind (other scripts, white space next to a space, a sign that may start an added
    token) are encoded one by one.
    """

    def __init__(self, path: str, remembered: int):
        super().__init__(path, remembered)
        self.table = dict(enumerate(self.symbols))
        self.marks = {name[0] for name in self.added}
        self.known, self.known_older, self.most = {}, {}, remembered
        # Kinds of code points: 1 letter, 2 digit, 3 other sign; 0 needs the patterns of the base class.
        self.kinds = np.zeros(0x2028, np.uint8)
        for point in range(0x21, len(self.kinds) - 1):
            sign = chr(point)
            if self.simple.match(sign) and not sign.isspace() and sign != "'" and sign not in self.marks:
                major = unicodedata.category(sign)[0]
                self.kinds[point] = {"L": 1, "N": 2}.get(major, 3)
        self.kinds[0x20] = 4
        with open(path, encoding="utf-8") as file:
            self.merger = PieceMerger(json.load(file), self.symbols)
        # A chunk without its first character may hold any white space but must not begin or end with it.
        self.plain = re.compile(r"(?!\s)" + self.simple.pattern.replace(r"\Z", r"(?<!\s)\Z"))

    def _piece(self, piece: str) -> bytes:
        return packed([t.id for t in self.parts.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])

    def _segment(self, text: str) -> bytes:
        if self.words is not None and self.simple.match(text):
            return super()._segment(text)
        return packed(self.parts.encode(text, add_special_tokens=False).ids)

    def _cut(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks one behind the other, how many each has, and which chunks are cut here: those
        of letters, digits and other signs only, whose pieces are the runs of one kind. The space in
        front of a chunk belongs to its first run."""
        text = " " + " ".join(names)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        space = points == 0x20
        heads = np.flatnonzero(space)
        fit = np.minimum.reduceat(kind, heads) > 0
        lengths = np.diff(np.r_[heads, len(points)])
        fit &= lengths <= SHORT // 3
        keep = np.repeat(fit, lengths)
        points, kind, space = points[keep], kind[keep], space[keep]
        start = space | np.r_[True, ~space[:-1] & (kind[1:] != kind[:-1])]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800)
        at = np.cumsum(width) - width
        raw = self._bytes(points, width, at)
        opens = np.flatnonzero(start)
        sizes = np.diff(np.r_[at[opens], len(raw)])
        owner = np.cumsum(space[opens]) - 1
        pieces = pa.Array.from_buffers(pa.binary(), len(opens), [None, pa.py_buffer(np.r_[at[opens], len(raw)].astype(np.int32)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        names_, index = coded.dictionary, coded.indices.to_numpy()
        offsets = np.frombuffer(names_.buffers()[1], np.int32)[names_.offset : names_.offset + len(names_) + 1].astype(np.int64)
        flat = np.frombuffer(names_.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(names_) else np.zeros(0, np.uint8)
        ids, counts = self.merger.encode(flat, np.diff(offsets))
        begin = np.cumsum(counts) - counts
        taken = counts[index]
        ends = np.cumsum(taken)
        gathered = ids[np.repeat(begin[index] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        return gathered, np.bincount(owner, taken, int(fit.sum())).astype(np.int64), fit

    @staticmethod
    def _bytes(points: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
        """UTF-8 of code points below 0x10000."""
        out = np.empty(int(at[-1] + width[-1]) if len(at) else 0, np.uint8)
        one, two, three = width == 1, width == 2, width == 3
        out[at[one]] = points[one]
        out[at[two]], out[at[two] + 1] = 0xC0 | points[two] >> 6, 0x80 | points[two] & 63
        out[at[three]], out[at[three] + 1], out[at[three] + 2] = 0xE0 | points[three] >> 12, 0x80 | points[three] >> 6 & 63, 0x80 | points[three] & 63
        return out

    def _ids(self, names: list[str]) -> list[bytes]:
        """Ids of chunks with a space in front; empty for those that are not of the plain kind.

        Chunks are remembered for as long as fewer than ``most`` are known, and the last full memory
        beside the new one. New ones are cut and merged together."""
        known, older = self.known, self.known_older
        got = list(map(known.get, names))
        new = []
        for k in [k for k, ids in enumerate(got) if ids is None]:
            ids = older.get(names[k])
            if ids is None:
                new.append(k)
            else:
                got[k] = known[names[k]] = ids
        if new and self.merger.usable:
            flat, counts, fit = self._cut([names[k] for k in new])
            raw, ends = flat.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            done = [k for k, ok in zip(new, fit.tolist()) if ok]
            for k, a, b in zip(done, (ends - 4 * counts).tolist(), ends.tolist()):
                got[k] = known[names[k]] = raw[a:b]
            new = [k for k, ok in zip(new, fit.tolist()) if not ok]
        for k in new:
            name = names[k]
            odd = not name or self.plain.match(name) is None or not self.marks.isdisjoint(name)
            got[k] = b"" if odd else self._chunk(name)
            if not odd and len(name) <= SHORT:
                known[name] = got[k]
        if len(known) > self.most:
            self.known, self.known_older = {}, known
        return got

    def encode_slice(self, texts: pa.Array, end: int) -> list[bytes]:
        """Ids of every text (null: none) with ``end`` behind them, as little-endian unsigned 32-bit integers."""
        last = packed([end])
        if self.words is None or self.lower:
            return [self.encode(t or "") + last for t in texts.to_pylist()]
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        starts = bounds[:-1]
        pieces = self._ids(names)
        odd = np.fromiter((not x for x in pieces), bool, len(names))
        rough = np.logical_or.reduceat(odd[at], starts) if len(starts) else np.zeros(0, bool)
        # The first chunk of a text has no space in front of it; a last entry is the end of a text.
        firsts: dict[str, int] = {}
        at = at.astype(np.int64)
        for row in np.flatnonzero(~rough):
            at[starts[row]] = len(names) + firsts.setdefault(names[at[starts[row]]], len(firsts))
        pieces += [b"".join(map(self.pieces.__getitem__, self.words.findall(name))) for name in firsts]
        pieces.append(last)
        at = np.insert(at, bounds[1:], len(pieces) - 1)
        bounds = bounds + np.arange(len(bounds))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, offsets = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(sizes) - sizes
        taken = sizes[at]
        ends = np.cumsum(taken)
        ids = flat[np.repeat(offsets[at] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, ends][bounds] if len(ends) else bounds
        out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        for row in np.flatnonzero(rough):
            out[row] = self.encode(texts[row].as_py()) + last
        return out


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path, 400_000)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Bits of each code, at most ``most``, with the smallest possible total (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError("too many ids for codes of this length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate((leaves, packages))
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        merged = both[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        taken = int(leaf[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes from (ids, lengths), with the tables for both directions."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.width = int(self.lengths.max(initial=1))
        room = np.int64(1) << (self.width - self.lengths)
        code = (np.cumsum(room) - room) >> (self.width - self.lengths)
        top = int(self.ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids], self.bits[self.ids] = code.astype(np.uint64), self.lengths
        entries = (self.ids.astype(np.uint64) << np.uint64(8)) | self.lengths.astype(np.uint64)
        self.table = np.zeros(1 << self.width, np.uint64)
        self.table[: int(room.sum())] = np.repeat(entries, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Code stream and marks of the ids of one block."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        start = ends - bits
        placed = self.code[ids] << (64 - (start & 31) - bits).astype(np.uint64)
        word = start >> 5
        opens = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[word[opens]] += np.add.reduceat(placed >> np.uint64(32), opens)
        out[word[opens] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), opens)
        marks = np.add.reduceat(bits, np.arange(0, len(ids), STRIDE))
        return out[: -(-int(ends[-1]) // 32)].astype(">u4").tobytes(), marks.astype("<u2").tobytes()

    def decode(self, stream: bytes, marks: bytes, n: int) -> np.ndarray:
        """The ids of a block: all stretches between marks advance together, one id a step."""
        words = np.concatenate((np.frombuffer(stream, ">u4"), [0, 0])).astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        taken = np.frombuffer(marks, "<u2").astype(np.int64)
        at = np.cumsum(taken) - taken
        last = len(pairs) - 1
        out = np.empty((STRIDE, len(at)), np.uint32)
        shift = np.uint64(64 - self.width)
        for k in range(STRIDE):
            found = self.table[(pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift]
            out[k] = found >> np.uint64(8)
            at += (found & np.uint64(255)).astype(np.int64)
        return out.T.reshape(-1)[:n]


def _squeezed(ids: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids)


def _raw(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<u4")


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, most_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write all ids to the folder ``path``.

    Documents stand in ascending order of their id, null ids first, rows of one id in the order of
    their text's digest. A null or empty text has only the end id. Repeated rows are written as
    often as they occur. An empty table gives a file without blocks. Other columns are not read.

    Texts are range-partitioned by id and encoded once; the ids rest compressed in the shared folder
    while the global counts and the codes (bounded by the vocabulary) are made. Codes have at
    most ``most_bits`` bits, or one more than the number of used ids needs.
    """
    order = [F.col("_id").asc_nulls_first(), F.col("_tie")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(tokenizer)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, ids, size = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
                    pa.array([_squeezed(b"".join(ids))], pa.binary()),
                ],
                names=["part", "seq", "before", "docs", "sizes", "ids"],
            )

        for whole in batches:
            for cut in slices(whole, "_text", SLICE):
                for doc, own in zip(cut.column("_id").to_pylist(), codec.encode_slice(cut.column("_text"), end_id), strict=True):
                    docs.append(doc)
                    ids.append(own)
                    size += len(ids[-1]) // 4
                    if size >= BLOCK:
                        yield block()
                        seq, before, docs, ids, size = seq + 1, before + size, [], [], 0
        if docs:
            yield block()

    layout = "part bigint, seq bigint, before bigint, docs array<bigint>, sizes array<bigint>"
    held = stored(rows.select("_id", "_text").mapInArrow(tokens, layout + ", ids binary"), "token-blocks")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = np.bincount(_raw(b), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = held.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    seen = counts.orderBy("id").toPandas()  # at most one row for each id of the vocabulary
    ids = seen["id"].to_numpy(np.int64)
    lengths = code_lengths(seen["n"].to_numpy(np.int64), max(most_bits, int(len(ids)).bit_length() + 1))
    spark = docs.sparkSession
    table = spark.createDataFrame(seen.assign(length=lengths)[["id", "n", "length"]], "id bigint, n bigint, length bigint")
    table.coalesce(1).write.parquet(f"{path}/codes")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(ids, lengths)
        for batch in batches:
            for k, b in enumerate(batch.column("ids").to_pylist()):
                stream, marks = codes.encode(_raw(b))
                own = [batch.column(c).slice(k, 1) for c in ("part", "seq", "before", "docs", "sizes")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([stream], pa.binary()), pa.array([marks], pa.binary())],
                    names=["part", "seq", "before", "docs", "sizes", "bits", "marks"],
                )

    held.mapInArrow(coded, layout + ", bits binary, marks binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(held)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(``doc_id``, ``start``, ``ids``) of every document: ids as little-endian unsigned 32-bit
    integers, ``start`` counts the ids of all documents before it. Blocks decode independently."""
    table = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()  # bounded by the vocabulary
    ids, lengths = table["id"].to_numpy(np.int64), table["length"].to_numpy(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    # One row for each partition that wrote blocks: small enough to be sent to every executor, so
    # that the blocks are decoded where they are read.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(ids, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                all_ids = codes.decode(row["bits"], row["marks"], int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                raw = [all_ids[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                starts = ends - sizes + row["before"] + row["_offset"]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(starts), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.select("part", "before", "docs", "sizes", "bits", "marks").join(F.broadcast(parts), "part").drop("part").mapInArrow(
        decoded, "doc_id bigint, start bigint, ids binary"
    )
