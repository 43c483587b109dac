"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that can end its encoding. An
automaton over the vocabulary lists the tokens that are suffixes of the prefix; a token is
the one if it may follow the last token of the prefix before it. Two tokens may stand side
by side if merging their own symbols leaves just these two. Walking the stored tokens back
from the whole piece gives the ids; no merge loop runs over a piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.llm.common import slices

#: Stands for "the piece ends here" inside the automaton; no byte symbol maps to it.
END = "￿"
#: Pieces and pairs that one worker remembers before it starts anew. Results do not depend on it.
REMEMBERED = 120_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixEncoder:
    """Encoder for the pieces of one vocabulary file (its ``model`` must be plain BPE)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols: dict[int, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            self.symbols[number] = [*body[:-1], body[-1] + self.suffix] if ends else list(body)
            text = body + END if ends else body
            self.automaton.add_word(text, (number, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _merged(self, parts: list[str]) -> list[str]:
        """Merge by rank, leftmost first. Only ever called on the symbols of one or two tokens."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """May ``token`` directly follow ``before`` (-1: start of the piece)?"""
        parts = self._merged([*(self.symbols[before] if before >= 0 else []), *self.symbols[token]])
        known = [self.vocab.get(p) for p in parts] == ([before, token] if before >= 0 else [token])
        if len(self.pairs) >= 5 * REMEMBERED:
            self.pairs.clear()
        self.pairs[before << 20 | token] = known
        return known

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece written in byte symbols."""
        if not piece:
            return []
        text = piece + END if self.suffix else piece
        size = len(text)
        # Without its end mark the whole piece is no prefix of its symbols.
        dead = size - 1 if self.suffix else -1
        last, lengths, pairs = [-2] * (size + 1), [0] * (size + 1), self.pairs
        last[0] = -1
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            before = last[end - length]
            if before == -2 or last[end] != -2 or end == dead:
                continue
            good = pairs.get(before << 20 | token)
            if good is None:
                good = self.fits(before, token)
            if good:
                last[end], lengths[end] = token, length
        ids, at = [], size
        while at:
            if last[at] == -2:
                raise ValueError(f"the vocabulary cannot spell {piece!r}")
            ids.append(last[at])
            at -= lengths[at]
        return ids[::-1]


class Remembered(dict):
    """A bounded memory of a function of strings: two generations, the older one goes when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def packed(ids) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise OverflowError("unsigned int is not 32 bits wide here")
    if array("H", [1]).tobytes() != b"\x01\x00":
        out.byteswap()
    return out.tobytes()


def _latin(kind: str) -> str:
    return "".join(chr(c) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind)


class TextCodec:
    """Whole texts to ids and back with one vocabulary file.

    The file's own normaliser and pre-tokeniser cut texts into pieces. Texts made of Latin
    letters and ordinary punctuation only are cut by an equal pattern, which is faster; any
    other text goes through the library's parts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.parts = Tokenizer.from_file(path)
        self.encoder = PrefixEncoder(spec)
        self.symbols = byte_symbols()
        self.pieces = Remembered(self._piece, remembered)
        self.chunks = Remembered(self._chunk, remembered)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.tokens |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match the raw text as it stands")
        self.added = {t["content"]: packed([t["id"]]) for t in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        self.plain_join = kind is None
        back = {s: b for b, s in enumerate(self.symbols)}
        self.raw = {}
        if not self.plain_join:
            special = {t["id"] for t in spec["added_tokens"]}
            self.raw = {i: t.encode() if i in special else bytes(back[c] for c in t) for i, t in self.tokens.items()}
        letters, digits = re.escape(_latin("L")), re.escape(_latin("N"))
        rest = rf"[^\s{letters}{digits}]+"
        self.simple = re.compile(rf"[\t\n\r\x20-\x7e¡-ɏ‐-…]*\Z")
        self.gaps = re.compile(r"\A | \s|\s | \Z")
        # The pieces of the two public vocabularies, over Latin letters and digits.
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        lower_rules = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        split_rule = ends + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.lower = False
        self.words = None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if spec["normalizer"] == lower_rules and len(steps) == 2 and steps[0].get("pattern") == {"Regex": split_rule} and steps[0].get("invert") and not steps[1].get("use_regex"):
            self.lower = True
            self.words = re.compile(rf"{ends}|[{letters}]+|[{digits}]|{rest}")
        elif spec["normalizer"] is None and (spec["pre_tokenizer"] or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.words = re.compile(rf"{ends}| ?[{letters}]+| ?[{digits}]+| ?{rest}|\s+(?!\S)|\s+")

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as it stands in the text."""
        return packed(self.encoder.encode("".join([self.symbols[b] for b in piece.encode()])))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces; in byte-level vocabularies the space in front belongs to it."""
        return b"".join(map(self.pieces.__getitem__, self.words.findall(chunk if self.lower else " " + chunk)))

    def _segment(self, text: str) -> bytes:
        if self.words is not None and self.simple.match(text):
            if self.lower:
                text = unicodedata.normalize("NFC", text).lower()
                return b"".join(map(self.chunks.__getitem__, text.split()))
            # A single space between visible characters always starts a piece.
            if " " in text and not self.gaps.search(text):
                first, *others = text.split(" ")
                return b"".join([*map(self.pieces.__getitem__, self.words.findall(first)), *map(self.chunks.__getitem__, others)])
            return b"".join(map(self.pieces.__getitem__, self.words.findall(text)))
        if self.parts.normalizer is not None:
            text = self.parts.normalizer.normalize_str(text)
        return b"".join(packed(self.encoder.encode(p)) for p, _ in self.parts.pre_tokenizer.pre_tokenize_str(text))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is None or "<" not in text:
            return self._segment(text)
        return b"".join(self.added[p] if p in self.added else self._segment(p) for p in self.split.split(text) if p)

    def decode(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I")
        if self.plain_join:
            return " ".join(map(self.tokens.__getitem__, numbers))
        return b"".join(map(self.raw.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    return TextCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids`` (binary, little-endian unsigned
    32-bit) and ``decoded`` (the text that the ids give back).

    ``path`` names a vocabulary file that every executor can open. A null or empty text has no
    ids and decodes to the empty string; repeated rows and null ids are kept as they are; other
    columns are not read, so their names cannot clash. Texts are encoded whole, row by row,
    without a shuffle; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens bigint, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for part in slices(whole, "_text"):
                ids = [own.encode(t or "") for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([own.decode(x) for x in ids], pa.string()),
                    ],
                    names=["_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
