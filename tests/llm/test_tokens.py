"""Prefix BPE and the token file against the library."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from tokenizers import Tokenizer

from wafermill.llm import queries, tokenfile
from wafermill.llm.bpe import TextCodec, encode_documents
from wafermill.llm.tokenfile import Codes, code_lengths, read_token_file, write_token_file

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  a  b", "Ünïcödé İstanbul ΣΑΣ ς <|endoftext|>x <|startoftext|>", "日本語テキスト 123 4567 ½²³", "a\x1cb\x85c d　e\xa0f",
    "don't I'LL we've 's", "a" * 3000, "ab" * 900, "é é", "<|endoftext|", "\x00\x01 abc", "😀 emoji", " \n\t  x", "x   ", "x ",
    "hello   world\n\n\nfoo  ", "ﬁ ſ ǅ ß ẞ", "a \nb", "a\n b", "x\t y 12ab34", "word " * 40_000,
]
SCHEMA = "doc_id bigint, text string, ids string, part string"


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_equals_library(path):
    own, library = TextCodec(path), Tokenizer.from_file(path)
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_pieces_are_exact_on_random_letters():
    rng = np.random.default_rng(1)
    own, library = TextCodec(WORD), Tokenizer.from_file(WORD)
    for _ in range(400):
        text = "".join(rng.choice(list("aeinrstho"), rng.integers(1, 30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_slices_equal_library():
    own, library = tokenfile.LibraryCodec(BYTE, 50), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(5)
    letters = list("aeinrstho'AZ09.,-é\n…ɏ–<ß²½_")
    plain = [" ".join("".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(rng.integers(1, 60))) for _ in range(300)]
    texts = [*ODD, None, *plain, *ODD, "", *plain[:20]]
    for part in (texts, texts[7:19], texts[-1:], [None, ""], []):
        got = own.encode_slice(pa.array(["cut off", *part], pa.string()).slice(1), 2)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in part]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_merged_pieces_equal_library():
    merger, library = tokenfile.LibraryCodec(BYTE, 50).merger, Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(6)
    pieces = ["".join(rng.choice(list("abeinrst"), rng.integers(1, 60))) for _ in range(2000)] + ["a", "aa" * 30, "é", "x"]
    raw = [p.encode() for p in pieces]
    ids, counts = merger.encode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw]))
    assert merger.usable and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(p, add_special_tokens=False).ids for p in pieces]


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_round_trip_query(spark):
    library = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op4_bpe_round_trip"](spark, SF_DIR).collect()}
    want = {}
    for i, t in documents(spark):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_encode_documents_odd_rows(spark):
    rows = [(1, None, "x", "y"), (None, "a b", "x", "y"), (2, "a b", "x", "y"), (2, "a b", "x", "y"), (3, "", None, None)]
    got = encode_documents(spark.createDataFrame(rows, SCHEMA), WORD).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got} == {0, 2}
    assert encode_documents(spark.createDataFrame([], SCHEMA), WORD).collect() == []


def expected_file(rows):
    library, at, out = Tokenizer.from_file(BYTE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_token_file_query(spark):
    got = sorted(tuple(r) for r in queries.QUERIES["op7_token_file"](spark, SF_DIR).collect())
    assert got == expected_file(documents(spark))


def test_token_file_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 500)
    rows = [(k * 3 % 101, t) for k, t in enumerate(ODD)] + [(500, None), (700, "x"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(4)
    write_token_file(df, str(tmp_path / "f"), BYTE, 2)
    got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))) for r in read_token_file(spark, str(tmp_path / "f")).collect()]
    key = lambda r: r[1]
    assert sorted(got, key=key) == expected_file(rows)
    write_token_file(df.where("false"), str(tmp_path / "e"), BYTE, 2)
    assert read_token_file(spark, str(tmp_path / "e")).collect() == []
    write_token_file(df.where("text = 'x'").union(df.where("text = 'x'")), str(tmp_path / "d"), BYTE, 2)
    assert sorted(r["start"] for r in read_token_file(spark, str(tmp_path / "d")).collect()) == [0, 2]


def test_code_lengths():
    rng = np.random.default_rng(2)
    for most in (4, 6, 16):
        counts = rng.integers(1, 1000, 14) ** 3
        lengths = code_lengths(counts, most)
        assert lengths.max() <= most and (0.5**lengths).sum() == 1
    # Without a limit that binds, the total is Huffman's.
    import heapq

    heap, total = list(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert (lengths * counts).sum() == total
    codes = Codes(np.arange(14), lengths)
    for n in (1, 127, 128, 129, 5000):
        ids = rng.integers(0, 14, n)
        assert (codes.decode(*codes.encode(ids), n) == ids).all()
