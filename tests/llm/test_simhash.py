"""SimHash components against all pairs."""

import re

import numpy as np
import xxhash
from conftest import SF_DIR

from wafermill.llm import queries
from wafermill.llm.simhash import Prints, Rule, VantageTree, drop_near_duplicates, fingerprint, near_duplicates, near_links

SCHEMA = "doc_id bigint, text string, fp string"


def slow_fingerprint(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    """prints: id -> unsigned fingerprint; id -> smallest id reachable."""
    label = {i: i for i in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in ids}


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"], 4) for r in docs}
    want = slow_components(prints, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op10_simhash"](spark, SF_DIR).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_odd_rows(spark):
    long = "word " * 70_000
    rows = [(1, None, "x"), (2, "", None), (3, " \n\t", "x"), (4, "One two", "y"), (4, "one TWO", "y"), (None, "one two", "z"), (9, long, "x"), (7, "Ä b", "x"), (8, "ä b", "x")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 4, 4).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == 4 and by_id[9] == 9
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [4]
    assert by_id[7] != by_id[8]
    for text in (None, "", "a", "a b c d", "a b c d e a b c d e", "Ä B C D E f"):
        for width in (1, 4, 5):
            assert fingerprint(text, width) % (1 << 64) == slow_fingerprint(text, width)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deep_tree_and_dense_ball(spark, monkeypatch):
    from wafermill.llm import simhash

    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "MOST", 90)
    monkeypatch.setattr(simhash, "SMALL", 16)
    rng = np.random.default_rng(3)
    far = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (500, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    near = far[:100] ^ flips[:100]
    ball = np.uint64(12345678901234567) ^ flips
    values = np.unique(np.concatenate((far, near, ball)))
    prints = spark.createDataFrame([(int(v), int(v), b"", 0) for v in values.view(np.int64)], "node bigint, fp bigint, more binary, shingles bigint")
    links = near_links(prints.repartition(7), Rule(4)).collect()
    assert len(links) < 40 * len(values)
    unsigned = {int(v): int(v) for v in values}
    want = slow_components(unsigned, 4)
    label = {v: v for v in unsigned}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in links:
        a, b = r["u"] % (1 << 64), r["v"] % (1 << 64)
        assert (a ^ b).bit_count() <= 4 or want[a] == want[b]
        low, high = sorted((root(a), root(b)))
        label[high] = low
    assert {v: root(v) for v in unsigned} == want


def test_shards_split_in_memory(monkeypatch):
    from wafermill.llm import simhash

    monkeypatch.setattr(simhash, "SMALL", 20)
    rng = np.random.default_rng(9)
    far = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (500, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    values = np.unique(np.concatenate((far, far ^ flips, np.uint64(99) ^ flips)))
    rng.shuffle(values)
    data, guests = values[:700], values[700:]
    for among in (True, False):
        none = lambda x: Prints(x, np.zeros((len(x), 0), np.uint64), np.zeros(len(x), np.int64))
        links = simhash._links(none(data), none(guests), among, Rule(4))
        links = [(int((guests if far else data)[i]), int(data[k])) for far, i, k in links]
        pairs = {(int(a), int(b)) for a in values for b in data if a != b and (int(a) ^ int(b)).bit_count() <= 4}
        if not among:
            pairs = {(a, b) for a, b in pairs if a in set(guests.tolist())}

        def groups(edges):
            label = {int(x): int(x) for x in values}

            def root(i):
                while label[i] != i:
                    i = label[i]
                return i

            for a, b in edges:
                low, high = sorted((root(a), root(b)))
                label[high] = low
            return {x: root(x) for x in label}

        assert groups(links) == groups(pairs)


def test_routing_finds_every_pair():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    others = points ^ (np.uint64(1) << rng.integers(0, 64, (2000, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    tree = VantageTree(points, 6, 4)
    both = np.concatenate((points, others))
    row, leaf, guest = tree.route(both)
    assert (np.bincount(row[~guest], minlength=4000) == 1).all()
    home = dict(zip(row[~guest].tolist(), leaf[~guest].tolist()))
    seen = set(zip(row.tolist(), leaf.tolist()))
    for i in range(2000):
        if (int(both[i]) ^ int(both[i + 2000])).bit_count() <= 4:
            assert (i, home[i + 2000]) in seen or (i + 2000, home[i]) in seen


def jaccard(a, b, width=5):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(11)
    rows, near = [], []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        rows.append((i, " ".join(words), "x"))
        if i % 3 == 0:
            changed = list(words)
            for at in rng.choice(len(words), max(1, len(words) // 60), replace=False):
                changed[at] = "changed"
            rows.append((1000 + i, " ".join(changed), "x"))
            if jaccard(rows[-1][1], rows[-2][1]) > 0.85:
                near.append(1000 + i)
        if i % 3 == 1:
            rows.append((1000 + i, " ".join(words[: len(words) // 2]), "x"))
    rows += [(5000, rows[0][1], "x"), (5001, rows[0][1].upper(), "x"), (7, rows[7][1], "x"), (None, "null id text", "x"), (8000, None, "x"), (8001, None, "x"), (8002, "", "x")]
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(range(120)) <= kept and None in kept
    assert not kept & {5000, 5001, 8001, 8002} and 8000 in kept
    assert {1000 + i for i in range(120) if i % 3 == 1} <= kept
    assert len(near) > 20 and len(kept & set(near)) <= 0.05 * len(near)
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
