"""Nearest neighbours against brute force: recall, exact scores, copies and odd vectors."""

import numpy as np
import pytest

from wafermill.llm import queries
from wafermill.llm.neighbours import Lists, nearest_neighbours

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string"


def brute(rows, asked, k):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in asked:
        score = vectors @ np.array(v, np.float32).astype(np.float64)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def gathered(df, name="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r[name], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = gathered(queries.QUERIES["op3_nearest"](spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q in got:
        assert len(got[q]) == 20
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    copy = base[7][1]
    rows = base + [(1000 + i, copy) for i in range(400)] + [(5000 + i, (np.array(base[i][1]) * 3).tolist()) for i in range(5)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [1.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [1.0] * 5), (None, copy)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd + rows[:3]], SCHEMA).repartition(6)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = gathered(nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20, miss=0.0))
    want = brute(rows, asked, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], "x", "y"), (20, [0.5, 0.5], "x", "y"), (3, [-1.0, 0.0], "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = gathered(nearest_neighbours(df, df.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 0.5), (3, -1.0)], 20: [(0, 0.5), (3, -0.5)]}
    assert nearest_neighbours(df.where("false"), df).collect() == []
    assert nearest_neighbours(df, df.where("false")).collect() == []
    assert gathered(nearest_neighbours(df.limit(1), df.limit(1))) == {}


def test_empty_lists_are_not_searched_again():
    rng = np.random.default_rng(5)
    lists = Lists(rng.normal(size=(400, 8)), 10.0, 20)
    lists.sizes[:], lists.spread[:] = 50, 1
    lists.sizes[::2] = 0
    asked = rng.normal(size=(30, 8))
    first = np.argsort(-lists.scores(asked), axis=1, kind="stable")[:, :4]
    later = lists.visits(asked, np.full(30, -np.inf), 4, 0.0, 20)
    for own, others in zip(first, later, strict=True):
        assert (lists.sizes[own] > 0).all() and sorted([*own, *others]) == list(range(1, 20, 2))


def test_dense_groups_give_no_repeats(spark):
    rng = np.random.default_rng(6)
    tight = rng.normal(size=(3, 8)).repeat(1200, axis=0) + 1e-4 * rng.normal(size=(3600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((rng.normal(size=(2400, 8)), tight)).astype(np.float32))]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = gathered(nearest_neighbours(df, df.where("vec_id % 40 = 0"), k=20))
    want = brute(rows, [r for r in rows if r[0] % 40 == 0], 20)
    assert all(len({i for i, _ in got[q]}) == 20 for q in want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
