"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance,
and turned by a random rotation, so that a few columns already tell the distance roughly. The
vectors are dealt to lists around centroids. Inside a list distances grow column block by column
block, and after each block a test drops the candidates that are too far already: the rest of
the columns would have to be unlikely small. What is left gets its exact inner product.

Which lists a query visits follows from a test as well: the first lists give it a score that it
has to beat, and from the spread of a list follows how many better vectors it should hold.
Lists are left out only while what they should hold stays under a set share of the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wafermill.llm.common import stored

#: Vectors that shape the centroids (those with the smallest digests). All vectors are indexed.
FIT_ROWS = 20_000
#: Vectors and queries in one cell of a list, and columns in one block.
CELL, COLUMNS = 4096, 16
#: Width of the distance test: a candidate goes if its distance so far, scaled up, is this far
#: over the one to beat (in units of 1 / sqrt(columns seen)).
DOUBT = 2.1


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<f4").reshape(-1, width).astype(np.float64)


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """P(normal > z), by a rational formula good to 1e-7."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-0.5 * np.minimum(a, 38) ** 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, tail, 1 - tail)


class Lists:
    """Rotation, centroids and spreads: what every task needs to know about the index."""

    def __init__(self, sample: np.ndarray, top: float, lists: int, seed: int = 7, rounds: int = 12):
        self.width = sample.shape[1]
        self.top = top
        rng = np.random.default_rng(seed)
        turned, _ = np.linalg.qr(rng.normal(size=(self.width + 1, self.width + 1)))
        self.turn = turned
        points = self.lift(sample)
        lists = max(1, min(lists, len(points)))
        self.centres = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(rounds):
            home = self.nearest(points)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, home, points)
            counts = np.bincount(home, minlength=lists)
            used = counts > 0
            self.centres[used] = sums[used] / counts[used, None]
        self.sizes = np.zeros(lists)
        self.spread = np.zeros(lists)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated data vectors, with the coordinate that makes all of them equally long."""
        extra = np.sqrt(np.maximum(self.top**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate((vectors, extra[:, None]), axis=1) @ self.turn

    def turned(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.turn[:-1]

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1)[None, :] - 2 * points @ self.centres.T).argmin(axis=1)

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries and centres; those of empty lists come last."""
        score = self.turned(queries) @ self.centres.T
        score[:, self.sizes == 0] = -np.inf
        return score

    def visits(self, queries: np.ndarray, beat: np.ndarray, done: int, share: float, k: int) -> list[np.ndarray]:
        """Lists that each query still has to visit after its ``done`` nearest ones."""
        score = self.scores(queries)
        order = np.argsort(-score, axis=1, kind="stable")[:, :done]
        spread = np.maximum(np.sqrt((queries**2).sum(axis=1))[:, None] * self.spread[None, :], 1e-12)
        expected = self.sizes[None, :] * _upper_tail((beat[:, None] - np.where(self.sizes == 0, 0, score)) / spread)
        expected[self.sizes[None, :].repeat(len(queries), 0) == 0] = 0
        np.put_along_axis(expected, order, 0, axis=1)
        low = np.argsort(expected, axis=1, kind="stable")
        kept = np.cumsum(np.take_along_axis(expected, low, axis=1), axis=1) > share * k
        kept |= np.isneginf(beat)[:, None] & (np.take_along_axis(expected, low, axis=1) > 0)
        return [low[i][kept[i]] for i in range(len(queries))]


def scan(lists: Lists, data: np.ndarray, queries: np.ndarray, beat: np.ndarray, most: int):
    """(query, candidate, score) of the candidates in a cell that reach ``beat``, ``most`` a query."""
    points, turned = lists.lift(data), lists.turned(queries)
    width = points.shape[1]
    square = (queries**2).sum(axis=1)
    # The squared distance that belongs to the score to beat.
    bound = np.where(np.isneginf(beat), np.inf, square + lists.top**2 - 2 * beat) * (1 + 1e-9) + 1e-9
    q = c = None
    so_far = np.zeros((len(queries), len(data)))
    for a in range(0, width, COLUMNS):
        b = min(a + COLUMNS, width)
        own, other = points[:, a:b], turned[:, a:b]
        if q is None:
            so_far += (other**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :] - 2 * other @ own.T
            good = so_far * (width / b) <= (bound * ((1 + DOUBT / np.sqrt(b)) ** 2 if b < width else 1 + 1e-9))[:, None]
            if b == width or good.mean() < 0.2:
                q, c = np.nonzero(good)
                so_far = so_far[q, c]
        else:
            so_far = so_far + ((other[q] - own[c]) ** 2).sum(axis=1)
            good = so_far * (width / b) <= bound[q] * ((1 + DOUBT / np.sqrt(b)) ** 2 if b < width else 1 + 1e-9)
            q, c, so_far = q[good], c[good], so_far[good]
    score = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], data[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    keep = score >= beat[q]
    q, c, score = q[keep], c[keep], score[keep]
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < most
    return q[keep], c[keep], score[keep]


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, miss: float = 0.02, first_lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(``query_id``, ``rank``, ``id_col``, ``score``): the ``k`` vectors with the largest inner
    product found for every query, nearest first, ties to the smaller id.

    ``vectors`` and ``queries`` have an id and a vector; a vector with the query's own id is no
    candidate. ``miss`` is the expected share of results that the lists left out may hold: more
    means fewer lists. Where the vectors have no direction at all, most lists are visited; where
    they come in clusters, few. ``score`` is exact, in double precision on the given vectors.

    Vectors that are null, all zero, or hold a null or a number that is not finite take no part,
    nor do rows with a null id, nor vectors of another length than the most common one (ties: the
    longer). Equal rows count once. Copies of one vector are searched once: at most ``k`` + 1 ids
    of it can be among any query's results. Empty tables give an empty result. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    floats = F.col("_v").cast("array<float>")
    fine = F.col("_id").isNotNull() & F.coalesce(
        F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0), F.lit(False)
    )

    def proper(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_v")).withColumn("_v", floats).where(fine)
        # Adding zero makes one of both zeros.
        return rows.withColumn("_v", F.transform("_v", lambda x: (x + F.lit(0.0).cast("float")).cast("float")))

    lengths = proper(vectors).groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    out = f"query_id bigint, rank int, {id_col} bigint, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    width = lengths[0]["n"]

    def packed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("_v")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["_id", "vec"])

        return proper(df).where(F.size("_v") == width).select("_id", "_v").mapInArrow(run, "_id bigint, vec binary")

    by_copy = Window.partitionBy("vec").orderBy("_id")
    ranked = packed(vectors).withColumn("_n", F.dense_rank().over(by_copy)).where(F.col("_n") <= k + 1)
    data = stored(ranked.groupBy("vec").agg(F.sort_array(F.collect_set("_id")).alias("ids")), "vectors")
    asked = stored(packed(queries).distinct().withColumn("query", F.xxhash64("vec")), "queries")
    wanted = asked.groupBy("query", "vec").agg(F.lit(1).alias("_one")).drop("_one")

    total = data.count()

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((found**2).sum(axis=1).max(initial=0)))])], names=["norm"])

    top = data.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 1.0
    sample = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(FIT_ROWS).toPandas()["vec"]
    lists = Lists(np.frombuffer(b"".join(sample), "<f4").reshape(-1, width).astype(np.float64), float(top), int(round(total**0.5)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = lists.lift(_matrix(batch.column("vec"), width))
            home = lists.nearest(points)
            away = ((points - lists.centres[home]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(away), *batch.columns], names=["list", "away", *batch.schema.names])

    index = stored(data.mapInArrow(homes, "list bigint, away double, vec binary, ids array<bigint>"), "lists")
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("away").alias("away")).collect():  # one row a list
        lists.sizes[r["list"]] = r["n"]
        lists.spread[r["list"]] = np.sqrt(r["away"] / width)
    blocks = np.maximum(1, -(-lists.sizes // CELL)).astype(np.int64)

    def searched(probes: DataFrame) -> DataFrame:
        """Scan the lists in ``probes(query, vec, beat, list)``: cells of a block of the list and a chunk of its queries."""
        counts = probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a list
        chunks = np.ones(len(blocks), np.int64)
        for r in counts:
            chunks[r["list"]] = -(-r["n"] // CELL)
        sizes = spark.createDataFrame([(int(i), int(b), int(c)) for i, (b, c) in enumerate(zip(blocks, chunks, strict=True))], "list bigint, blocks bigint, chunks bigint")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        left = index.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec"), "blocks").alias("block"), each("chunks").alias("chunk"), "vec", "ids")
        right = probes.join(F.broadcast(sizes), "list").select("list", each("blocks").alias("block"), F.pmod(F.xxhash64("query", F.lit(3)), "chunks").alias("chunk"), "query", "vec", "beat")
        cell = ["list", "block", "chunk"]

        def compared(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                none = pa.array([], pa.int64())
                return pa.table({"query": none, "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
            firsts = np.array([x[0] for x in a.column("ids").to_pylist()])
            a = a.take(pa.array(np.argsort(firsts, kind="stable")))  # equal scores: smaller ids first
            data, asked = _matrix(a.column("vec"), width), _matrix(b.column("vec"), width)
            beat = b.column("beat").to_numpy()
            q, c, s = scan(lists, data, asked, beat, k + 1)
            return pa.table({"query": b.column("query").take(pa.array(q)), "score": pa.array(s), "ids": a.column("ids").take(pa.array(c))})

        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compared, "query bigint, score double, ids array<bigint>")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                score = lists.scores(_matrix(part.column("vec"), width))
                near = np.argsort(-score, axis=1, kind="stable")[:, :first_lists]
                rows = np.repeat(np.arange(part.num_rows), near.shape[1])
                near = near.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query").take(pa.array(rows)), part.column("vec").take(pa.array(rows)), pa.array(np.full(len(rows), -np.inf)), pa.array(near)],
                    names=["query", "vec", "beat", "list"],
                )

    schema = "query bigint, vec binary, beat double, list bigint"
    early = stored(searched(wanted.select("query", "vec").mapInArrow(routed, schema)), "near-lists")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    kth = early.withColumn("_n", F.row_number().over(place)).where(F.col("_n") == k + 1).select("query", F.col("score").alias("beat"))
    goals = wanted.join(kth, "query", "left").select("query", "vec", F.coalesce("beat", F.lit(float("-inf"))).alias("beat"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                found = lists.visits(_matrix(part.column("vec"), width), part.column("beat").to_numpy(), first_lists, miss, k)
                rows = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(rows)) for c in ("query", "vec", "beat")), pa.array(np.concatenate(found).astype(np.int64))],
                    names=["query", "vec", "beat", "list"],
                )

    late = searched(stored(goals.mapInArrow(onward, schema), "probes"))
    # A vector found twice shares its rank with itself and counts once.
    best = early.union(late).withColumn("_n", F.dense_rank().over(place)).where(F.col("_n") <= k + 1)
    flat = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))))
    # Written out: one row for each distinct query vector, so that a hot one can be split below.
    answers = stored(best.groupBy("query").agg(F.sort_array(F.array_distinct(flat)).alias("found")), "answers")
    rows = asked.select(F.col("_id").alias("query_id"), "query").join(answers, "query")
    own = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(own).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias(id_col), (-F.col("f.far")).alias("score")
    )
