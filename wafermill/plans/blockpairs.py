"""Nearest neighbours inside groups by comparing whole blocks of points.

Points of a group are dealt to stripes by a digest, and every pair of stripes is one group of a Spark
shuffle: a point goes to as many pairs as its group has stripes, so what a task holds is bounded by two
stripes, whatever the size of the group. Inside a pair squared distances come from inner products, a
run of rows at a time. They are off by rounding, so they only say which pairs may be the nearest: all
within the error bound of the smallest are measured coordinate by coordinate.

Groups that fit into a handful of rows are joined with themselves instead, which needs no Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.metricindex import distance

#: Points of a stripe, rows compared at a time, and pairs measured at a time.
STRIPE, ROWS, MEASURED = 8192, 1024, 1 << 16
#: Groups of up to this many points are joined with themselves.
FEW = 64


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def nearest_in_block(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Exact distance of each row of ``a`` to the nearest row of ``b``, and the other way round; without
    ``b`` to the nearest other row of ``a``. Infinite where there is none."""
    same = b is None
    b = a if same else b
    best_a, best_b = np.full(len(a), np.inf), np.full(len(b), np.inf)
    if not len(a) or not len(b):
        return best_a, best_b
    # The same origin and scale for both: smaller numbers, smaller errors, no overflow.
    scale = max(np.abs(a).max(), np.abs(b).max()) or 1.0
    centre = (b / scale).mean(0)
    p, q = a / scale - centre, b / scale - centre
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps
    # Moving the origin rounds by about one part of the largest number (1 after scaling).
    slack_a = error * (np.sqrt(pp) + np.sqrt(qq.max()) + 1) ** 2
    slack_b = error * (np.sqrt(qq) + np.sqrt(pp.max()) + 1) ** 2
    least_b = np.full(len(b), np.inf)
    for low in range(0, len(a), ROWS):
        part = slice(low, min(low + ROWS, len(a)))
        about = p[part] @ q.T
        about *= -2
        about += pp[part, None]
        about += qq
        rows = np.arange(part.stop - low)
        if same:
            about[rows, rows + low] = np.inf
        np.minimum(least_b, about.min(0), out=least_b)
        maybe = about <= (about.min(1) + slack_a[part])[:, None]
        if not same:
            maybe |= about <= least_b + slack_b
        i, j = np.nonzero(maybe)
        for start in range(0, len(i), MEASURED):
            x, y = i[start : start + MEASURED] + low, j[start : start + MEASURED]
            with np.errstate(over="ignore"):
                d = np.sqrt(((a[x] - b[y]) ** 2).sum(1))
            if same:
                d[x == y] = np.inf
            np.minimum.at(best_a, x, d)
            np.minimum.at(best_b, y, d)
    return best_a, best_b


def _self_joined(points: DataFrame, by: list[str], dims: int) -> DataFrame:
    there = points.select(*by, F.col("id").alias("_id"), F.col("v").alias("q"))
    # As many rows as points, whatever the planner guesses: never a broadcast.
    met = null_safe_join(points, there.hint("merge"), by).where("id <> _id")
    return met.groupBy(*by, "id").agg(F.min(distance("v", "q", dims)).alias("nearest"))


def _by_stripes(points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` with ``_n``, the size of their group."""
    stripes = F.ceil(F.col("_n") / F.lit(float(STRIPE))).cast("int")
    dealt = points.withColumn("_all", stripes).withColumn("_own", F.pmod(F.xxhash64("id", F.lit("stripe")), "_all").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)))
    dealt = dealt.select(*by, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "id", "v")

    def compared(group: pa.Table) -> pa.Table:
        own, v = group.column("_own").to_numpy(), _matrix(group.column("v"))
        if group.column("_i")[0] == group.column("_j")[0]:
            found = nearest_in_block(v, None)[0]
        else:
            first = own == group.column("_i")[0].as_py()
            found = np.empty(len(v))
            found[first], found[~first] = nearest_in_block(v[first], v[~first])
        kept = group.select([*by, "id"]).append_column("d", pa.array(found, pa.float64()))
        # Infinite: nobody was met here (or only points too far for a double).
        return kept

    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "id"]) + ", d double"
    return dealt.groupBy(*by, "_i", "_j").applyInArrow(compared, schema).groupBy(*by, "id").agg(F.min("d").alias("nearest"))


def nearest_others(points: DataFrame, by: list[str], dims: int) -> DataFrame:
    """(``by``, ``id``, ``nearest``) for the distinct ``points(by..., id, v)``: distance to the nearest other
    point of the group. Points without another one have no row. ``v`` holds ``dims`` finite numbers;
    ``by`` may hold nulls; ids are unique in a group. ``points`` is read twice: write it first."""
    points = points.select(*by, "id", "v")
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(points, sizes, by)
    few = _self_joined(sized.where(F.col("_n") <= FEW).drop("_n"), by, dims)
    return few.unionByName(_by_stripes(sized.where(F.col("_n") > FEW), by))
