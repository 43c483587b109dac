"""Exact ranks that never sort a whole group in one task.

``row_number()`` over a hot key pulls that key's rows into one task. Both forms here
number rows inside small slices and add the size of the slices before them, so a key
with a third of the table is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafermill.plans.attach import attach, null_safe_join
from wafermill.session import cut_lineage


def hash_rank(
    df: DataFrame, by: list[str], token: str, ties: list[str], out: str, prefix: int = 3
) -> DataFrame:
    """Rank from 1 within ``by`` in the order of ``token`` (a hex digest), then ``ties``.

    Digests are uniform, so their first ``prefix`` hex digits cut every group into even
    slices: 3 digits give 4,096 slices per group. The offsets are at most that many small
    rows per group.
    """
    cut = df.withColumn("_slice", F.substring(token, 1, prefix))
    sizes = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(token, *ties)
    # Small groups have about as many offsets as rows, and their number is guessed from a table
    # before its rows were repeated: never broadcast them. Without groups there are few.
    offsets = offsets.hint("merge") if by else offsets
    return (
        null_safe_join(cut.withColumn("_rn", F.row_number().over(inside)), offsets, [*by, "_slice"])
        .withColumn(out, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_slice", "_rn", "_before")
    )


def range_rank(
    df: DataFrame, by: list[str], order: list[Column], out: str, slices: int | None = None
) -> DataFrame:
    """Rank from 1 within ``by`` in the order of ``order``, which must have no ties.

    One range shuffle on (by, order) puts the rows in global order; the position inside
    the sorted partition comes from ``monotonically_increasing_id``. The sorted rows are
    checkpointed so that partition numbers stay fixed when executors are lost. The first
    position of each key in each partition is broadcast when that table is small, so the
    rows themselves move only once.
    """
    keys = [F.col(k).asc_nulls_first() for k in by] + order
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_pos", 33)
    runs = placed.groupBy(*by, part.alias("_part")).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *[F.col(k).alias(f"_by_{k}") for k in by],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_p") == part
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return (
        attach(placed, starts, same)
        .withColumn(out, (F.col("_pos") + F.col("_shift") + 1).cast("long"))
        .drop("_pos", "_p", "_shift", *[f"_by_{k}" for k in by])
    )


def running_sums(
    df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], slices: int | None = None
) -> DataFrame:
    """Add running sums (this row included) within ``by`` in the order of ``order``.

    Works like :func:`range_rank`: the window runs inside one sorted range partition and
    the totals of earlier partitions are added, so no key is summed by one task.
    """
    keys = [F.col(k).asc_nulls_first() for k in by] + order
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums]
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_pos")
    local = placed
    for n, c in sums.items():
        local = local.withColumn(n, F.sum(c).over(inside))
    joined = attach(local, starts, [*by, "_part"])
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_s_{n}"))
    return joined.drop("_part", "_pos", *[f"_s_{n}" for n in sums])
