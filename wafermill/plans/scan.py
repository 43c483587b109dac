"""Carry the last seen value forward in line order, without one task per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafermill.plans.attach import null_safe_join

LINES_PER_CHUNK = 65536


def carry_forward(
    df: DataFrame,
    by: list[str],
    order: str,
    marks: dict[str, Column],
    chunk: int = LINES_PER_CHUNK,
    counted: bool = False,
) -> DataFrame:
    """For each name in ``marks`` add the last non-null mark at or before the row.

    ``chunk`` is the span of ``order`` that goes into one task. Rows are windowed inside (by, chunk); one row per
    chunk carries the last mark of the chunks before it. A report with billions of lines
    therefore runs as many even tasks, and the chunk rows are the only ones windowed by
    ``by`` alone. A mark without a place in the order is not carried past the rows without one.

    Where the places lie far apart, nearly every row is a chunk. With ``counted`` the rows of the groups are
    counted first, and if none has more than ``chunk`` each group is one window.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    if counted and sizes.first()["n"] <= chunk:
        above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        placed = F.col(order).isNotNull()
        out = df
        for n, mark in marks.items():
            out = out.withColumn(f"_m_{n}", F.when(mark.isNotNull(), F.struct(placed.alias("placed"), mark.alias("mark"))))
        for n in marks:
            out = out.withColumn(f"_m_{n}", F.last(f"_m_{n}", ignorenulls=True).over(above))
        last = [F.when(F.col(f"_m_{n}.placed") == placed, F.col(f"_m_{n}.mark")).alias(n) for n in marks]
        return out.select(*[c for c in df.columns if c not in marks], *last)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    for name, mark in marks.items():
        cut = cut.withColumn(f"_m_{name}", mark)
    inside = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = cut.groupBy(*by, "_chunk").agg(
        *[
            F.max_by(F.col(f"_m_{n}"), F.when(F.col(f"_m_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}")
            for n in marks
        ]
    )
    carried = tails.select(
        *by, "_chunk", *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in marks]
    )
    out = cut
    for n in marks:
        out = out.withColumn(n, F.last(f"_m_{n}", ignorenulls=True).over(inside))
    out = null_safe_join(out, carried, [*by, "_chunk"])
    for n in marks:
        out = out.withColumn(n, F.coalesce(n, f"_c_{n}"))
    return out.drop("_chunk", *[f"_m_{n}" for n in marks], *[f"_c_{n}" for n in marks])
