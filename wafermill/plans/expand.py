"""Turn a row into many numbered rows without building one huge array in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_STEP = 65536


def numbered_rows(df: DataFrame, count: Column, out: str, keys: list[str]) -> DataFrame:
    """Repeat each row ``count`` times with ``out`` running 0..count-1.

    The first explode makes one row per block of 65,536 numbers; these blocks are spread
    by hash before the second explode, so one row that asks for billions still runs on
    every executor. Rows are only produced in a streaming way after that.
    """
    sized = df.withColumn("_count", count.cast("long")).where("_count > 0")
    blocks = sized.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / ROWS_PER_STEP)))
    ).repartition(*keys, "_block")
    first = F.col("_block") * ROWS_PER_STEP
    last = F.least(first + ROWS_PER_STEP - 1, F.col("_count") - 1)
    return blocks.withColumn(out, F.explode(F.sequence(first, last))).drop("_count", "_block")
