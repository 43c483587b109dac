"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafermill.session import scratch_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, every executor sees it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._wafermill_path = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables made by :func:`stored` once nothing will read them again."""
    for df in kept:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._wafermill_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of ``column``, or one row."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered_filter(masks: DataFrame, words: int) -> np.ndarray:
    """The 64-bit words of a filter from rows (``word``, ``mask``): 8 * ``words`` bytes, whatever
    the number of rows. Executors put stretches of it together; only those come to the driver."""
    stretch = 1 << 12

    def packed(rows: pa.Table) -> pa.Table:
        own = np.zeros(stretch, "<u8")
        at = rows.column("word").to_numpy()
        own[at % stretch] = rows.column("mask").to_numpy().view(np.uint64)
        return pa.table({"part": pa.array([int(at[0]) // stretch], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    merged = masks.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    parts = merged.groupBy((F.col("word") / stretch).cast("bigint").alias("part")).applyInArrow(packed, "part bigint, bits binary")
    out = np.zeros(words, np.uint64)
    for row in parts.collect():
        out[row["part"] * stretch :][:stretch] = np.frombuffer(row["bits"], "<u8")
    return out
