"""Running progress of a dataset run: streaming, and as a batch table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wafermill.plans.attach import attach
from wafermill.plans.ranks import running_sums
from wafermill.session import cut_lineage, scratch_path

STREAM_SCHEMA = "sample_id bigint, pcell string, success boolean, execution_time double"


def _rates(completed: Column, succeeded: Column, elapsed: Column, planned: Column) -> list[Column]:
    mean = elapsed / completed
    return [
        (succeeded * 100.0 / completed).alias("success_rate"),
        elapsed.alias("elapsed"),
        F.round(mean, 6).alias("avg_time"),
        F.round(mean * (planned - completed), 6).alias("eta"),
    ]


def progress(results: DataFrame, by: list[str], planned: int) -> DataFrame:
    """Completed count, success rate, elapsed time, mean and time left per group.

    Works on a batch table and, in complete mode, on a stream: the state is one row per
    group.
    """
    spent = F.sum(F.coalesce("execution_time", F.lit(0.0)).cast("decimal(28,6)"))
    state = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("success").alias("_ok"), spent.cast("double").alias("_spent")
    )
    return state.select(
        *by, "completed", *_rates(F.col("completed"), F.col("_ok"), F.col("_spent"), F.lit(planned))
    )


def progress_stream(spark: SparkSession, path: str, by: list[str], planned: int, files_per_batch: int = 4) -> DataFrame:
    """Follow JSON result files as they arrive and return the last state table.

    Runs over what is there (``availableNow``) in several batches. Every batch replaces
    the state table under a path of its own, so a restarted batch writes the same data.
    """
    out = scratch_path(spark, "progress")
    stream = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)

    last = {}

    def keep(state: DataFrame, batch: int) -> None:
        last["batch"] = max(batch, last.get("batch", 0))
        state.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/state/{batch:09d}")

    run = (
        progress(stream, by, planned)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    run.awaitTermination()
    if not last:
        return progress(spark.createDataFrame([], STREAM_SCHEMA), by, planned)
    return spark.read.parquet(f"{out}/state/{last['batch']:09d}").drop("batch")


def _running(results: DataFrame, by: list[str], order: str) -> DataFrame:
    """Running ``completed``, ``_ok`` and ``_spent`` at every sample."""
    spent = F.coalesce("execution_time", F.lit(0.0)).cast("decimal(20,6)")
    return running_sums(
        results.select(*by, order, "success", spent.alias("_t")),
        by,
        [F.col(order).asc()],
        {"completed": F.lit(1).cast("long"), "_ok": F.coalesce("success", F.lit(False)).cast("long"), "_spent": F.col("_t")},
    ).select(*by, order, "completed", "_ok", F.col("_spent").cast("decimal(38,6)").alias("_spent"))


def _shown(sums: DataFrame, by: list[str], order: str, planned: int) -> DataFrame:
    rates = _rates(F.col("completed"), F.col("_ok"), F.col("_spent").cast("double"), F.lit(planned))
    return sums.select(*by, order, "completed", *rates)


def progress_rows(results: DataFrame, by: list[str], order: str, planned: int) -> DataFrame:
    """The same numbers after every completed sample, in the order of ``order``."""
    return _shown(_running(results, by, order), by, order, planned)


def follow_progress(
    spark: SparkSession, path: str, by: list[str], order: str, planned: int, out: str, files_per_batch: int = 1000
) -> DataFrame:
    """The numbers of :func:`progress_rows` for every sample, as a stream brings them.

    Follows JSON result files in ``path`` and appends one row per sample to a table under ``out``, with
    the number of the ``batch`` that brought it; returns the whole table. Each call takes what is there
    and not yet done (``availableNow``), so a stopped run goes on where it was.

    Samples count in the order of their arrival: by batch, and by ``order`` inside a batch. A late sample is
    counted when it comes; earlier rows stay. A sample (``by`` and ``order``) that comes again, in
    the same file, a later one or a copy of a file, is dropped: the stream's state store
    remembers all of them, one entry a sample, dealt out by their hash. If a sample comes twice
    in one batch with different values, one of the two counts.

    The sums of earlier batches are a small table of one row a group. A batch writes its rows and its
    sums under paths of its own from the sums of the batch before, so that a batch that is
    run again after a failure writes the same. Groups are never summed by one task.
    """
    stream = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    stream = stream.select(*by, order, "success", "execution_time").dropDuplicates([*by, order])
    sums = ["completed", "_ok", "_spent"]

    def keep(samples: DataFrame, batch: int) -> None:
        local = cut_lineage(_running(samples, by, order))
        own = local.groupBy(*by).agg(*[F.max(c).alias(c) for c in sums])
        if batch:
            before = spark.read.parquet(f"{out}/sums").where(F.col("batch") < batch)
            latest = before.agg(F.max("batch")).first()[0]
            before = cut_lineage(before.where(F.col("batch") == latest).drop("batch"))
            rows = attach(local, before.select(*by, *[F.col(c).alias(f"_before{c}") for c in sums]), by, "left")
            for c in sums:
                rows = rows.withColumn(c, F.col(c) + F.coalesce(f"_before{c}", F.lit(0)))
            own = own.unionByName(before).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
        else:
            rows = local
        own = own.withColumn("_spent", F.col("_spent").cast("decimal(38,6)"))
        _shown(rows, by, order, planned).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        own.write.mode("overwrite").parquet(f"{out}/sums/batch={batch}")

    run = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    rows = _shown(_running(spark.createDataFrame([], STREAM_SCHEMA), by, order), by, order, planned)
    return spark.read.schema(rows.withColumn("batch", F.lit(0)).schema).parquet(f"{out}/rows")
