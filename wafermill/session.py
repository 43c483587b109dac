"""Session set-up for tests and benchmarks, and the shared scratch area of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "wafermill") -> SparkSession:
    """A single-machine session for tests and benchmarks. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables with much work a row: keep all cores busy instead of merging partitions to 1 MB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wafermill-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="wafermill-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only in local mode a fresh local folder is made where that setting is missing (tests,
    notebooks). On a cluster every node would write to its own disk, so that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    context = spark.sparkContext
    one_machine = context.master == "local" or context.master.startswith("local[")
    if conf is None and context.getCheckpointDir() is None and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(conf or tempfile.mkdtemp(prefix="wafermill-"))
    return conf or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/wafermill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: a plain scan, without the partitioning it had."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
