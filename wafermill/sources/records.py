"""JSON, CSV, Parquet and XML sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.session import cut_lineage

RESULT_SCHEMA = (
    "sample_id bigint, component_name string, success boolean, drc_pass boolean, lvs_pass boolean, "
    "execution_time double, parameters map<string,string>, output_directory string, pex_status string, "
    "total_resistance_ohms double, total_capacitance_farads double, area_um2 double, "
    "symmetry_horizontal double, symmetry_vertical double, error string"
)
PARAMS_SCHEMA = "width array<double>, length array<double>, fingers array<int>, multipliers array<int>"


def read_records_json(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Files holding one JSON array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_params_json(spark: SparkSession, path: str, schema: str = PARAMS_SCHEMA) -> DataFrame:
    """Parameter lists with array fields; a missing path is an error."""
    return read_records_json(spark, path, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, non-ASCII kept."""
    df.write.json(path)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text first."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema
    ]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def write_training_matrix(params: DataFrame, results: DataFrame, key: str, path: str) -> None:
    """Aligned parameter and result tables, one row per sample in each.

    Every sample with parameters is in both; results it does not have are null. The joined rows
    are written once and both tables come from there, so they stay aligned.
    """
    both = cut_lineage(params.join(results, key, "left"))
    both.select(*params.columns).write.parquet(f"{path}/params")
    both.select(key, *[c for c in results.columns if c != key]).write.parquet(f"{path}/results")


def read_violation_xml(spark: SparkSession, path: str) -> DataFrame:
    """Violations per file and category from checker result files.

    A file whose root is not ``report-database`` raises an error.
    """
    root = r"<\s*([A-Za-z][\w.-]*)"
    lines = spark.read.text(path)
    first_tag = (
        lines.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("pos"), F.regexp_extract("value", root, 1).alias("tag"),
        )
        .where("tag <> ''")
        .groupBy("path")
        .agg(F.min_by("tag", F.struct("start", "pos")).alias("root"))
    )
    checked = first_tag.select(
        "path",
        F.when(F.col("root") == "report-database", F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("not a report database: "), "path")).cast("boolean"))
        .alias("valid"),
    )
    items = (
        spark.read.format("xml").option("rowTag", "item").schema("category string, cell string").load(path)
        .select(F.col("_metadata.file_path").alias("path"), "category", "cell")
        .groupBy("path", "category").agg(F.count(F.lit(1)).alias("violations"))
    )
    return checked.join(items, "path", "left").select(
        "path", "category", F.coalesce("violations", F.lit(0)).alias("violations"),
        (F.col("valid") & F.col("category").isNull()).alias("is_pass"),
    )
