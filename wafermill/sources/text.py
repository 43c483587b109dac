"""Line-based sources: reports, fenced JSON, score blocks, netlists, measurement files.

Every parser takes a line table ``(path, line_no, line)``, so files and text columns use
the same code.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafermill.functions.columns import is_whole_json, plain_float, strip, tokens
from wafermill.plans.scan import LINES_PER_CHUNK, carry_forward
from wafermill.session import cut_lineage
from wafermill.sources.files import whole_files

# Formats of the text files.
FENCE = "```"
JSON_FENCE = "```json"
RANK_HEADER = r"^RANK\s+(\d+):\s+(\S+)\s+\(ID:\s*(\d+)\)"
BLOCK_END = r"^-{5,}"
MISSING = -987.654321


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text files as ``(path, line_no, line)``, numbered from 1 in each file.

    Large files stay splittable: lines are read by split, kept with their order inside
    the split, and the line counts of earlier splits of the same file are added. The
    lines are checkpointed first, so both uses see the same splits.
    """
    placed = cut_lineage(
        spark.read.options(**options).text(path).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_pos"),
            F.col("value").alias("line"),
        )
    )
    splits = placed.groupBy("path", "_start").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select(
        "path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return placed.join(shifts, ["path", "_start"]).select(
        "path", (F.col("_pos") + F.col("_shift")).alias("line_no"), "line"
    )


def text_lines(df: DataFrame, path: str, text: str) -> DataFrame:
    """Whole texts held in a column as ``(path, line_no, line)``."""
    return df.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Reports as trimmed lines in order."""
    return read_lines(spark, path).withColumn("line", strip("line"))


def _blocks(lines: DataFrame, opens: Column, closes: Column, chunk: int) -> DataFrame:
    """Add ``block`` (line number of the opening line, null outside of blocks)."""
    mark = F.when(opens, F.col("line_no")).when(closes, -1)
    state = carry_forward(lines, ["path"], "line_no", {"_state": mark}, chunk)
    return state.withColumn("block", F.when(F.col("_state") >= 0, F.col("_state"))).drop("_state")


def fenced_json_texts(lines: DataFrame, trim_body: bool = False, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """JSON texts of fenced blocks and single-line objects, with their kind.

    Columns: path, line_no (first line), kind (``block``, ``inline``, ``unterminated``),
    text, ok. A block that meets another opening fence first is given up, as is an empty
    one. ``trim_body`` keeps the trimmed lines inside a block instead of the raw ones.
    """
    rows = lines.withColumn("_t", strip("line")).where("_t <> ''")
    opens = F.col("_t").startswith(JSON_FENCE)
    fence = F.col("_t").startswith(FENCE)
    rows = _blocks(rows, opens, fence, chunk)
    # The next fence below decides how the block ended; the same scan in reverse order.
    rows = rows.withColumn("_back", -F.col("line_no"))
    rows = carry_forward(
        rows, ["path"], "_back", {"_next": F.when(opens, "open").when(fence, "close")}, chunk
    )
    body = F.col("_t") if trim_body else F.col("line")
    inside = rows.where(F.col("block").isNotNull() & ~fence)
    blocks = (
        inside.groupBy("path", "block")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", body.alias("l")))).alias("parts"),
            F.first("_next").alias("_next"),
        )
        .where("_next IS NULL OR _next = 'close'")
        .select(
            "path",
            F.col("block").alias("line_no"),
            F.when(F.col("_next").isNull(), "unterminated").otherwise("block").alias("kind"),
            F.array_join(F.transform("parts", lambda p: p["l"]), "\n").alias("text"),
        )
    )
    inline = rows.where(F.col("block").isNull() & F.col("_t").startswith("{")).select(
        "path", "line_no", F.lit("inline").alias("kind"), F.col("_t").alias("text")
    )
    return blocks.union(inline).withColumn("ok", F.coalesce(is_whole_json(F.col("text")), F.lit(False)))


def read_fenced_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed objects of fenced-JSON files; bad ones are left out (see the quarantine)."""
    found = fenced_json_texts(read_lines(spark, path))
    return parsed_json(found, schema)


def parsed_json(found: DataFrame, schema: str) -> DataFrame:
    """Good JSON texts as structs."""
    return found.where("ok").select("path", "line_no", "kind", F.from_json("text", schema).alias("item"))


def load_json_or_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``.json``: a list or one object; ``.jsonl``: lines or fenced blocks; else an error."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1]
    if suffix == "jsonl":
        return parsed_json(fenced_json_texts(read_lines(spark, path), trim_body=True), schema).select("item.*")
    if suffix == "json":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError("unsupported file type; expected .json or .jsonl")


#: Folder of rows whose key is null or empty, as Spark names it.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def _written_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Write every row (run, model_size, content as bytes) as one file; counts them. A task that runs again
    writes the same names, and a file appears whole."""
    task, n, made = TaskContext.get().partitionId(), 0, set()
    for batch in batches:
        for run, size, content in zip(*(c.to_pylist() for c in batch.columns)):
            folder = os.path.join(root, *(f"{k}={quote(v, safe='') if v else NO_KEY}" for k, v in (("run", run), ("model_size", size))))
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            draft = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(draft, "wb") as out:
                out.write((content or b"") + b"\n")
            os.replace(draft, os.path.join(folder, f"part-{task:05d}-{n}.txt"))
            n += 1
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def write_predictions(rows: DataFrame, root: str) -> None:
    """One file per row of ``(run, model_size, content)`` under ``root/run=<run>/model_size=<size>/``.

    ``root`` must be a folder that all nodes share. Where it is a mounted one, tasks write the files
    themselves: Hadoop's local file system starts a process for the rights of every file. Other
    file systems are written by Spark.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme, _, folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().partition(":")
    if scheme == "file":
        binary = rows.select("run", "model_size", F.col("content").cast("binary").alias("content"))
        binary.mapInArrow(lambda batches: _written_files(batches, folder), "n bigint").agg(F.sum("n")).first()
    else:
        rows.select("run", "model_size", "content").write.option("maxRecordsPerFile", 1).partitionBy("run", "model_size").text(root)


def read_predictions(spark: SparkSession, root: str, pattern: str = "prediction_*.txt") -> DataFrame:
    """``<run>/<size>/prediction_*.txt`` as (run, model_size, file, content)."""
    files = whole_files(spark, root, pattern)
    part = r"([^/]+)/([^/]+)/([^/]+)$"
    return files.select(
        F.regexp_extract("path", part, 1).alias("run"),
        F.regexp_extract("path", part, 2).alias("model_size"),
        F.regexp_extract("path", part, 3).alias("file"),
        "content",
    )


def score_blocks(lines: DataFrame, keys: list[str], chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """``RANK n: name (ID: k)`` blocks, one row each with the wanted keys as text.

    A block ends at a dashed line, at the next header, or at the end of the file. Lines
    outside of blocks and section headers are ignored; a repeated key keeps its last value.
    """
    header = F.col("line").rlike(RANK_HEADER)
    rows = _blocks(lines, header, F.col("line").rlike(BLOCK_END), chunk).where("block IS NOT NULL")
    text = strip("line")
    section = text.endswith(":") & ~F.contains(F.left(text, F.length(text) - 1), F.lit(":"))
    key = F.when(~header & ~section & F.contains(text, F.lit(":")), strip(F.substring_index("line", ":", 1)))
    value = strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    rows = rows.select("path", "block", "line_no", "line", header.alias("_h"), key.alias("_k"), value.alias("_v"))
    picked = [
        F.max_by(F.when(F.col("_k") == k, F.col("_v")), F.when(F.col("_k") == k, F.col("line_no"))).alias(k)
        for k in keys
    ]
    head = F.max(F.when(F.col("_h"), F.col("line")))
    return (
        rows.groupBy("path", "block").agg(head.alias("_head"), *picked)
        .select(
            "path",
            F.regexp_extract("_head", RANK_HEADER, 1).cast("int").alias("rank"),
            F.regexp_extract("_head", RANK_HEADER, 2).alias("component_name_header"),
            F.regexp_extract("_head", RANK_HEADER, 3).cast("long").alias("id"),
            *keys,
        )
    )


def measurements(
    ac: DataFrame, power: DataFrame, noise: DataFrame, slew: DataFrame, key: str, sentinel: bool = False
) -> DataFrame:
    """Numbers by position from the first line of four result texts per design.

    Inputs are ``(key, text)``. A missing file, a short line or an unreadable number gives
    null, or the sentinel when asked for.
    """
    # Result name -> (file, position, fewest columns for a usable line).
    spots = {
        "ugb": ("ac", 1, 10), "Ibias1": ("ac", 3, 10), "Ibias2": ("ac", 5, 10), "phaseMargin": ("ac", 7, 10),
        "dcGain": ("ac", 9, 10), "bw_3db": ("ac", 11, 10), "power": ("power", 1, 2), "noise": ("noise", 1, 2),
        "rise_slew": ("slew", 1, 3), "fall_slew": ("slew", 3, 3),
    }
    joined = None
    for name, df in {"ac": ac, "power": power, "noise": noise, "slew": slew}.items():
        first = df.select(key, tokens(F.split("text", "\n")[0]).alias(f"_{name}"))
        joined = first if joined is None else joined.join(first, key, "full_outer")
    columns = []
    for out, (name, at, least) in spots.items():
        parts = F.col(f"_{name}")
        value = F.when(F.size(parts) >= least, plain_float(F.try_element_at(parts, F.lit(at + 1))))
        columns.append((F.coalesce(value, F.lit(MISSING)) if sentinel else value).alias(out))
    return joined.select(key, *columns)


def netlist_lines(lines: DataFrame, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Netlist lines with their ``+`` continuations glued on; empty lines dropped."""
    rows = lines.withColumn("_t", strip("line")).where("_t <> ''")
    glued = F.col("_t").startswith("+")
    rows = carry_forward(rows, ["path"], "line_no", {"_head": F.when(~glued, F.col("line_no"))}, chunk)
    part = strip(F.when(glued, F.replace("_t", F.lit("+"), F.lit(""))).otherwise(F.rtrim("_t", F.lit("+"))))
    return (
        rows.where("_head IS NOT NULL")
        .groupBy("path", F.col("_head").alias("line_no"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", part.alias("l")))).alias("parts"))
        .select("path", "line_no", F.array_join(F.transform("parts", lambda p: p["l"]), " ").alias("line"))
    )
