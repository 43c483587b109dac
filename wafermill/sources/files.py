"""Whole files of a folder, however many there are.

Spark's reader keeps an entry for every file of a folder in the driver, and a task for every few of
them. Where the folder is a mounted one, tasks list it, a level of folders at a time, and read the
files themselves; the driver sees how many there are.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafermill.session import written

#: Files and bytes of a task that reads, files and bytes handed on at a time, tasks that list a level.
TASK_FILES, TASK_BYTES, BATCH_FILES, BATCH_BYTES, LISTING = 4096, 32 * 2**20, 1024, 4 * 2**20, 256
#: Signs that stand for themselves in the path of a Java URI.
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_.!~*'():@&=+$,;/")


def _quoted(path: bytes) -> str:
    """``path`` as Spark names files: blanks, control signs, per cent signs and the like are escaped."""
    def sign(c: str) -> str:
        kept = c in PLAIN or ord(c) > 127 and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
        return c if kept else "".join(f"%{b:02X}" for b in c.encode())

    return "".join(map(sign, path.decode("utf-8", "replace")))


def _ignored(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """The files of folders whose name matches, with their size, and the folders in them, without."""
    wanted = re.compile(pattern, re.DOTALL).fullmatch
    schema = pa.schema([("path", pa.binary()), ("size", pa.int64())])

    def entries() -> Iterator[tuple[bytes, int | None]]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as found:
                    for entry in found:
                        name = entry.name.decode("utf-8", "replace")
                        if entry.is_dir():
                            if not _ignored(name) or name.startswith(("_metadata", "_common_metadata")):
                                yield entry.path, None
                        elif not _ignored(name) and wanted(name):
                            try:
                                yield entry.path, entry.stat().st_size
                            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                                pass

    rows: list[tuple[bytes, int | None]] = []
    for row in entries():
        rows.append(row)
        if len(rows) == 4 * BATCH_FILES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _contents(batches: Iterator[pa.RecordBatch], scheme: str) -> Iterator[pa.RecordBatch]:
    """Name and bytes of every file, a few at a time."""
    names: list[str] = []
    texts: list[bytes] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "content": pa.array(texts, pa.binary())})

    held = 0
    for paths in batches:
        for path in paths.column(0).to_pylist():
            with open(path, "rb") as file:
                text = file.read()
            if held and held + len(text) > BATCH_BYTES or len(names) == BATCH_FILES:
                yield batch()
                names, texts, held = [], [], 0
            names.append(scheme + _quoted(path))
            texts.append(text)
            held += len(text)
    if names:
        yield batch()


def _folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """The folders that ``root`` names, if tasks can list them and read the files that match as they are; else none."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(root)
    system = path.getFileSystem(conf)
    if not system.makeQualified(path).toString().startswith("file:"):
        return []
    end = re.search(r"\.\w+$", pattern)
    if not end or hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hadoop.fs.Path(f"x{end[0]}")) is not None:
        return []  # Spark unpacks packed files
    found = list(system.globStatus(path) or [])
    return [f.getPath().toUri().getPath() for f in found] if all(f.isDirectory() for f in found) else []


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, content)`` of the files at any depth under ``root`` whose name matches the glob ``pattern``.

    Names that begin with a dot or an underscore and empty files are left out, as Spark's reader does.
    That reader is used for file systems that tasks cannot open, for patterns that packed files
    may match, and where ``root`` names files or nothing.
    """
    folders = _folders(spark, root, pattern)
    if not folders:
        files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    level = spark.createDataFrame([(bytearray(os.fsencode(f)),) for f in folders], "path binary")
    n, levels = len(folders), []
    while n:
        dealt = level.repartition(min(n, LISTING), "path")
        listed = written(dealt.mapInArrow(lambda batches: _listed(batches, matches), "path binary, size bigint"), "files")
        levels.append(listed.where("size > 0"))
        level = listed.where("size IS NULL").select("path")
        n = level.count()
    files = reduce(DataFrame.union, levels)
    files = files.distinct() if len(folders) > 1 else files
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    tasks = 1 + max(total["n"] // TASK_FILES, total["b"] // TASK_BYTES)
    dealt = files.select("path").repartition(tasks, "path")
    read = dealt.mapInArrow(lambda batches: _contents(batches, "file:"), "path string, content binary")
    return read.select("path", F.col("content").cast("string").alias("content"))
