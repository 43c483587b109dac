"""Prediction files are listed and read by tasks, as Spark's own reader would read them."""

import os

import pytest
from pyspark.sql import functions as F

from wafermill.sources import files, text


def spark_reader(spark, root, pattern):
    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def rows(frame):
    return sorted((r.path, bytes(r.content)) for r in frame.select("path", F.col("content").cast("binary").alias("content")).collect())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files") / "ro ot%20"
    for name in [
        "part-0.txt", "a/part-1.txt", "run=a%2520+b/7b/part-2.txt", "run=a/_hid/part-3.txt", "run=a/_k=1/part-4.txt", "run=a/.h/part-5.txt",
        "r/s/.part-6.txt", "r/s/_part-7.txt", "r/s/part-8.txt.bak", "r/s/other.txt", "r/s/part-9#?;@&=$,!~*'().txt",
        "r/s/part-[]{}|\\^`\"<>.txt", "r/s/t/u/v/part-11.txt", "r/s/part-nl\n\t.txt", "r/s/part-12.txt._COPYING_",
    ]:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() + b"\r\n")
    (root / "r/s/part-empty.txt").write_bytes(b"")
    (root / "r/s/part-bad.txt").write_bytes(b"\xff\xfe\x00abc\xe9")
    (root / "r/s/part-bom.txt").write_bytes(b"\xef\xbb\xbfabc")
    os.symlink(root / "a", root / "r/linked")
    os.symlink("/nowhere", root / "r/s/part-dead.txt")
    return str(root)


@pytest.mark.parametrize(("start", "below", "pattern"), [
    ("", "", "part-*.txt"), ("file:", "/r//", "{part-1,part-b}*.txt"), ("", "/{r,a}", "part-[!1]*.txt"), ("", "/{r,r/s}", "*.txt"),
    ("", "/a/part-1.txt", "part-*.txt"), ("", "", "no*.txt"), ("", "", "part-*"),
])
def test_same_files_as_the_spark_reader(spark, tree, start, below, pattern):
    root = start + tree + below
    assert rows(files.whole_files(spark, root, pattern)) == rows(spark_reader(spark, root, pattern))


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_predictions(spark, str(tmp_path / "none"))


def test_names_outside_of_ascii():
    assert files._quoted("/a b/\u00e9\u2028%\U0001f600".encode()) == "/a%20b/\u00e9%E2%80%A8%25\U0001f600"


def test_driver_keeps_no_file_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 400)
    wrote = {}
    for k in range(3000):
        path = tmp_path / f"run-{k % 3}" / f"{k % 2}b" / f"prediction_{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text {k}\n")
        wrote[f"run-{k % 3}", f"{k % 2}b", f"prediction_{k}.txt"] = f"text {k}\n"
    got = text.read_predictions(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if f.endswith(".txt")]
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert 1 < len(sizes) <= 8
    found = got.collect()
    assert len(found) == 3000 and {(r.run, r.model_size, r.file): r.content for r in found} == wrote
