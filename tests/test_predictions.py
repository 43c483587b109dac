"""Prediction files: one for every row, whatever its keys and text are."""

import os

from wafermill.sources import text


def test_every_row_is_one_file(spark, tmp_path):
    rows = [("a +b/c", "7b", "one\ntwo"), ("a +b/c", "7b", "one\ntwo"), ("r%20", "7b", "é"), (None, "", None), ("x", "7b", "")] * 20
    root = str(tmp_path / "predictions")
    frame = spark.createDataFrame(rows, "run string, model_size string, content string").repartition(4)
    text.write_predictions(frame, root)
    names = [n for _, _, found in os.walk(root) for n in found]
    assert len(names) == len(rows) and all(n.startswith("part-") and n.endswith(".txt") for n in names)  # no checksum files, no drafts
    got = text.read_predictions(spark, "file:" + root, "part-*.txt").selectExpr("url_decode(url_decode(substring_index(run, '=', -1))) AS run", "content").collect()
    assert sorted((r.run, r.content) for r in got) == sorted((r[0] or text.NO_KEY, (r[2] or "") + "\n") for r in rows)
