"""Tables that grow with the data are not sent through the driver, however small the planner takes them to be."""

from pyspark.sql import functions as F

from wafermill.operators.coverage import nearest_neighbour
from wafermill.operators.design import latin_hypercube
from wafermill.plans import attach as attach_plan


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def small(spark, tmp_path, rows, schema):
    """Rows of a file, whose size the planner knows and finds small."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_ranks_of_repeated_rows(spark, tmp_path):
    plans = small(spark, tmp_path, [(f"p{i}", "x", 5) for i in range(4)] + [(None, "x", 3)], "pcell string, axis string, n int")
    got = latin_hypercube(plans, ["pcell"], "axis", "n", "7")
    assert "Broadcast" not in plan(got)
    rows = got.collect()
    for key, n in [*((f"p{i}", 5) for i in range(4)), (None, 3)]:
        assert sorted(int(r.u * n) for r in rows if r.pcell == key) == list(range(n))


def test_nearest_of_many_small_families(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(attach_plan, "BROADCAST_ROWS", 0)
    points = small(spark, tmp_path, [("a", 1, 0.0, 0.0), ("a", 2, 3.0, 4.0), (None, 3, 1.0, 1.0), (None, 4, 1.0, 1.0), ("b", 5, 2.0, 2.0)], "pcell string, id bigint, x double, y double")
    got = nearest_neighbour(points, ["pcell"], "id", ["x", "y"])
    assert "Broadcast" not in plan(got)
    assert {r.id: r.nn_distance for r in got.collect()} == {1: 5.0, 2: 5.0, 3: 0.0, 4: 0.0, 5: None}


def test_attached_table_over_the_limit(spark, tmp_path, monkeypatch):
    left = small(spark, tmp_path, [("a", 1), ("b", 2), (None, 3)], "k string, id bigint")
    statistics = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert "Broadcast" in plan(attach_plan.attach(left, statistics, ["k"]))
    monkeypatch.setattr(attach_plan, "BROADCAST_ROWS", 1)
    for on in (["k"], F.col("k").eqNullSafe(F.col("_k"))):
        other = statistics if isinstance(on, list) else statistics.withColumnRenamed("k", "_k")
        got = attach_plan.attach(left, other, on)
        assert "Broadcast" not in plan(got) and sorted((r.id, r.n) for r in got.collect()) == [(1, 1), (2, 1), (3, 1)]
