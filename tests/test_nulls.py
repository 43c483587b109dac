"""Null keys, missing parts and repeated entries: no row is lost, no job ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafermill.functions.student_t import t_tail
from wafermill.operators import reports
from wafermill.operators.codemetrics import compile_check
from wafermill.operators.netlist import device_totals, expand_hierarchy, netlist_instances
from wafermill.operators.rules import rule_lookup
from wafermill.operators.scores import histogram, parasitic_score
from wafermill.plans.components import connected_components
from wafermill.plans.quantiles import exact_percentiles
from wafermill.plans.ranks import hash_rank, range_rank, running_sums
from wafermill.plans.scan import carry_forward
from wafermill.session import shared_dir
from wafermill.sources.records import write_training_matrix
from wafermill.streaming.progress import progress_rows

ROWS = [("a", 1, 1.0), ("a", 2, 2.0), (None, 3, 3.0), (None, 4, 5.0)]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, k bigint, x double")


def test_histogram(rows):
    got = histogram(rows, ["g"], "x", 2).groupBy("g").agg(F.sum("n")).collect()
    assert {tuple(r) for r in got} == {("a", 2), (None, 2)}


def test_percentiles_and_scores(rows):
    assert {tuple(r) for r in exact_percentiles(rows, ["g"], "x", {"m": 0.5}).collect()} == {("a", 1.5), (None, 4.0)}
    scored = parasitic_score(rows, ["g"], {"x": "s"}).collect()
    assert len(scored) == 4 and all(r["s"] is not None for r in scored)


def test_ranks(rows):
    for ranked in (hash_rank(rows, ["g"], "t", ["k"], "r") if "t" in rows.columns else hash_rank(rows.withColumn("t", F.md5(F.col("k").cast("string"))), ["g"], "t", ["k"], "r"), range_rank(rows, ["g"], [F.col("k").asc()], "r")):
        assert sorted((str(r["g"]), r["r"]) for r in ranked.collect()) == [("None", 1), ("None", 2), ("a", 1), ("a", 2)]
    sums = running_sums(rows, ["g"], [F.col("k").asc()], {"s": F.col("x")})
    assert sorted((str(r["g"]), r["s"]) for r in sums.collect()) == [("None", 3.0), ("None", 8.0), ("a", 1.0), ("a", 3.0)]


def test_sparse_lines_are_one_window(spark):
    schema = "component bigint, line_no bigint, line string"
    place = [None, None, 5, 10**12, 2 * 10**12, 3 * 10**12, 4 * 10**12]
    told = ["m1 : width", "1 2", "3 4", "m2 : space", " 5 6", "", "7 8"]
    lines = spark.createDataFrame([(c, n, text) for c in (1, None) for n, text in zip(place, told)], schema)
    got = {(r.component, r.line_no, r.rule, r.details) for r in reports.drc_violations(lines).collect() if r.line_no}
    want = [(5, "", "3 4"), (2 * 10**12, "m2 : space", "5 6"), (4 * 10**12, "m2 : space", "7 8")]
    assert got == {(c, *w) for c in (1, None) for w in want}
    assert got == {(r.component, r.line_no, r.rule, r.details) for r in reports.drc_violations(lines, 1).collect() if r.line_no}
    plan = reports.drc_violations(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Join" in reports.drc_violations(lines, 1)._jdf.queryExecution().optimizedPlan().toString()


def test_carry_forward(rows):
    got = carry_forward(rows, ["g"], "k", {"m": F.when(F.col("k") % 2 == 1, F.col("x"))}, 2)
    assert sorted((str(r["g"]), r["k"], r["m"]) for r in got.collect()) == [("None", 3, 3.0), ("None", 4, 3.0), ("a", 1, 1.0), ("a", 2, 1.0)]


def test_components_with_null_group(spark):
    edges = spark.createDataFrame([("a", 1, 2), (None, 1, 2), (None, 2, 3)], "g string, u bigint, v bigint")
    got = {tuple(r) for r in connected_components(edges, ["g"]).select("g", "node", "label").collect()}
    assert got == {("a", 1, 1), ("a", 2, 1), (None, 1, 1), (None, 2, 1), (None, 3, 1)}


def test_hot_node_joins_from_plain_exchanges(spark):
    edges = spark.range(20_000).select(F.lit(0).cast("long").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges, [])
    assert got.where("label <> 0").isEmpty() and got.count() == 20_001


def test_progress(spark):
    rows = spark.createDataFrame([(None, 1, None, 1.0), (None, 2, True, 1.0)], "g string, k bigint, success boolean, execution_time double")
    assert sorted((r["completed"], r["success_rate"]) for r in progress_rows(rows, ["g"], "k", 5).collect()) == [(1, 0.0), (2, 50.0)]


def test_training_matrix_keeps_all_samples(spark, tmp_path):
    params = spark.createDataFrame([(1, 0.5), (2, 0.7)], "k bigint, p double")
    write_training_matrix(params, spark.createDataFrame([(1, 9.0)], "k bigint, r double"), "k", str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "params")).count() == 2
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "m" / "results")).collect()} == {(1, 9.0), (2, None)}


def test_null_code(spark):
    got = compile_check(spark.createDataFrame([(1, None), (2, "x = 1")], "k bigint, c string"), "k", "c")
    assert {(r["k"], r["compiles"]) for r in got.collect()} == {(1, False), (2, True)}


def test_repeated_parameters_and_rules(spark):
    lines = spark.createDataFrame([("f", 1, ".subckt a x y"), ("f", 2, "M1 x y nfet w=1 w=2 e=a=b=c"), ("f", 3, ".ends")], "path string, line_no bigint, line string")
    assert netlist_instances(lines).first()["params"] == {"w": "2", "e": "a=b=c"}
    rules = spark.createDataFrame([("p", "a", "b", "min", 1.0), ("p", "a", "b", "min", 2.0)], "pdk string, glayer1 string, glayer2 string, rule string, value double")
    pairs = spark.createDataFrame([("p", "b", "a")], "pdk string, glayer1 string, glayer2 string")
    assert rule_lookup(pairs, rules).first()["rules"] == {"min": 2.0}


def test_hierarchies_of_any_depth_and_loops(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 1) for i in range(20)], "parent string, child string, n bigint")
    assert device_totals(chain).count() == 210 and expand_hierarchy(chain, "c0").count() == 20
    loop = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "parent string, child string, n bigint")
    for run in (lambda: device_totals(loop), lambda: expand_hierarchy(loop, "a")):
        with pytest.raises(RuntimeError, match="loop"):
            run()


def test_t_tail_with_many_degrees():
    assert np.allclose(t_tail(np.array([1.0, 1.0, 2.0, 12.706]), np.array([1e12, 1e15, 1e9, 1.0])), [0.3173105, 0.3173105, 0.0455003, 0.05], atol=2e-6)


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_json_texts_are_whole(spark):
    from wafermill.functions.columns import is_whole_json

    texts = {'{"a": 1}': True, '[1, 2]': True, '{"a": 1}\n{"b": 2}': False, '{"a": 1} x': False, '{"a": 1': False, "1],[2": False, "1,2": False, '1,"z":0} x': False, "": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.coalesce(is_whole_json(F.col("t")), F.lit(False)).alias("ok"))
    assert {r["t"]: r["ok"] for r in got.collect()} == texts
