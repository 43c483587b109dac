"""Netlist files hold their lines in order; records with very many keys become one value."""

from pathlib import Path

from pyspark.sql import functions as F

from wafermill.operators.netlist import render_subcircuits, write_netlists
from wafermill.operators.records import flatten_to_variant


def test_netlist_files_in_order(spark, tmp_path):
    heads = spark.createDataFrame([(n, d, f"cell{d}", ["A", "B"]) for n in (None, 1, 2) for d in range(40)], "netlist bigint, def_no bigint, name string, pins array<string>")
    body = spark.createDataFrame(
        [(n, d, k, str(k), ["A", f"n{k}"], "m") for n in (None, 1, 2) for d in range(40) for k in range(30)],
        "netlist bigint, def_no bigint, line_no bigint, inst string, nets array<string>, model string",
    )
    nodes = spark.createDataFrame([(1, "vdd"), (1, "gnd"), (2, "vdd")], "netlist bigint, node string")
    write_netlists(render_subcircuits(nodes, heads, body).repartition(7), str(tmp_path / "out"))
    for name, first in (("1", ".global gnd vdd"), ("2", ".global vdd"), ("__HIVE_DEFAULT_PARTITION__", None)):
        files = sorted((tmp_path / "out" / f"netlist={name}").glob("*.txt"))
        lines = [line for f in files for line in Path(f).read_text().splitlines()]
        want = [first] if first else []
        for d in range(40):
            want += [f".subckt cell{d} A B", *[f"X{k} A n{k} m" for k in range(30)], f".ends cell{d}"]
        assert lines == want


def test_records_with_very_many_keys(spark):
    rows = spark.range(30).select("id", F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.struct(F.concat(F.lit("k"), F.col("id") * 400 + k), k * 2))).alias("m"))
    rows = rows.withColumn("other", F.when(F.col("id") != 3, F.create_map(F.lit("name"), F.concat(F.lit("r"), "id"))))
    flat = flatten_to_variant(rows, {"m": "p_", "other": "o_"}, "id")
    read = flat.select("id", F.try_variant_get("flat", "$.p_k400", "int").alias("a"), F.try_variant_get("flat", "$.p_k1203", "int").alias("b"), F.try_variant_get("flat", "$.o_name", "string").alias("c"))
    got = {r.id: (r.a, r.b, r.c) for r in read.collect()}
    assert got[1] == (0, None, "r1") and got[3] == (None, 6, None) and got[29] == (None, None, "r29")
