"""Hand-written cases, one per quirk of the text formats."""

import pytest
from pyspark.sql import functions as F

from wafermill.operators import codemetrics, netlist, ports, reports, training
from wafermill.sources import records, text


def lines(spark, *parts, key="component", name="c"):
    return spark.createDataFrame([(name, i + 1, p) for i, p in enumerate(parts)], f"{key} string, line_no bigint, line string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_violation_before_any_rule_has_empty_rule(spark):
    got = reports.drc_violations(lines(spark, "1 2 3", "met1.2 : space", "-" * 40, "\t4 5", "x"), chunk=2).orderBy("line_no").collect()
    assert [(r.rule, r.details) for r in got] == [("", "1 2 3"), ("met1.2 : space", "4 5")]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_rule_is_carried_over_chunks_without_rules(spark, chunk):
    got = reports.drc_violations(lines(spark, "a", *[str(i) for i in range(9)], "b", "9"), chunk=chunk).collect()
    assert sorted((r.rule, r.details) for r in got) == sorted([("a", str(i)) for i in range(9)] + [("b", "9")])


def test_zero_count_at_the_end_passes_with_errors(spark):
    row = one(reports.drc_summary(lines(spark, "rule", "1 1", "Total Count:  0", "  ")))
    assert row.total_errors == 1 and row.is_pass
    assert not one(reports.drc_summary(lines(spark, "rule", "count: 0", "1 1"))).is_pass


def test_missing_report_passes_with_zero(spark):
    empty = lines(spark, "x").where("false")
    row = one(reports.drc_summary(empty, spark.createDataFrame([("c",)], "component string")))
    assert row.total_errors == 0 and row.is_pass


def test_comparison_patterns(spark):
    got = reports.lvs_mismatches(lines(
        spark, "Net: a | (no matching net)", "Instance: i | (no matching instance)",
        "Net: x | b (no matching net)", " | j (no matching instance)", "plain",
    )).orderBy("line_no").collect()
    assert [(r.type, r.name, r.present_in) for r in got] == [
        ("net", "a", "layout"), ("instance", "i", "layout"), ("net", "b", "schematic"), ("instance", "j", "schematic"),
    ]


def test_pass_text_with_a_mismatch_fails(spark):
    row = one(reports.lvs_summary(lines(spark, "Netlists match", "Net: a | (no matching net)", "Number of nets: 3: x", "Number of nets: 4")))
    assert (row.is_pass, row.conclusion, row.nets, row.devices) == (False, "LVS Fail: Mismatches found.", "4", "Not found")


def test_strict_variant_fails_on_the_word_alone(spark):
    source = lines(spark, "Circuits match uniquely", "a MisMatch here")
    assert one(reports.lvs_summary(source)).is_pass
    strict = one(reports.lvs_summary_strict(source))
    assert not strict.is_pass and strict.conclusion == "LVS Fail: Netlist mismatch."


def test_extraction_values(spark):
    got = one(reports.pex_totals(lines(
        spark, "C1 a b 1.5f", "C2 a b 2P", "C3 a b 3p", "C4 a b 12d", "C5 a b", "R1 a b 5", "r2 a b 1e1", "R3 a b 4k", "R4 a b 12f", "c6 a b 1U",
    )))
    assert got.total_resistance_ohms == 15.0
    assert got.total_capacitance_farads == pytest.approx(1.5e-15 + 2e-12 + 1e-6, rel=1e-12)


FENCED = ["```json", '{"a": 1}', "```", "```json", '{"a": ', "```", '{"a": 2}', "{bad", "text", "```json", '{"a": 3,', '"b": 4}']


def test_fenced_blocks(spark):
    found = text.fenced_json_texts(lines(spark, *FENCED, key="path"), chunk=3)
    good = text.parsed_json(found, "a int, b int").collect()
    assert sorted((r.kind, r["item"].a) for r in good) == [("block", 1), ("inline", 2), ("unterminated", 3)]
    assert [r["item"].b for r in good if r.kind == "unterminated"] == [4]
    bad = training.quarantine_bad_json(found).collect()
    assert sorted(r.kind for r in bad) == ["block", "inline"]


def test_second_opening_fence_drops_the_open_block(spark):
    found = text.fenced_json_texts(lines(spark, "```json", '{"a": 1}', "```json", '{"a": 2}', "```", key="path")).collect()
    assert [(r.kind, r.text) for r in found] == [("block", '{"a": 2}')]


def test_score_blocks(spark):
    source = lines(
        spark, "k: 0", "RANK 1: amp (ID: 7)", "Raw Data:", "x: 1", "x: 2", "RANK 2: ota (ID: 8)", "x: a:b", "-----", "x: 9",
        "RANK 3: last (ID: 9)", "x:", key="path",
    )
    got = text.score_blocks(source, ["x"], chunk=2).orderBy("rank").collect()
    assert [(r.rank, r.component_name_header, r.id, r.x) for r in got] == [(1, "amp", 7, "2"), (2, "ota", 8, "a:b"), (3, "last", 9, None)]


def test_continuations_and_bare_end(spark):
    source = lines(spark, "* c", ".subckt a b", "+ c d", "", "+ e", "X1 b c \\", ".ends", key="path")
    got = [r.line for r in text.netlist_lines(source).orderBy("line_no").collect()]
    assert got[1] == ".subckt a b c d e"
    assert one(netlist.top_design_name(lines(spark, ".ends a", " .ends", key="path"))).top is None
    assert one(netlist.netlist_name(lines(spark, "x", key="path"))).circuit_name == "Netlist"


def port(spark, name, angle):
    return spark.createDataFrame([(1, 1, name, angle)], "component int, port_id int, name string, orientation double")


@pytest.mark.parametrize("name,angle,want", [("e1", 90.0, "N"), ("a_e3", 316.0, "a_E"), ("a_b_e3", None, "a_b_E"), ("a_x", 226.0, "a_S"), ("a_x", -90.0, "a_S"), ("a_", 180.0, "a_W")])
def test_rename_by_orientation(spark, name, angle, want):
    assert one(ports.rename_by_orientation(port(spark, name, angle))).name == want


def test_port_without_underscore_is_an_error(spark):
    with pytest.raises(Exception, match="underscore"):
        ports.rename_by_orientation(port(spark, "plain", 0.0)).collect()


def test_direction_uses_the_first_letter(spark):
    df = spark.createDataFrame([("west", -90.0), ("sw", 540.0)], "w string, a double")
    got = ports.normalise_direction(df, "w", "a").collect()
    assert [(r.direction, r.word_angle, r.signed_angle, r.letter) for r in got] == [(1, 180, -90, "S"), (4, 270, 180, "W")]


def test_wrong_vector_length_is_an_error(spark):
    from wafermill.operators import design

    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="length 18"):
        design.vector_to_params(df, "v").collect()


def test_measurements_sentinel(spark):
    df = spark.createDataFrame([(1, "0 5 1 6")], "k int, text string")
    got = one(text.measurements(df, df, df, df, "k", sentinel=True))
    assert (got.ugb, got.power, got.rise_slew, got.fall_slew) == (text.MISSING, 5.0, 5.0, 6.0)


def test_strict_rule_lookup_raises(spark):
    from wafermill.operators import rules

    pairs = spark.createDataFrame([("t", "a", None)], "pdk string, glayer1 string, glayer2 string")
    table = spark.createDataFrame([("t", "a", "b", "min_width", 1.0)], "pdk string, glayer1 string, glayer2 string, rule string, value double")
    assert one(rules.rule_lookup(pairs, table)).rules is None
    with pytest.raises(Exception, match="no rules found"):
        rules.rule_lookup(pairs, table, strict=True).collect()


def test_xml_with_another_root_is_an_error(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<other><item><category>c</category></item></other>\n")
    with pytest.raises(Exception, match="not a report database"):
        records.read_violation_xml(spark, str(tmp_path)).collect()


def test_json_suffix_is_checked(spark):
    with pytest.raises(ValueError):
        text.load_json_or_jsonl(spark, "/x/data.csv", "a int")


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"l{i}" for i in range(2000)))
    (tmp_path / "b.txt").write_text("x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = text.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.line_no, r.line) for r in got if r.path.endswith("a.txt"))
    assert a == [(i + 1, f"l{i}") for i in range(2000)]
    assert sorted((r.line_no, r.line) for r in got if r.path.endswith("b.txt")) == [(1, "x"), (2, "y")]


def test_prediction_files(spark, tmp_path):
    folder = tmp_path / "run-1" / "7b"
    folder.mkdir(parents=True)
    (folder / "prediction_1.txt").write_text("code\n\nmore")
    (folder / "other.txt").write_text("no")
    got = one(text.read_predictions(spark, str(tmp_path)))
    assert (got.run, got.model_size, got.file, got.content) == ("run-1", "7b", "prediction_1.txt", "code\n\nmore")


def test_code_line_ends_and_words(spark):
    code = "if a:\r\n\x0c \x0b\u2028x = 'if'\n\u00a0\n" + "d\u00e9f def_ def\n"
    df = spark.createDataFrame([(code,)], "code string")
    got = one(df.select(codemetrics.code_lines(F.col("code")).alias("n"), *codemetrics.complexity(F.col("code"))))
    import re

    assert got.n == len([x for x in code.splitlines() if x.strip()])
    assert got.control_structures == len(re.findall(r"\b(if|for|while|try|with)\b", code))
    assert got.functions == len(re.findall(r"\bdef\b", code))


def test_code_is_compiled_but_not_run(spark, tmp_path):
    marker = tmp_path / "ran"
    df = spark.createDataFrame([(1, f"open({str(marker)!r}, 'w')"), (2, "x ="), (3, "a\x00b")], "k bigint, code string")
    got = {r.k: (r.compiles, r.message) for r in codemetrics.compile_check(df, "k", "code").collect()}
    assert got[1] == (True, "") and not got[2][0] and not got[3][0] and "SyntaxError" in got[2][1]
    assert not marker.exists()


def test_fence_modes(spark):
    df = spark.createDataFrame([("```python\nx\n```", "a.txt"), ("```python\\ny```", "a.txt"), (" z ", "a.py")], "c string, f string")
    got = df.select(
        codemetrics.extract_code(F.col("c"), F.col("f")).alias("compat"), codemetrics.extract_code(F.col("c"), F.col("f"), "fixed").alias("fixed")
    ).collect()
    assert [r.compat for r in got] == ["```python\nx\n```", "y", "z"]
    assert got[0].fixed == "x"


def test_csv_keeps_nested_columns_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": "b"})], "k int, l array<int>, m map<string,string>")
    records.write_flat_csv(df, str(tmp_path / "o"))
    got = one(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")))
    assert (got.l, got.m) == ("[1,2]", '{"a":"b"}')
