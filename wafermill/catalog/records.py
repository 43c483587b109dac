"""Queries over result rows."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog import reports as _report_views  # noqa: F401  (its views are used here)
from wafermill.catalog.adapters import run_sql, view, with_views
from wafermill.operators import records

REPORT = """
SELECT {keys} count(*) AS total_samples,
       count(*) FILTER (success) AS successful,
       count(*) FILTER (NOT success) AS failed,
       COALESCE(count(*) FILTER (success) * CAST(100 AS DOUBLE) / count(*), 0) AS success_rate,
       count(*) FILTER (success AND drc_pass) AS drc_passes,
       count(*) FILTER (success AND NOT drc_pass) AS drc_failures,
       COALESCE(count(*) FILTER (success AND drc_pass) * CAST(100 AS DOUBLE) / nullif(count(*) FILTER (success), 0), 0) AS drc_rate,
       count(*) FILTER (success AND lvs_pass) AS lvs_passes,
       count(*) FILTER (success AND NOT lvs_pass) AS lvs_failures,
       COALESCE(count(*) FILTER (success AND lvs_pass) * CAST(100 AS DOUBLE) / nullif(count(*) FILTER (success), 0), 0) AS lvs_rate,
       round(CAST(sum(CAST(execution_time AS DECIMAL(20,6))) FILTER (success) AS DOUBLE) / count(*) FILTER (success), 4) AS avg_time,
       COALESCE(min(execution_time) FILTER (success), 0) AS min_time,
       COALESCE(max(execution_time) FILTER (success), 0) AS max_time
FROM results {group}
"""


def rounded(df, digits):
    """Means rounded for the comparison; the operators keep them whole."""
    return df.select(*[F.round(c, digits).alias(c) if c.startswith("avg_") else c for c in df.columns])


@query("dataset_report", with_views("results") + REPORT.format(keys="", group=""))
def _(spark, sf):
    return rounded(records.dataset_report(view(spark, sf, "results")), 4)


@query("dataset_report_by_family", with_views("results") + REPORT.format(keys="pcell,", group="GROUP BY pcell"))
def _(spark, sf):
    return rounded(records.dataset_report(view(spark, sf, "results"), ["pcell"]), 4)


@query(
    "quality_grade",
    with_views("results") + "SELECT pcell, "
    "CASE WHEN success_rate = 100 THEN 'EXCELLENT' WHEN success_rate >= 95 THEN 'VERY GOOD' WHEN success_rate >= 90 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END AS completion_grade, "
    + ", ".join(
        f"CASE WHEN {k}_rate = 100 THEN 'PERFECT' WHEN {k}_rate >= 95 THEN 'EXCELLENT' WHEN {k}_rate >= 90 THEN 'VERY GOOD' ELSE 'NEEDS REVIEW' END AS {k}_grade"
        for k in ("drc", "lvs")
    )
    + ", success_rate = 100 AND drc_rate >= 95 AND lvs_rate >= 95 AS production_ready FROM ("
    + REPORT.format(keys="pcell,", group="GROUP BY pcell") + ") r",
)
def _(spark, sf):
    return records.quality_grade(records.dataset_report(view(spark, sf, "results"), ["pcell"]), "pcell")


@query(
    "failure_listing",
    with_views("results") + """
SELECT sample_id, 'failed' AS kind, COALESCE(error, 'Unknown error') AS detail FROM results WHERE NOT success
UNION ALL SELECT sample_id, 'drc', component_name FROM results WHERE success AND NOT drc_pass
UNION ALL SELECT sample_id, 'lvs', component_name FROM results WHERE success AND NOT lvs_pass""",
)
def _(spark, sf):
    return records.failure_listing(view(spark, sf, "results"))


@query(
    "run_summary",
    with_views("results") + """
SELECT pcell, count(*) AS total, count(*) FILTER (success) AS successful,
       count(*) FILTER (success AND drc_pass) AS drc_passes, count(*) FILTER (success AND lvs_pass) AS lvs_passes,
       count(*) FILTER (success AND area_um2 > 250) AS pex_passes,
       round(CAST(sum(CAST(COALESCE(execution_time, 0) AS DECIMAL(24,10))) FILTER (success) AS DOUBLE) / count(*) FILTER (success), 6) AS avg_time,
       round(CAST(sum(CAST(COALESCE(area_um2, 0) AS DECIMAL(24,10))) FILTER (success) AS DOUBLE) / count(*) FILTER (success), 6) AS avg_area,
       round(CAST(sum(CAST(COALESCE(symmetry_horizontal, 0) AS DECIMAL(24,10))) FILTER (success) AS DOUBLE) / count(*) FILTER (success), 6) AS avg_symmetry_horizontal,
       round(CAST(sum(CAST(COALESCE(symmetry_vertical, 0) AS DECIMAL(24,10))) FILTER (success) AS DOUBLE) / count(*) FILTER (success), 6) AS avg_symmetry_vertical,
       count(*) FILTER (success) * CAST(100 AS DOUBLE) / count(*) AS success_rate,
       count(*) FILTER (success) * CAST(100 AS DOUBLE) / count(*) >= 50 AS gate_passed
FROM results GROUP BY pcell""",
)
def _(spark, sf):
    rows = view(spark, sf, "results").withColumn(
        "pex_status", F.when(F.col("area_um2") > 250, "PEX Complete").otherwise("PEX Error")
    )
    return rounded(records.run_summary(rows, ["pcell"]), 6)


@query(
    "error_histogram",
    with_views("results") + """
SELECT substring(split_part(COALESCE(error, 'Unknown error'), chr(10), 1), 1, 50) AS error_key, count(*) AS n
FROM results WHERE NOT success GROUP BY 1""",
)
def _(spark, sf):
    return records.error_histogram(view(spark, sf, "results"))


def _evaluations(spark, sf):
    rows = view(spark, sf, "results")
    checks = rows.select("component_name", "sample_id", "drc_pass", "lvs_pass")
    parasitics = rows.where("success").select(
        "component_name", F.lit("PEX Complete").alias("pex_status"), "total_resistance_ohms", "total_capacitance_farads"
    )
    geometry = rows.where("area_um2 > 50").select(
        "component_name", "area_um2", "symmetry_horizontal", "symmetry_vertical"
    )
    return records.assemble_evaluation(checks, parasitics, geometry)


FLAT = """
SELECT component_name, drc_pass AND lvs_pass AS success, drc_pass, lvs_pass,
       CASE WHEN success THEN 'PEX Complete' ELSE 'not run' END AS pex_status,
       CASE WHEN success THEN total_resistance_ohms ELSE 0 END AS total_resistance_ohms,
       CASE WHEN success THEN total_capacitance_farads ELSE 0 END AS total_capacitance_farads,
       CASE WHEN area_um2 > 50 THEN area_um2 ELSE 0 END AS area_um2,
       CASE WHEN area_um2 > 50 THEN symmetry_horizontal ELSE 0 END AS symmetry_horizontal,
       CASE WHEN area_um2 > 50 THEN symmetry_vertical ELSE 0 END AS symmetry_vertical
FROM results"""


@query(
    "assemble_evaluation",
    with_views("results") + "SELECT component_name, NOT success AS drc_lvs_fail, pex_status, area_um2, "
    "total_resistance_ohms FROM (" + FLAT + ") f",
)
def _(spark, sf):
    return _evaluations(spark, sf).select(
        "component_name", "drc_lvs_fail", F.col("pex.status").alias("pex_status"),
        F.col("geometric.raw_area_um2").alias("area_um2"), "pex.total_resistance_ohms",
    )


RUNS = """
SELECT o_orderkey AS component, concat('c_', o_orderkey) AS component_name, o_orderdate AS timestamp,
       concat('drc/', o_orderkey, '.rpt') AS drc_report_path, CASE WHEN o_orderkey % 13 = 0 THEN 'no tool' END AS drc_error,
       CASE WHEN o_orderkey % 7 > 0 THEN concat('lvs/', o_orderkey, '.rpt') END AS lvs_report_path, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS lvs_error
FROM {orders}
"""
MEASURES = "SELECT sample_id AS component, CASE WHEN success THEN 'PEX Complete' END AS pex_status, total_resistance_ohms, total_capacitance_farads, area_um2, symmetry_horizontal, symmetry_vertical FROM results WHERE sample_id % 3 > 0"
DRC_ROWS = "SELECT component, line_no, line FROM report_lines WHERE component % 11 > 0"
LVS_ROWS = "SELECT component, line_no, line FROM lvs_lines WHERE component % 5 > 0"
DOCUMENTS = with_views("results", "report_lines", "lvs_lines", runs=RUNS) + f"""
, measures AS ({MEASURES}), dl AS ({DRC_ROWS}), ll AS ({LVS_ROWS})""" + r"""
, dt AS (SELECT component, line_no, trim(line) AS line FROM dl WHERE trim(line) <> '----------------------------------------'),
dm AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[a-zA-Z]') THEN line END IGNORE NULLS) OVER (PARTITION BY component ORDER BY line_no) AS rule FROM dt),
de AS (SELECT component, count(*) FILTER (regexp_matches(line, '^[0-9]')) AS n, string_agg(concat(COALESCE(rule, ''), ' > ', line), ';' ORDER BY line_no) FILTER (regexp_matches(line, '^[0-9]')) AS e FROM dm GROUP BY component),
lm AS (SELECT component, line_no, line, CASE WHEN regexp_matches(line, 'Net:\s*([^|]+)\s*\|\s*\(no matching net\)') THEN 1 WHEN regexp_matches(line, 'Instance:\s*([^|]+)\s*\|\s*\(no matching instance\)') THEN 2
   WHEN regexp_matches(line, '\|\s*([^|]+)\s*\(no matching net\)') THEN 3 WHEN regexp_matches(line, '\|\s*([^|]+)\s*\(no matching instance\)') THEN 4 END AS k FROM ll),
ln AS (SELECT *, trim(CASE k WHEN 1 THEN regexp_extract(line, 'Net:\s*([^|]+)\|', 1) WHEN 2 THEN regexp_extract(line, 'Instance:\s*([^|]+)\|', 1) ELSE regexp_extract(line, '\|\s*([^|]+)\(', 1) END) AS name FROM lm),
le AS (SELECT component, bool_or(contains(line, 'Netlists match') OR contains(line, 'Circuits match uniquely')) AS p, count(k) AS n,
   string_agg(concat(name, CASE WHEN k <= 2 THEN ' not in schematic' ELSE ' not in layout' END), ';' ORDER BY line_no) FILTER (k IN (1, 3)) AS nets,
   string_agg(concat(name, CASE WHEN k <= 2 THEN ' not in schematic' ELSE ' not in layout' END), ';' ORDER BY line_no) FILTER (k IN (2, 4)) AS instances FROM ln GROUP BY component),
j AS (SELECT r.*, de.component IS NOT NULL AS drc_ran, COALESCE(de.n = 0 AND drc_error IS NULL, false) AS drc_ok, de.n AS drc_n, de.e AS drc_e, le.component IS NOT NULL AS lvs_ran,
   COALESCE(p AND le.n = 0 AND lvs_error IS NULL, false) AS lvs_ok, le.n AS lvs_n, le.nets, le.instances FROM runs r LEFT JOIN de ON de.component = r.component LEFT JOIN le ON le.component = r.component)
SELECT component_name, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, NOT (drc_ok AND lvs_ok) AS drc_lvs_fail,
   CASE WHEN drc_error IS NOT NULL THEN concat('error: ', drc_error) WHEN NOT drc_ran THEN 'not run' WHEN drc_ok THEN 'pass' ELSE 'fail' END AS drc_status, drc_report_path,
   CASE WHEN drc_error IS NULL THEN drc_n END AS drc_errors, CASE WHEN drc_error IS NULL AND drc_ran THEN COALESCE(drc_e, '') END AS drc_details,
   CASE WHEN lvs_error IS NOT NULL THEN concat('error: ', lvs_error) WHEN NOT lvs_ran THEN 'not run' WHEN lvs_ok THEN 'pass' ELSE 'fail' END AS lvs_status, lvs_report_path,
   CASE WHEN lvs_error IS NULL AND lvs_ran THEN COALESCE(j.nets, '') END AS lvs_nets, CASE WHEN lvs_error IS NULL AND lvs_ran THEN COALESCE(j.instances, '') END AS lvs_instances,
   COALESCE(pex_status, 'not run') AS pex_status, COALESCE(area_um2, 0) AS raw_area_um2
FROM j LEFT JOIN measures m ON m.component = j.component"""


@query("evaluation_documents", DOCUMENTS)
def _(spark, sf):
    measures = spark.sql(MEASURES.replace("FROM results", "FROM {results}"), results=view(spark, sf, "results"))
    drc = view(spark, sf, "report_lines").where("component % 11 > 0")
    lvs = view(spark, sf, "lvs_lines").where("component % 5 > 0")
    parasitics = measures.select("component", "pex_status", "total_resistance_ohms", "total_capacitance_farads")
    geometry = measures.select("component", "area_um2", "symmetry_horizontal", "symmetry_vertical")
    got = records.evaluation_documents(run_sql(spark, sf, RUNS), drc, lvs, parasitics, geometry)
    lost = lambda x: F.concat(x["name"], F.lit(" not in "), x["missing_in"])
    parsed = lambda kind: F.array_join(F.transform(f"lvs.summary.mismatch_details.unmatched_{kind}_parsed", lost), ";").alias(f"lvs_{kind}")
    return got.select(
        "component_name", "timestamp", "drc_lvs_fail", F.col("drc.status").alias("drc_status"), F.col("drc.report_path").alias("drc_report_path"),
        F.col("drc.summary.total_errors").alias("drc_errors"),
        F.array_join(F.transform("drc.summary.error_details", lambda x: F.concat(x["rule"], F.lit(" > "), x["details"])), ";").alias("drc_details"),
        F.col("lvs.status").alias("lvs_status"), F.col("lvs.report_path").alias("lvs_report_path"), parsed("nets"), parsed("instances"),
        F.col("pex.status").alias("pex_status"), "geometric.raw_area_um2",
    )


@query("result_rows", with_views("results") + FLAT)
def _(spark, sf):
    return records.result_rows(_evaluations(spark, sf), "component_name")


@query(
    "union_failures",
    with_views("results") + """
SELECT sample_id, component_name, success, execution_time, area_um2, CAST(NULL AS VARCHAR) AS error FROM results WHERE success
UNION ALL SELECT sample_id, component_name, success, execution_time, NULL, error FROM results WHERE NOT success""",
)
def _(spark, sf):
    rows = view(spark, sf, "results")
    good = rows.where("success").select("sample_id", "component_name", "success", "execution_time", "area_um2")
    bad = rows.where("NOT success").select("sample_id", "component_name", "success", "execution_time", "error")
    return records.union_failures(good, bad)


def _maps(spark, sf):
    return run_sql(spark, sf, "SELECT event_id AS index, event_type AS pcell, value, props FROM {events}").select(
        "index", "pcell",
        F.create_map(F.concat(F.lit("w"), F.col("index") % 3), F.col("value")).alias("params"),
        F.from_json("props", "map<string,bigint>").alias("report"),
    )


@query(
    "flatten_to_variant",
    """
SELECT event_id AS "index", event_type AS pcell, CASE WHEN event_id % 3 = 0 THEN value END AS param_w0,
       CASE WHEN event_id % 3 = 2 THEN value END AS param_w2, CAST(json_extract(props, '$.k') AS BIGINT) AS report_k
FROM events""",
)
def _(spark, sf):
    flat = records.flatten_to_variant(_maps(spark, sf), {"params": "param_", "report": "report_"}, "index", "pcell")
    read = lambda key, kind: F.try_variant_get("flat", f"$.{key}", kind).alias(key)
    return flat.select("index", "pcell", read("param_w0", "double"), read("param_w2", "double"), read("report_k", "bigint"))


@query(
    "flatten_records",
    """
SELECT event_id AS "index", event_type AS pcell,
       CASE WHEN event_id % 3 = 0 THEN value END AS param_w0,
       CASE WHEN event_id % 3 = 1 THEN value END AS param_w1,
       CASE WHEN event_id % 3 = 2 THEN value END AS param_w2,
       CAST(json_extract(props, '$.k') AS BIGINT) AS report_k
FROM events""",
)
def _(spark, sf):
    return records.flatten_records(_maps(spark, sf), {"params": "param_", "report": "report_"}, "index", "pcell")
