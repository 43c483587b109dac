"""Queries over checker, comparison and extraction reports."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import reports

# In these views the line number has one run of 10^12 per l_linenumber.
CHUNK = 10**11

NUMBER = "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10"

VIEWS["lvs_lines"] = f"""
SELECT l_orderkey AS component, {NUMBER} AS line_no,
       CASE l_partkey % 60
         WHEN 0 THEN concat('Net: n', l_suppkey, ' | (no matching net)')
         WHEN 1 THEN concat('Instance: X', l_suppkey, '   |  (no matching instance)')
         WHEN 2 THEN concat('  | net_b', l_suppkey, ' (no matching net)')
         WHEN 3 THEN concat('Instance: A | M', l_suppkey, ' (no matching instance)')
         WHEN 4 THEN 'Final result: Netlists match.' WHEN 5 THEN 'Circuits match uniquely.'
         WHEN 6 THEN 'Netlist mismatch' WHEN 7 THEN concat('Number of devices: ', l_suppkey)
         WHEN 8 THEN concat('Number of nets: ', l_suppkey, ' | Number of nets: 4') WHEN 9 THEN 'Netlists do not match'
         WHEN 10 THEN 'Failed pin matching' WHEN 11 THEN 'port MISMATCH seen'
         ELSE CASE WHEN l_partkey % 3 = 0 THEN 'Circuits match uniquely.' ELSE 'comparing' END END AS line
FROM {{lineitem}}
"""

VIEWS["pex_lines"] = f"""
SELECT l_suppkey AS component, {NUMBER} AS line_no,
       CASE l_partkey % 12
         WHEN 0 THEN concat('R', l_partkey, ' a b ', l_suppkey, '.5') WHEN 1 THEN concat('r', l_partkey, ' a b ', l_suppkey)
         WHEN 2 THEN concat('C', l_partkey, ' a b ', l_suppkey, '.5f') WHEN 3 THEN concat('C', l_partkey, ' a b ', l_suppkey, 'F')
         WHEN 4 THEN concat('c', l_partkey, '  a  b  ', l_suppkey, 'p') WHEN 5 THEN concat('C', l_partkey, ' a b ', l_suppkey, 'd')
         WHEN 6 THEN concat('R', l_partkey, ' a b ', l_suppkey, 'k') WHEN 7 THEN concat('C', l_partkey, ' a b')
         WHEN 8 THEN concat('C', l_partkey, ' a b 2e-15') WHEN 9 THEN concat('  R', l_partkey, ' a b 1e1 $') ELSE concat('X', l_partkey, ' a b c') END AS line
FROM {{lineitem}}
"""


@query(
    "drc_violations",
    with_views("report_lines") + """
, t AS (SELECT component, line_no, trim(line) AS line FROM report_lines WHERE trim(line) <> '----------------------------------------'),
m AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[a-zA-Z]') THEN line END IGNORE NULLS) OVER (PARTITION BY component ORDER BY line_no) AS rule FROM t)
SELECT component, line_no, COALESCE(rule, '') AS rule, line AS details FROM m WHERE regexp_matches(line, '^[0-9]')""",
)
def _(spark, sf):
    return reports.drc_violations(view(spark, sf, "report_lines"), CHUNK)


DRC_LINES = """
SELECT component, line_no, line FROM report_lines WHERE component % 11 <> 0
UNION ALL SELECT o_orderkey, CAST(99 AS BIGINT) * 1000000000000, CASE WHEN o_custkey % 3 = 0 THEN 'Total COUNT: 0  ' ELSE 'Total count: 7' END
FROM {orders} WHERE o_custkey % 2 = 0 AND o_orderkey % 11 <> 0
"""


@query(
    "drc_summary",
    with_views("report_lines", lines=DRC_LINES) + r"""
, s AS (SELECT component, count(*) FILTER (regexp_matches(trim(line), '^[0-9]')) AS e, arg_max(trim(line), line_no) FILTER (trim(line) <> '') AS l FROM lines GROUP BY component)
SELECT o_orderkey AS component, COALESCE(e, 0) AS total_errors, COALESCE(e, 0) = 0 OR COALESCE(regexp_matches(l, '(?i)count:\s*0\s*$'), false) AS is_pass
FROM orders LEFT JOIN s ON component = o_orderkey""",
)
def _(spark, sf):
    text = "WITH report_lines AS (" + VIEWS["report_lines"] + ") " + DRC_LINES
    parts = run_sql(spark, sf, "SELECT o_orderkey AS component FROM {orders}")
    return reports.drc_summary(run_sql(spark, sf, text), parts)


MISS = r"""
, m AS (SELECT component, line_no, trim(line) AS line,
  CASE WHEN regexp_matches(line, 'Net:\s*([^|]+)\s*\|\s*\(no matching net\)') THEN 1
       WHEN regexp_matches(line, 'Instance:\s*([^|]+)\s*\|\s*\(no matching instance\)') THEN 2
       WHEN regexp_matches(line, '\|\s*([^|]+)\s*\(no matching net\)') THEN 3
       WHEN regexp_matches(line, '\|\s*([^|]+)\s*\(no matching instance\)') THEN 4 END AS k FROM lvs_lines)
"""


@query(
    "lvs_mismatches",
    with_views("lvs_lines") + MISS + r"""
SELECT component, line_no, CASE WHEN k IN (1, 3) THEN 'net' ELSE 'instance' END AS type,
  trim(CASE k WHEN 1 THEN regexp_extract(line, 'Net:\s*([^|]+)\|', 1) WHEN 2 THEN regexp_extract(line, 'Instance:\s*([^|]+)\|', 1)
       ELSE regexp_extract(line, '\|\s*([^|]+)\(', 1) END) AS name,
  CASE WHEN k <= 2 THEN 'layout' ELSE 'schematic' END AS present_in, CASE WHEN k <= 2 THEN 'schematic' ELSE 'layout' END AS missing_in
FROM m WHERE k IS NOT NULL""",
)
def _(spark, sf):
    return reports.lvs_mismatches(view(spark, sf, "lvs_lines"))


SEEN = MISS + """
, s AS (SELECT component, bool_or(contains(line, 'Netlists match') OR contains(line, 'Circuits match uniquely')) AS p, bool_or({fail}) AS f,
        count(k) AS n, arg_max(trim(substring(line, instr(line, ':') + 1)), line_no) FILTER (k IS NULL AND contains(line, 'Number of devices:')) AS d,
        arg_max(trim(substring(line, instr(line, ':') + 1)), line_no) FILTER (k IS NULL AND NOT contains(line, 'Number of devices:') AND contains(line, 'Number of nets:')) AS t
  FROM m GROUP BY component)
"""


@query(
    "lvs_summary",
    with_views("lvs_lines") + SEEN.format(fail="contains(line, 'Netlist mismatch') OR contains(line, 'Netlists do not match')") + """
SELECT component, p AND n = 0 AS is_pass, CASE WHEN p AND n = 0 THEN 'LVS Pass: Netlists match.' WHEN p THEN 'LVS Fail: Mismatches found.'
       WHEN f THEN 'LVS Fail: Netlist mismatch.' ELSE 'LVS failed or report was inconclusive.' END AS conclusion,
       n AS total_mismatches, COALESCE(t, 'Not found') AS nets, COALESCE(d, 'Not found') AS devices FROM s""",
)
def _(spark, sf):
    return reports.lvs_summary(view(spark, sf, "lvs_lines"))


@query(
    "lvs_summary_strict",
    with_views("lvs_lines") + SEEN.format(
        fail="contains(lower(line), 'mismatch') OR contains(lower(line), 'netlists do not match') OR contains(lower(line), 'failed pin matching')"
    ) + """
SELECT component, p AND NOT f AND n = 0 AS is_pass, CASE WHEN f THEN 'LVS Fail: Netlist mismatch.' WHEN p AND n = 0 THEN 'LVS Pass: Netlists match.'
       WHEN p THEN 'LVS Fail: Mismatches found.' ELSE 'LVS failed or report was inconclusive.' END AS conclusion,
       n AS total_mismatches, COALESCE(t, 'Not found') AS nets, COALESCE(d, 'Not found') AS devices FROM s""",
)
def _(spark, sf):
    return reports.lvs_summary_strict(view(spark, sf, "lvs_lines"))


@query(
    "pex_totals",
    with_views("pex_lines") + r"""
, t AS (SELECT component, regexp_split_to_array(trim(line), '\s+') AS p FROM pex_lines),
v AS (SELECT component, upper(p[1][1]) AS k, p[4] AS v, right(p[4], 1) AS u FROM t WHERE len(p) >= 4),
n AS (SELECT component, k, CASE WHEN k = 'R' AND regexp_matches(v, '^[0-9.]+(e[0-9-]+)?$') THEN CAST(v AS DOUBLE)
             WHEN k = 'C' AND u IN ('f', 'F') THEN CAST(v[:-2] AS DOUBLE) * CAST('1e-15' AS DOUBLE)
             WHEN k = 'C' AND u NOT IN ('f', 'F', 'p', 'd') THEN CAST(v AS DOUBLE) END AS x FROM v)
SELECT component, round(COALESCE(sum(x) FILTER (k = 'R'), 0), 6) AS total_resistance_ohms,
       round(COALESCE(sum(x) FILTER (k = 'C'), 0) * CAST('1e15' AS DOUBLE), 3) AS capacitance_ff FROM n GROUP BY component""",
)
def _(spark, sf):
    got = reports.pex_totals(view(spark, sf, "pex_lines"))
    return got.select(
        "component", F.round("total_resistance_ohms", 6).alias("total_resistance_ohms"),
        F.round(F.col("total_capacitance_farads") * 1e15, 3).alias("capacitance_ff"),
    )


@query(
    "check_status",
    with_views("results") + """
SELECT sample_id, CASE WHEN error IS NOT NULL THEN concat('error: ', error) WHEN area_um2 < 40 THEN 'not run' WHEN drc_pass THEN 'pass' ELSE 'fail' END AS drc_status FROM results""",
)
def _(spark, sf):
    status = reports.check_status(F.col("area_um2") >= 40, F.col("drc_pass"), F.col("error"))
    return view(spark, sf, "results").select("sample_id", status.alias("drc_status"))


@query("report_has_errors", with_views("report_lines") + "SELECT component, count(*) > 3 AS has_errors FROM report_lines GROUP BY component")
def _(spark, sf):
    return reports.report_has_errors(view(spark, sf, "report_lines"))
