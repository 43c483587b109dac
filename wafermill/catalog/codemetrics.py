"""Queries over generated code and its metrics."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import codemetrics as cm

# The texts get code around them: calls that the score looks for, fences, syntax errors.
VIEWS["code_files"] = """
SELECT d.doc_id, source AS run, lang AS model_size, COALESCE(quality, 0) = 1 AS compiles,
       concat(CASE WHEN d.doc_id % 2 = 0 THEN 'import layoutkit' ELSE 'import os' END, chr(10),
              CASE WHEN d.doc_id % 3 = 0 THEN 'def flipped_voltage_follower(pdk):' ELSE 'class Cell:' END, chr(10), chr(10),
              CASE WHEN d.doc_id % 5 = 0 THEN '    x = Component() if nmos(1) else movex(2)' ELSE '   ' END, chr(10),
              text, chr(10), CASE WHEN d.doc_id % 7 = 0 THEN 'L_route add_port netlist' ELSE '' END) AS code
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
FENCED = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('```python', chr(10), '  ', trim(text), chr(10), '```') WHEN 1 THEN concat(' ```py', chr(10), trim(text), '```  ')
       WHEN 2 THEN concat('```', chr(10), trim(text)) WHEN 3 THEN concat('```python\\\\n', trim(text), '``` end') WHEN 4 THEN concat('see ```python', chr(10), trim(text), ' ``` end')
       ELSE trim(text) END AS content, CASE WHEN doc_id % 10 = 9 THEN 'a.py' ELSE 'a.txt' END AS file
FROM {documents}
"""
FENCED_DUCK = FENCED.replace("\\\\", "\\").replace("{documents}", "documents")
PATTERNS = cm.relevance_patterns(["layoutkit", "maskkit"])
FLAT = r"regexp_replace({x}, '^[\t\n\r\x0b\f ]+|[\t\n\r\x0b\f ]+$', '', 'g')"


@query(
    "clean_generated_code",
    f"WITH f AS ({FENCED_DUCK}), s AS (SELECT doc_id, {FLAT.format(x='content')} AS t FROM f), "
    + r"o AS (SELECT doc_id, regexp_replace(t, '^```(python|py)?\n\s*', '') AS t FROM s) SELECT doc_id, md5(regexp_replace(t, '\s*```$', '')) AS digest FROM o",
)
def _(spark, sf):
    return run_sql(spark, sf, FENCED).select("doc_id", F.md5(cm.clean_generated_code(F.col("content"))).alias("digest"))


@query(
    "extract_code",
    f"WITH f AS ({FENCED_DUCK}), e AS (SELECT doc_id, content, file, "
    + r"regexp_extract(content, '(?s)```python\\n(.+?)```', 1) AS c, regexp_extract(content, '(?s)```python\n(.+?)```', 1) AS x FROM f) SELECT doc_id, md5("
    + FLAT.format(x="CASE WHEN file = 'a.py' OR c = '' THEN content ELSE c END") + ") AS compat, md5("
    + FLAT.format(x="CASE WHEN file = 'a.py' OR x = '' THEN content ELSE x END") + ") AS fixed FROM e",
)
def _(spark, sf):
    rows = run_sql(spark, sf, FENCED)
    return rows.select(
        "doc_id", F.md5(cm.extract_code(F.col("content"), F.col("file"))).alias("compat"),
        F.md5(cm.extract_code(F.col("content"), F.col("file"), "fixed")).alias("fixed"),
    )


SOURCE = r"""
SELECT doc_id, concat('g', doc_id, '.py') AS name, CASE doc_id % 3 WHEN 0 THEN concat('def f(a):', chr(10), '    return a * ', n_chars, chr(10), '# ', {flat})
       WHEN 1 THEN concat('def f(:', chr(10), '# ', {flat}) ELSE concat('x = [', n_chars, chr(10)) END AS code FROM {documents}
"""


def _sources(spark, sf):
    return run_sql(spark, sf, SOURCE.replace("{flat}", r"regexp_replace(text, '[\\x00-\\x1f]', ' ')"))


@query("compile_check", "SELECT doc_id, doc_id % 3 = 0 AS compiles FROM documents")
def _(spark, sf):
    return cm.compile_check(_sources(spark, sf), "doc_id", "code").select("doc_id", "compiles")


@query(
    "compile_log",
    """SELECT name, CASE WHEN doc_id % 3 = 0 THEN 'compiled' ELSE 'not compiled' END AS status,
       concat('file: ', name, chr(10), 'status: ', CASE WHEN doc_id % 3 = 0 THEN 'compiled' ELSE 'not compiled' END, chr(10), chr(10)) AS head
       FROM (SELECT doc_id, concat('g', doc_id, '.py') AS name FROM documents) d""",
)
def _(spark, sf):
    checked = cm.compile_check(_sources(spark, sf), "name", "code", "string")
    return cm.compile_log(checked, "name").select("name", "status", F.regexp_extract("log", r"(?s)^(.*?\n\n)", 1).alias("head"))


# Words next to letters outside of ASCII: first other signs become blanks, then letters x.
ASCII = r"regexp_replace(regexp_replace(code, '[^\x00-\x7F\p{L}\p{N}\p{M}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"
HITS = " + ".join(f"CAST(regexp_matches(code, '{p}') AS INTEGER)" for p in PATTERNS.values())
METRICS = r"""
, a AS (SELECT *, """ + ASCII + r""" AS flat FROM code_files),
m AS (SELECT doc_id, run, model_size, compiles, CAST(len(list_filter(regexp_split_to_array(code, '\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda l: regexp_matches(l, '[^\s\p{Z}\x0b]'))) AS INTEGER) AS lines,
        (""" + HITS + r""") / CAST(9 AS DOUBLE) * 5 AS relevance,
        CAST(len(regexp_extract_all(flat, '\b(if|for|while|try|with)\b')) AS INTEGER) AS control_structures,
        CAST(len(regexp_extract_all(flat, '\bdef\b')) AS INTEGER) AS functions, CAST(len(regexp_extract_all(flat, '\bclass\b')) AS INTEGER) AS classes FROM a),
metrics AS (SELECT *, CAST(compiles AS INTEGER) * CAST(0.4 AS DOUBLE) + relevance / 5 * CAST(0.6 AS DOUBLE) AS composite_score FROM m)
"""
BASE = with_views("code_files")[:-1] + METRICS


def _metrics(spark, sf):
    return cm.prediction_metrics(view(spark, sf, "code_files"), PATTERNS, "doc_id", "run", "model_size")


@query("code_lines", BASE + "SELECT doc_id, lines FROM metrics")
def _(spark, sf):
    return view(spark, sf, "code_files").select("doc_id", cm.code_lines(F.col("code")).alias("lines"))


@query("relevance", BASE + "SELECT doc_id, round(relevance, 9) AS relevance FROM metrics")
def _(spark, sf):
    rows = view(spark, sf, "code_files")
    return rows.select("doc_id", F.round(cm.relevance(F.col("code"), PATTERNS), 9).alias("relevance"))


@query("complexity", BASE + "SELECT doc_id, control_structures, functions, classes FROM metrics")
def _(spark, sf):
    return view(spark, sf, "code_files").select("doc_id", *cm.complexity(F.col("code")))


@query("composite", BASE + "SELECT doc_id, round(composite_score, 9) AS composite_score FROM metrics")
def _(spark, sf):
    return _metrics(spark, sf).select("doc_id", F.round("composite_score", 9).alias("composite_score"))


@query(
    "metric_summary",
    BASE + "SELECT run, model_size, " + ", ".join(
        f"round_even(CAST(sum(CAST(CAST({m} AS DOUBLE) AS DECIMAL(24,12))) AS DOUBLE) / count(*), 3) AS {m}" if m != "compiles" else "round_even(count(*) FILTER (compiles) / CAST(count(*) AS DOUBLE), 3) AS compiles"
        for m in cm.SUMMARY_METRICS
    ) + ", concat(model_size, '-', run) AS model_variant FROM metrics GROUP BY run, model_size",
)
def _(spark, sf):
    return cm.metric_summary(_metrics(spark, sf))


@query(
    "run_t_tests",
    BASE + ", long AS (" + " UNION ALL ".join(
        f"SELECT run, '{m}' AS metric, CAST({m if m != 'compiles' else 'CAST(compiles AS INTEGER)'} AS DOUBLE) AS x FROM metrics" for m in cm.TEST_METRICS
    ) + """),
s AS (SELECT run, metric, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mu, var_samp(x) AS v FROM long GROUP BY run, metric),
p AS (SELECT a.metric, concat(a.run, ' vs ', b.run) AS comparison, a.n + b.n - 2 AS df, (a.mu - b.mu) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 0) AS t
      FROM s a JOIN s b ON a.metric = b.metric AND a.run < b.run),
q AS (SELECT *, abs(t) / 400 AS h, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c FROM p),
z AS (SELECT *, 1 - 2 * c * h / 3 * list_sum(list_transform(range(401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(i * h, 2) / df, -(df + 1) / 2))) AS pv FROM q)
SELECT comparison, metric, round(t, 3) AS t_statistic, round(greatest(pv, 0), 4) AS p_value, COALESCE(pv < 0.05, false) AS significant FROM z""",
)
def _(spark, sf):
    return cm.run_t_tests(_metrics(spark, sf))


@query(
    "metric_long",
    BASE + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, {m} AS value FROM metrics" for m in cm.COMPLEXITY),
)
def _(spark, sf):
    return cm.metric_long(_metrics(spark, sf), ["doc_id"])


ITERATIONS = """
SELECT DISTINCT CASE WHEN c_custkey % 9 = 0 THEN concat('base_', c_nationkey) ELSE concat('iteration_', c_custkey % 700) END AS run, c_mktsegment AS model_size FROM {customer}
"""


@query(
    "run_order",
    with_views(i=ITERATIONS) + """
, k AS (SELECT *, TRY_CAST(regexp_extract(run, '^iteration_([0-9]+)$', 1) AS INTEGER) AS run_number FROM i)
SELECT model_size, run, run_number, row_number() OVER (PARTITION BY model_size ORDER BY run_number NULLS LAST, run) AS place FROM k""",
)
def _(spark, sf):
    return cm.run_order(run_sql(spark, sf, ITERATIONS))


@query(
    "distribution_stats",
    BASE + " UNION ALL ".join(
        f"SELECT run, model_size, '{m}' AS metric, " + ", ".join(
            f"round(quantile_cont({m}, CAST({q} AS DOUBLE)), 9) AS {n}" for n, q in (('min', 0), ('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('max', 1))
        ) + " FROM metrics GROUP BY run, model_size" for m in ("composite_score", "relevance")
    ),
)
def _(spark, sf):
    got = cm.distribution_stats(_metrics(spark, sf), ["run", "model_size"], ["composite_score", "relevance"])
    return got.select("run", "model_size", "metric", *[F.round(n, 9).alias(n) for n in ("min", "q1", "median", "q3", "max")])
