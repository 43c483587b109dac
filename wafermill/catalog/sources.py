"""Queries that write derived data to files in the shared folder and read them back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.session import scratch_path
from wafermill.sources import records, text

#: Keys that share a file, so that the number of files follows the data.
PER_FILE = 1000


def written(spark, label, rows, bucket, suffix=""):
    """Write text rows (bucket, line_no, line) as one file per bucket, in order."""
    path = scratch_path(spark, label) + suffix
    (
        rows.withColumn(bucket, F.col(bucket).cast("string"))
        .repartition(bucket).sortWithinPartitions(bucket, "line_no")
        .select(bucket, "line").write.partitionBy(bucket).text(path)
    )
    return path


def bucket_of(name, column="path"):
    return F.regexp_extract(column, f"{name}=([^/]+)/", 1)


RECORDS = "SELECT sample_id, component_name, success, drc_pass, lvs_pass, execution_time, area_um2 FROM results"


def json_arrays(spark, label, rows, key, columns):
    """Write rows as files that hold one JSON array each."""
    placed = rows.withColumn("f", F.floor(F.col(key) / PER_FILE))
    first = F.min(key).over(Window.partitionBy("f"))
    body = placed.select(
        "f", F.col(key).alias("line_no"),
        F.concat(F.when(F.col(key) == first, "").otherwise(","), F.to_json(F.struct(*columns))).alias("line"),
    )
    brackets = placed.groupBy("f").agg(F.max(key).alias("top")).select("f", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("[").alias("line")),
        F.struct((F.col("top") + 1).alias("line_no"), F.lit("]").alias("line")),
    )).alias("b")).select("f", "b.*")
    return written(spark, label, body.union(brackets), "f", ".json")


@query("read_records_json", with_views("results") + RECORDS)
def _(spark, sf):
    columns = ["sample_id", "component_name", "success", "drc_pass", "lvs_pass", "execution_time", "area_um2"]
    path = json_arrays(spark, "records", view(spark, sf, "results"), "sample_id", columns)
    return records.read_records_json(spark, path).select(columns)


@query(
    "read_params_json",
    "SELECT p_size % 7 AS fingers_first, count(*) AS n, max(p_size / CAST(2 AS DOUBLE)) AS widest FROM part GROUP BY 1",
)
def _(spark, sf):
    rows = run_sql(spark, sf, """
        SELECT p_partkey, array(p_size / 2.0D, p_size / 4.0D) AS width, array(0.5D, 0.25D) AS length,
               array(p_size % 7, 1) AS fingers, array(1, 2) AS multipliers FROM {part}""")
    path = json_arrays(spark, "params", rows, "p_partkey", ["width", "length", "fingers", "multipliers"])
    got = records.read_params_json(spark, path)
    return got.groupBy(got.fingers[0].alias("fingers_first")).agg(
        F.count(F.lit(1)).alias("n"), F.max(got.width[0]).alias("widest")
    )


@query("write_jsonl", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    records.write_jsonl(run_sql(spark, sf, "SELECT doc_id, lang, text FROM {documents}"), path)
    return spark.read.schema("doc_id bigint, lang string, text string").json(path).select(
        "doc_id", "lang", F.md5("text").alias("digest")
    )


@query(
    "write_flat_csv",
    with_views("results") + """SELECT sample_id, error, concat('[', sample_id % 5, ',', sample_id % 3, ']') AS fingers FROM results""",
)
def _(spark, sf):
    rows = view(spark, sf, "results").select(
        "sample_id", "error",
        F.array((F.col("sample_id") % 5).cast("int"), (F.col("sample_id") % 3).cast("int")).alias("fingers"),
    )
    path = scratch_path(spark, "csv")
    records.write_flat_csv(rows, path)
    return (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        .schema("sample_id bigint, error string, fingers string").csv(path)
    )


@query(
    "read_report_lines",
    "SELECT CAST(floor(c_custkey / 500) AS INTEGER) AS file, row_number() OVER (PARTITION BY floor(c_custkey / 500) ORDER BY c_custkey) AS line_no, "
    "concat(c_name, ' ', c_mktsegment) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    rows = run_sql(spark, sf, """
        SELECT CAST(CAST(floor(c_custkey / 500) AS INT) AS STRING) AS f, c_custkey AS line_no, concat('  ', c_name, ' ', c_mktsegment, '\t ') AS line
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")
    got = text.read_report_lines(spark, written(spark, "lines", rows, "f"))
    return got.select(bucket_of("f").cast("int").alias("file"), "line_no", "line")


# Lines of fenced reviews: per event a good block, a broken block, a good or broken
# single-line object, plain text, or (last event of a file only) a block without an end.
VIEWS["fenced"] = """
SELECT concat('f', user_id % 16) AS path, event_id,
       CASE WHEN event_id >= (SELECT max(event_id) - 15 FROM {events}) AND event_id % 2 = 0 THEN 6 ELSE event_id % 6 END AS kind,
       event_type, user_id
FROM {events}
"""


def _fenced_lines(spark, sf):
    rows = view(spark, sf, "fenced")
    name = F.concat(F.lit('{"filename": "é'), F.col("user_id"), F.lit('.py",'))
    rest = F.concat(F.lit('   "issue": "'), F.col("event_type"), F.lit('"}'))
    fence, end = F.lit("```json"), F.lit("```")
    parts = (
        F.when(F.col("kind") == 0, F.array(fence, name, F.lit("  "), rest, end))
        .when(F.col("kind") == 1, F.array(fence, name, end))
        .when(F.col("kind") == 2, F.array(F.concat(name, rest)))
        .when(F.col("kind") == 3, F.array(name, F.lit("```")))
        .when(F.col("kind") == 4, F.array(F.lit("some text"), F.lit("[1, 2]")))
        .when(F.col("kind") == 5, F.array(F.lit("  ```json  "), F.lit(" "), end))
        .otherwise(F.array(fence, name, rest))
    )
    return rows.select("path", "event_id", F.posexplode(parts).alias("pos", "line")).select(
        "path", (F.col("event_id") * 8 + F.col("pos")).alias("line_no"), "line"
    )


# A block without an end (kind 6) reaches to the next fence: it is given up if that opens a block,
# and takes in all lines before it if that is the stray end of kind 3, or the end of the file.
FENCED_KINDS = """
, k AS (SELECT *, last_value(CASE WHEN kind IN (0, 1, 3, 5, 6) THEN kind END IGNORE NULLS)
               OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        first_value(CASE WHEN kind IN (0, 1, 3, 5, 6) THEN kind END IGNORE NULLS)
               OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
        max(event_id) OVER (PARTITION BY path) AS last_event FROM fenced)
"""


@query(
    "read_fenced_json",
    with_views("fenced").rstrip() + FENCED_KINDS + """
SELECT path, CASE kind WHEN 0 THEN 'block' WHEN 2 THEN 'inline' ELSE 'unterminated' END AS kind, concat('é', user_id, '.py') AS filename, event_type AS issue
FROM k WHERE kind = 0 OR (kind = 2 AND before IS DISTINCT FROM 6) OR (kind = 6 AND event_id = last_event)""",
)
def _(spark, sf):
    path = written(spark, "fenced", _fenced_lines(spark, sf), "path")
    got = text.read_fenced_json(spark, path, "filename string, issue string")
    return got.select(bucket_of("path").alias("path"), "kind", "item.filename", "item.issue")


@query(
    "quarantine_bad_json",
    with_views("fenced").rstrip() + FENCED_KINDS + """
SELECT path, CASE WHEN kind = 1 OR (kind = 3 AND before = 6) THEN 'block' WHEN kind = 3 THEN 'inline' ELSE 'unterminated' END AS kind, count(*) AS bad
FROM k WHERE kind IN (1, 3) OR (kind = 6 AND after IS NULL AND event_id < last_event) GROUP BY 1, 2""",
)
def _(spark, sf):
    from wafermill.operators.training import quarantine_bad_json

    found = text.fenced_json_texts(_fenced_lines(spark, sf))
    return quarantine_bad_json(found).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("bad"))


@query(
    "load_json_or_jsonl",
    "SELECT event_id, concat('u', user_id) AS filename, event_type AS issue FROM events",
)
def _(spark, sf):
    rows = run_sql(spark, sf, "SELECT event_id, concat('u', user_id) AS filename, event_type AS issue FROM {events}")
    schema = "event_id bigint, filename string, issue string"
    even = rows.where("event_id % 2 = 0")
    listed = json_arrays(spark, "list", even, "event_id", ["event_id", "filename", "issue"]) 
    lined = scratch_path(spark, "lined") + ".jsonl"
    rows.where("event_id % 2 = 1").write.json(lined)
    return text.load_json_or_jsonl(spark, listed, schema).drop("f").union(text.load_json_or_jsonl(spark, lined, schema))


@query("read_predictions", "SELECT source AS run, lang AS model_size, md5(trim(text)) AS digest FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = run_sql(spark, sf, "SELECT source AS run, lang AS model_size, trim(text) AS content FROM {documents}")
    text.write_predictions(rows, path)
    got = text.read_predictions(spark, path, "part-*.txt")
    return got.select(
        # Paths are escaped once more than the names of folders.
        *[F.url_decode(F.url_decode(F.substring_index(c, "=", -1))).alias(c) for c in ("run", "model_size")],
        F.md5(F.rtrim(F.regexp_replace("content", r"\n\z", ""))).alias("digest"),
    )


VIEWS["scored"] = """
SELECT concat('s', CAST(floor(o_custkey / 100) AS BIGINT)) AS path, o_orderkey, o_orderkey % 5 AS kind, o_custkey, o_totalprice, o_orderstatus FROM {orders}
"""


def _score_lines(spark, sf):
    rows = view(spark, sf, "scored")
    header = F.concat(F.lit("RANK "), F.col("o_custkey"), F.lit(": c_"), F.col("o_orderkey"), F.lit(" (ID: "), F.col("o_orderkey"), F.lit(")"))
    body = [
        F.lit("Individual Scores:"), F.concat(F.lit("  Final Score: "), F.col("o_custkey"), F.lit(".5")), F.lit(""),
        F.lit("Raw Data:"), F.concat(F.lit("success: "), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False")),
    ]
    end = F.lit("----------")
    parts = (
        F.when(F.col("kind") == 0, F.array(F.lit("loose: 1"), header, *body, end))
        .when(F.col("kind") == 1, F.array(header, *body))
        .when(F.col("kind") == 2, F.array(header, *body, F.lit("Final Score: 1:2"), end, F.lit("after: 3")))
        .otherwise(F.array(header, *body[:2], end))
    )
    return rows.select("path", "o_orderkey", F.posexplode(parts).alias("pos", "line")).select(
        "path", (F.col("o_orderkey") * 16 + F.col("pos")).alias("line_no"), "line"
    )


@query(
    "read_score_blocks",
    with_views("scored") + """
SELECT path, CAST(o_custkey AS INTEGER) AS rank, concat('c_', o_orderkey) AS component_name_header, o_orderkey AS id,
       CASE WHEN kind = 2 THEN '1:2' ELSE concat(o_custkey, '.5') END AS "Final Score",
       CASE WHEN kind > 2 THEN NULL WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS success FROM scored""",
)
def _(spark, sf):
    path = written(spark, "scores", _score_lines(spark, sf), "path")
    got = text.score_blocks(text.read_lines(spark, path), ["Final Score", "success"])
    return got.withColumn("path", bucket_of("path"))


VIEWS["measured"] = """
SELECT p_partkey, concat('0 ', p_size, ' 1 ', p_size + 1, '  2 3e-6 3 ', p_size, '.5 4 n/a 5',  CASE WHEN p_partkey % 2 = 0 THEN ' 77' ELSE '' END, chr(10), '9 9 9') AS ac,
       CASE WHEN p_partkey % 3 <> 0 THEN concat('  0 ', p_size * 2) END AS power, CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE concat('0 ', p_size, 'f') END AS noise,
       concat('t ', p_size, ' t', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' 8' END) AS slew
FROM {part}
"""


@query(
    "read_measurement_files",
    with_views("measured") + """
SELECT p.p_partkey, CAST(p_size AS DOUBLE) AS ugb, CAST(p_size + 1 AS DOUBLE) AS "Ibias1", CAST('3e-6' AS DOUBLE) AS "Ibias2",
       p_size + CAST(0.5 AS DOUBLE) AS "phaseMargin", CAST(NULL AS DOUBLE) AS "dcGain", CASE WHEN p.p_partkey % 2 = 0 THEN CAST(77 AS DOUBLE) END AS bw_3db,
       CASE WHEN p.p_partkey % 3 <> 0 THEN CAST(p_size * 2 AS DOUBLE) END AS power, CAST(NULL AS DOUBLE) AS noise,
       CAST(p_size AS DOUBLE) AS rise_slew, CASE WHEN p.p_partkey % 5 <> 0 THEN CAST(8 AS DOUBLE) END AS fall_slew
FROM part p""",
)
def _(spark, sf):
    rows = view(spark, sf, "measured")
    parts = [rows.where(F.col(c).isNotNull()).select("p_partkey", F.col(c).alias("text")) for c in ("ac", "power", "noise", "slew")]
    return text.measurements(*parts, "p_partkey")


@query(
    "write_training_matrix",
    "SELECT l_suppkey AS sample_id, count(*) AS n, CAST(max(l_quantity) AS DOUBLE) AS widest FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    base = run_sql(spark, sf, "SELECT l_suppkey AS sample_id, count(*) AS n, max(l_quantity) AS widest FROM {lineitem} GROUP BY 1")
    path = scratch_path(spark, "matrix")
    records.write_training_matrix(base.select("sample_id", "n"), base.select("sample_id", "widest"), "sample_id", path)
    return spark.read.parquet(f"{path}/params").join(spark.read.parquet(f"{path}/results"), "sample_id")


NETLIST_TEXT = """
SELECT concat('n', CAST(floor(s_suppkey / 10) AS BIGINT)) AS path, s_suppkey, s_nationkey, s_name FROM {supplier}
"""


@query(
    "read_netlist_lines",
    with_views(sup=NETLIST_TEXT) + """
SELECT path, concat('X', s_suppkey, ' A B ', s_name, ' w=', s_nationkey) AS line FROM sup
UNION ALL SELECT path, '* comment' FROM sup UNION ALL SELECT path, 'M1 a b' FROM sup""",
)
def _(spark, sf):
    rows = run_sql(spark, sf, NETLIST_TEXT)
    parts = F.array(
        F.concat(F.lit("X"), F.col("s_suppkey"), F.lit(" A")), F.concat(F.lit("+ B "), F.col("s_name")), F.lit(""),
        F.concat(F.lit("  + w="), F.col("s_nationkey")), F.lit("* comment"), F.lit("M1 a +"), F.lit("+b"),
    )
    lines = rows.select("path", "s_suppkey", F.posexplode(parts).alias("pos", "line")).select(
        "path", (F.col("s_suppkey") * 8 + F.col("pos")).alias("line_no"), "line"
    )
    got = text.netlist_lines(text.read_lines(spark, written(spark, "netlist", lines, "path")))
    return got.select(bucket_of("path").alias("path"), "line")


@query(
    "read_violation_xml",
    """SELECT concat('x', CAST(floor(event_id / 500) AS BIGINT)) AS file, event_type AS category, count(*) AS violations, false AS is_pass
       FROM events WHERE floor(event_id / 500) <> 1 GROUP BY 1, 2 UNION ALL SELECT 'x1', NULL, 0, true""",
)
def _(spark, sf):
    rows = run_sql(spark, sf, "SELECT concat('x', CAST(floor(event_id / 500) AS BIGINT)) AS f, event_id, event_type FROM {events}")
    items = rows.where("f <> 'x1'").select(
        "f", F.col("event_id").alias("line_no"),
        F.concat(F.lit("<item><category>"), F.col("event_type"), F.lit("</category><cell>top</cell></item>")).alias("line"),
    )
    frame = rows.groupBy("f").agg(F.max("event_id").alias("top")).select("f", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("line_no"), F.lit("<?xml version='1.0'?>").alias("line")),
        F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("<report-database><items>").alias("line")),
        F.struct((F.col("top") + 1).alias("line_no"), F.lit("</items></report-database>").alias("line")),
    )).alias("b")).select("f", "b.*")
    got = records.read_violation_xml(spark, written(spark, "xml", items.union(frame), "f"))
    return got.withColumn("file", bucket_of("f")).select("file", "category", "violations", "is_pass")
