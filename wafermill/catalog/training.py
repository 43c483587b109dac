"""Queries over training-data preparation."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import training
from wafermill.session import scratch_path

VIEWS["answers"] = """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN '7b' WHEN 1 THEN '7b-ft' WHEN 2 THEN '13b' ELSE '13b-ft' END AS folder, user_id, event_type FROM {events}
"""


@query(
    "combine_by_model",
    with_views("answers") + "SELECT CASE WHEN folder LIKE '7%' THEN '7b' ELSE '13b' END AS model_tag, event_id, folder FROM answers",
)
def _(spark, sf):
    items = training.combine_by_model(view(spark, sf, "answers").select("event_id", "folder"), "folder")
    path = scratch_path(spark, "combined")
    training.write_by_model(items, path)
    return spark.read.schema("event_id bigint, folder string, model_tag string").json(path)


@query("folder_counts", with_views("answers") + "SELECT folder, count(*) AS samples FROM answers GROUP BY ROLLUP (folder)")
def _(spark, sf):
    return training.folder_counts(view(spark, sf, "answers"), "folder")


# Nested reviews: without analysis, without explanation, with missing keys, or whole.
VIEWS["nested"] = """
SELECT event_id, CASE WHEN event_id % 11 > 0 THEN concat('f', user_id, '.py') END AS filename, event_id % 5 AS kind, event_type AS issue, props FROM {events}
"""


def _reviews(spark, sf):
    rows = view(spark, sf, "nested")
    said = F.struct(
        F.col("props").alias("problem"), F.when(F.col("kind") == 3, F.lit(None)).otherwise(F.concat(F.lit("r"), "issue")).alias("reason"),
        F.concat(F.lit("fix "), "event_id").alias("fix"),
    )
    one = F.struct(F.col("issue").alias("issue"), F.when(F.col("kind") != 2, said).alias("explanation"))
    two = F.struct(F.lit("second").alias("issue"), said.alias("explanation"))
    return rows.select(
        "event_id", "filename",
        F.when(F.col("kind") == 0, F.slice(F.array(one), 1, 0)).when(F.col("kind") == 1, F.array(one, two)).otherwise(F.array(one)).alias("analysis"),
        F.when(F.col("kind") != 4, F.concat(F.lit("code\n"), "props")).alias("fixed_code"),
    )


@query(
    "render_training_text",
    with_views("nested") + """
, t AS (SELECT event_id, concat('Filename: ', COALESCE(filename, ''), chr(10), 'Issue: ', CASE WHEN kind = 0 THEN 'No specific issue identified' ELSE issue END, chr(10),
   'Problem: ', CASE kind WHEN 0 THEN 'Code review completed' WHEN 2 THEN '' ELSE props END, chr(10), 'Reason: ', CASE kind WHEN 0 THEN 'General code improvement' WHEN 2 THEN '' WHEN 3 THEN '' ELSE concat('r', issue) END, chr(10), '### Fix:', chr(10)) AS prompt,
   concat(CASE kind WHEN 0 THEN 'Code has been optimized' WHEN 2 THEN '' ELSE concat('fix ', event_id) END, chr(10), chr(10), '### Fixed Code:', chr(10), CASE WHEN kind = 4 THEN '' ELSE concat('code', chr(10), props) END) AS target FROM nested)
SELECT *, concat(prompt, target, '</s>') AS full_text FROM t""",
)
def _(spark, sf):
    return training.render_training_text(_reviews(spark, sf), "event_id")


TOKENS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> ''))"


@query(
    "label_mask",
    with_views("sft_turns") + ", k AS (SELECT conv_id, turn, " + TOKENS.format(x="prompt") + " AS p, " + TOKENS.format(x="concat(prompt, ' ', target, '</s>')") + """ AS n FROM sft_turns)
SELECT conv_id, turn, CAST(p AS INTEGER) AS prompt_tokens, CAST(n AS INTEGER) AS total_tokens, CAST(least(n, 48) AS INTEGER) AS kept_tokens,
       CAST(greatest(least(n, 48) - p, 0) AS INTEGER) AS target_tokens, CAST(48 - least(n, 48) AS INTEGER) AS padding, n > 48 AS truncated FROM k""",
)
def _(spark, sf):
    rows = view(spark, sf, "sft_turns").withColumn("full_text", F.concat("prompt", F.lit(" "), "target", F.lit("</s>")))
    return training.label_mask(rows, 48).drop("prompt", "target", "full_text")


@query(
    "train_eval_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) <= (SELECT count(*) * 9 // 10 FROM documents) THEN 'train' ELSE 'eval' END AS split FROM documents""",
)
def _(spark, sf):
    return training.train_eval_split(run_sql(spark, sf, "SELECT doc_id FROM {documents}"), "doc_id", "42")


BASE = "Look at example.py.\n****code****:\n\nAnswer for example.py"


@query(
    "repair_prompt",
    f"""
WITH f AS (SELECT doc_id, text AS code, concat('log ', n_chars) AS log, concat('d', doc_id, '.py') AS name FROM documents),
b AS (SELECT *, concat(code, chr(10), chr(10), '--- compile log ---', chr(10), log, chr(10)) AS body FROM f)
SELECT doc_id, md5(replace(replace(concat('{BASE.replace(chr(10), "' || chr(10) || '")}', ' more', chr(10), chr(10), '**Additional Context Instructions:**', chr(10), 'be short', chr(10), chr(10), chr(10), chr(10), body),
  '****code****:', concat('****code****:', chr(10), body)), 'example.py', name)) AS digest FROM b""",
)
def _(spark, sf):
    files = run_sql(spark, sf, "SELECT doc_id, text AS code, concat('log ', n_chars) AS compile_log, concat('d', doc_id, '.py') AS filename FROM {documents}")
    return training.repair_prompt(files, BASE, " more", "be short").select("doc_id", F.md5("prompt").alias("digest"))


LOGS = """
SELECT concat('f', o_custkey) AS stem, CASE o_orderkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.log' ELSE '.out' END AS ext, concat('log ', min(o_orderkey)) AS log
FROM {orders} GROUP BY o_custkey, o_orderkey % 3
"""


@query(
    "attach_compile_log",
    with_views(logs=LOGS) + """
SELECT c_custkey, concat('f', c_custkey) AS stem, COALESCE((SELECT log FROM logs WHERE stem = concat('f', c_custkey) AND ext = '.txt'),
   (SELECT log FROM logs WHERE stem = concat('f', c_custkey) AND ext = '.log'), '(compile log missing)') AS compile_log FROM customer""",
)
def _(spark, sf):
    files = run_sql(spark, sf, "SELECT c_custkey, concat('f', c_custkey) AS stem FROM {customer}")
    return training.attach_compile_log(files, run_sql(spark, sf, LOGS)).select("c_custkey", "stem", "compile_log")


@query("skip_done", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    files = run_sql(spark, sf, "SELECT doc_id, source FROM {documents}")
    return training.skip_done(files, run_sql(spark, sf, "SELECT doc_id FROM {labels}"), "doc_id")


@query(
    "progress_eta",
    with_views("results") + """
SELECT pcell, count(*) AS processed, round(CAST(sum(CAST(execution_time AS DECIMAL(24,6))) AS DOUBLE) / count(*), 6) AS avg_seconds,
       round((1000000 - count(*)) * CAST(sum(CAST(execution_time AS DECIMAL(24,6))) AS DOUBLE) / count(*), 6) AS eta_seconds FROM results GROUP BY pcell""",
)
def _(spark, sf):
    rows = view(spark, sf, "results").withColumn("planned", F.lit(1000000).cast("long"))
    return training.progress_eta(rows, ["pcell"], "execution_time", "planned")
