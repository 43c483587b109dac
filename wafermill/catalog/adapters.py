"""Views that give the test tables the shapes the operators work on.

Each view is one SQL text used twice: by Spark with the Parquet tables bound to its
``{table}`` marks, and by DuckDB as a common table expression. ``{each k 3}`` behind a
table repeats its rows with k = 0, 1, 2: a generator in both engines, not a join in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["results"] = """
SELECT o_orderkey AS sample_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'fvf' WHEN 1 THEN 'txgate' WHEN 2 THEN 'current_mirror'
            WHEN 3 THEN 'diff_pair' WHEN 4 THEN 'lvcm' ELSE 'opamp' END AS pcell,
       concat('c_', o_orderkey) AS component_name,
       o_custkey % 20 <> 0 AS success,
       o_orderstatus <> 'P' AS drc_pass,
       o_orderpriority <> '5-LOW' AS lvs_pass,
       CASE WHEN o_custkey % 20 = 0 THEN concat('error ', o_orderkey % 7, chr(10), 'detail') END AS error,
       CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_totalprice AS DOUBLE) / 10000 END AS execution_time,
       CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_orderkey * 37 % 1009 + 1 AS DOUBLE) END AS total_resistance_ohms,
       CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_orderkey * 53 % 997 + 1 AS DOUBLE) * CAST('1e-16' AS DOUBLE) END AS total_capacitance_farads,
       CASE WHEN o_custkey % 20 <> 0 THEN CAST(o_orderkey * 11 % 503 AS DOUBLE) END AS area_um2,
       CAST(o_orderkey % 101 AS DOUBLE) / 100 AS symmetry_horizontal,
       CAST(o_orderkey % 89 AS DOUBLE) / 88 AS symmetry_vertical
FROM {orders}
"""

# The die grows with the number of events: one tile of 4,096 units for each 4,096 events,
# so the density stays the same at every scale. Component 0 holds two fifths of all shapes.
VIEWS["shapes"] = """
SELECT CASE WHEN user_id % 5 < 2 THEN 0 ELSE user_id % 5 - 1 END AS component, event_id AS shape_id,
       CASE event_id % 4 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' WHEN 2 THEN 'met2' ELSE 'poly' END AS layer,
       CAST(floor(event_id / 4096) AS BIGINT) * 4096 + event_id * 7919 % 4001 - 2000 AS xl,
       event_id * 6101 % 4003 - 2000 AS yl,
       CAST(floor(event_id / 4096) AS BIGINT) * 4096 + event_id * 7919 % 4001 + 20 + event_id % 61 + CASE WHEN event_id % 16 < 4 THEN 120 ELSE 0 END - 2000 AS xh,
       event_id * 6101 % 4003 + 20 + event_id % 47 + CASE WHEN event_id % 16 < 4 THEN 110 ELSE 0 END - 2000 AS yh
FROM {events}
"""

VIEWS["ports"] = """
SELECT p_partkey % 50 AS component, p_partkey AS port_id,
       concat(replace(p_brand, '#', ''), '_', replace(p_name, ' ', '_'), '_e', p_partkey % 4 + 1) AS name,
       p_partkey * 13 % 500 AS cx, p_partkey * 17 % 500 AS cy, p_size AS width,
       (p_partkey % 4) * 90 AS orientation
FROM {part}
"""

# One rule line and one detail line per line item; the line number orders by
# (l_linenumber, l_partkey, l_suppkey).
VIEWS["report_lines"] = """
SELECT l_orderkey AS component,
       CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey * 10 + k AS line_no,
       CASE k WHEN 0 THEN CASE WHEN l_partkey % 9 = 0 THEN '----------------------------------------'
                               ELSE concat('m', l_linenumber, '.', l_suppkey % 5, ' : min. spacing') END
              ELSE concat('  ', l_partkey, ' ', l_suppkey, ' ', CAST(l_quantity AS BIGINT)) END AS line
FROM {lineitem} {each k 2}
"""

VIEWS["hierarchy"] = """
SELECT 'chip' AS parent, concat('r', r_regionkey) AS child, CAST(1 AS BIGINT) AS n FROM {region}
UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), CAST(1 AS BIGINT) FROM {nation}
UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), CAST(1 AS BIGINT) FROM {supplier}
UNION ALL SELECT concat('s', l_suppkey), concat('model_', l_partkey % 3), count(*) FROM {lineitem} GROUP BY l_suppkey, l_partkey % 3
"""

# All values of an embedding are the axes of a design.
AXES = 64
VIEWS["points"] = f"""
SELECT vec_id, label AS pcell, {", ".join(f"CAST(embedding[{{at {i}}}] AS DOUBLE) AS u{i}" for i in range(AXES))}
FROM {{embeddings}}
"""

VIEWS["predictions"] = """
SELECT d.doc_id, source AS run, lang AS model_size, text AS code, COALESCE(quality, 0) = 1 AS compiles
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

VIEWS["reviews"] = """
SELECT event_id, concat('f', user_id, '.py') AS filename, event_type AS issue, props FROM {events}
"""

VIEWS["sft_turns"] = """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS target
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _marks(text: str) -> list[str]:
    return [t for t in TABLES if re.search(r"\{" + t + r"\}", text)]


def _each(text: str, form: str) -> str:
    def fill(mark: re.Match) -> str:
        numbers = ", ".join(str(i) for i in range(int(mark[2])))
        return form.format(name=mark[1], numbers=numbers)

    return re.sub(r"\{each (\w+) (\d+)\}", fill, text)


def _at(text: str, first: int) -> str:
    """Array places, which count from 0 in Spark and from 1 in DuckDB."""
    return re.sub(r"\{at (\d+)\}", lambda mark: str(int(mark[1]) + first), text)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` in Spark with each ``{table}`` bound to the Parquet table."""
    text = _at(text, 0)
    text = _each(text, "LATERAL VIEW explode(array({numbers})) each_{name} AS {name}")
    bound = {t: load(spark, sf_dir, t) for t in _marks(text)}
    return spark.sql(text, **bound)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, VIEWS[name])


def duck(text: str) -> str:
    """The DuckDB form of an adapter text."""
    text = _at(text, 1)
    text = _each(text, "CROSS JOIN (SELECT unnest([{numbers}]) AS {name}) each_{name}")
    for t in _marks(text):
        text = text.replace("{" + t + "}", t)
    return text


def with_views(*names: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` head for an oracle: the named views, then extra expressions."""
    parts = [f"{n} AS ({duck(VIEWS[n])})" for n in names]
    parts += [f"{n} AS ({duck(t)})" for n, t in extra.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
