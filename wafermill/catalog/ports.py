"""Queries over port tables."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import run_sql, view, with_views
from wafermill.operators import ports


@query(
    "port_tree",
    with_views("ports") + """
, s AS (SELECT component, string_split(name, '_') AS p FROM ports), k AS (SELECT component, p, unnest(range(len(p))) AS d FROM s)
SELECT DISTINCT component, CAST(d AS INTEGER) AS depth, array_to_string(p[1:d], '_') AS parent, p[d + 1] AS child, array_to_string(p[1:d + 1], '_') AS path FROM k""",
)
def _(spark, sf):
    return ports.port_tree(view(spark, sf, "ports"))


@query(
    "port_ls",
    with_views("ports") + """
, c AS (SELECT DISTINCT component, split_part(name, '_', 2) AS child FROM ports WHERE split_part(name, '_', 1) = 'Brand12')
SELECT a.component, c.child IS NOT NULL AS known, c.child FROM (SELECT DISTINCT component FROM ports) a LEFT JOIN c USING (component)""",
)
def _(spark, sf):
    return ports.port_ls(ports.port_tree(view(spark, sf, "ports")), "Brand12")


@query(
    "rename_by_orientation",
    with_views("ports") + """
SELECT component, port_id, concat(regexp_replace(name, '_[^_]*$', ''), '_', CASE orientation WHEN 0 THEN 'E' WHEN 90 THEN 'N' WHEN 180 THEN 'W' ELSE 'S' END) AS name,
       concat(name, CASE orientation WHEN 0 THEN '_E' WHEN 90 THEN '_N' WHEN 180 THEN '_W' ELSE '_S' END) AS appended FROM ports""",
)
def _(spark, sf):
    rows = view(spark, sf, "ports").select("component", "port_id", "name", "orientation")
    both = ports.append_orientation(rows.withColumn("_n", F.col("name")))
    both = both.withColumn("appended", F.col("name")).withColumn("name", F.col("_n")).drop("_n")
    return ports.rename_by_orientation(both).select("component", "port_id", "name", "appended")


KEYWORDS = [("ring", "gate"), ("red", "drain"), ("Brand1", "body")]


@query(
    "rename_by_list",
    with_views("ports") + """
, h AS (SELECT *, CASE WHEN contains(name, 'ring') THEN 'gate' WHEN contains(name, 'red') THEN 'drain' WHEN contains(name, 'Brand1') THEN 'body' END AS w FROM ports),
r AS (SELECT *, row_number() OVER (PARTITION BY component, w ORDER BY port_id) AS n FROM h)
SELECT component, port_id, CASE WHEN w IS NULL THEN name WHEN n = 1 THEN w ELSE concat(w, n - 1) END AS name FROM r""",
)
def _(spark, sf):
    return ports.rename_by_list(view(spark, sf, "ports"), KEYWORDS).select("component", "port_id", "name")


@query(
    "replace_prefix",
    with_views("ports") + """
, a AS (SELECT *, CASE WHEN starts_with(name, 'Brand1') THEN concat('M', substring(name, 7)) ELSE name END AS n1 FROM ports),
b AS (SELECT *, CASE WHEN starts_with(n1, 'M') THEN concat('Brand', substring(n1, 2)) ELSE n1 END AS n2 FROM a)
SELECT component, n2 AS name, max(port_id) AS port_id FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    got = ports.replace_prefix(view(spark, sf, "ports"), [("Brand1", "M"), ("M", "Brand")])
    return got.select("component", "name", "port_id")


@query("drop_prefix", with_views("ports") + "SELECT component, port_id, name FROM ports WHERE NOT starts_with(name, 'Brand1')")
def _(spark, sf):
    return ports.drop_prefix(view(spark, sf, "ports"), "Brand1").select("component", "port_id", "name")


@query(
    "private_copies",
    with_views("ports") + """
SELECT component, port_id, name FROM ports UNION ALL
SELECT component, port_id, concat(name, '_private') FROM ports WHERE starts_with(name, 'Brand1') OR starts_with(name, 'Brand22_')""",
)
def _(spark, sf):
    return ports.private_copies(view(spark, sf, "ports"), ["Brand1", "Brand22_"]).select("component", "port_id", "name")


WORDS = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'west' WHEN 1 THEN ' Up' WHEN 2 THEN 'Right' WHEN 3 THEN 'down' WHEN 4 THEN '2' WHEN 5 THEN 'E' ELSE 'xyz' END AS word,
       p_partkey * 37 % 1000 - 400 AS angle FROM {part}
"""


@query(
    "normalise_direction",
    with_views(words=WORDS) + """
, d AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 3 END AS direction,
          ((angle % 360) + 360) % 360 AS a FROM words)
SELECT p_partkey, word, angle, direction, CASE direction WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 0 WHEN 4 THEN 270 END AS word_angle,
       CAST(CASE WHEN a > 180 THEN a - 360 ELSE a END AS INTEGER) AS signed_angle, substring('ENWS', CAST(a // 90 AS INTEGER) + 1, 1) AS letter FROM d""",
)
def _(spark, sf):
    return ports.normalise_direction(run_sql(spark, sf, WORDS), "word", "angle")


# Port pairs: the two parts of a line item and of the supplier's number.
PORT_PAIRS = """
SELECT l_orderkey, l_linenumber, a.name AS a_name, b.name AS b_name, a.cx AS a_cx, a.cy AS a_cy, a.orientation AS a_orientation,
       b.cx AS b_cx, b.cy AS b_cy, b.orientation + CASE WHEN l_orderkey % 10 = 0 THEN 45 ELSE 0 END AS b_orientation
FROM {lineitem} JOIN ports a ON a.port_id = l_partkey JOIN ports b ON b.port_id = l_suppkey
"""


def _pairs(spark, sf):
    from wafermill.catalog.adapters import VIEWS

    return run_sql(spark, sf, "WITH ports AS (" + VIEWS["ports"] + ") " + PORT_PAIRS)


@query(
    "parallel_inline_pairs",
    with_views("ports", pairs=PORT_PAIRS) + """
, q AS (SELECT *, a_orientation % 180 = b_orientation % 180 OR (b_orientation % 90 = 45 AND false) AS p FROM pairs)
SELECT l_orderkey, l_linenumber, a_name, b_name, p AS parallel,
       p AND CASE WHEN a_orientation % 180 = 90 THEN a_cx = b_cx ELSE a_cy = b_cy END AS inline FROM q""",
)
def _(spark, sf):
    return ports.parallel_inline_pairs(_pairs(spark, sf)).select(
        "l_orderkey", "l_linenumber", "a_name", "b_name", "parallel", "inline"
    )


# Angles off the four directions for some ports, and places that differ by less than the tolerance.
SHIFTED = "SELECT component, port_id, cx + (port_id % 7) * CAST(0.02 AS DOUBLE) AS cx, cy + (port_id % 5) * CAST(0.03 AS DOUBLE) AS cy, CASE WHEN port_id % 11 = 0 THEN orientation + 45 ELSE orientation - 360 END AS orientation FROM ports"


@query(
    "find_inline_pairs",
    with_views("ports") + f", shifted AS ({SHIFTED})" + """
, p AS (SELECT component, port_id, orientation % 180 <> 0 AS upright, CASE WHEN orientation % 180 <> 0 THEN cx ELSE cy END AS at FROM shifted WHERE orientation % 90 = 0)
SELECT a.component, a.port_id AS a_id, b.port_id AS b_id, CASE WHEN a.upright THEN 90 ELSE 0 END AS angle
FROM p a JOIN p b ON a.component IS NOT DISTINCT FROM b.component AND a.upright = b.upright AND a.port_id < b.port_id AND NOT least(a.at, b.at) < greatest(a.at, b.at) - CAST(0.1 AS DOUBLE)""",
)
def _(spark, sf):
    rows = spark.sql(SHIFTED.replace("FROM ports", "FROM {ports}"), ports=view(spark, sf, "ports"))
    return ports.find_inline_pairs(rows, 0.1).withColumn("angle", F.col("angle").cast("int"))


@query(
    "port_checks",
    with_views("ports", pairs=PORT_PAIRS) + """
SELECT 'port' AS kind, port_id AS id, CASE WHEN port_id % 8 = 0 THEN 'not manhattan' ELSE 'key differs from name' END AS problem FROM ports WHERE port_id % 8 = 0 OR port_id % 9 = 0 AND port_id % 8 <> 0
UNION ALL SELECT 'port', port_id, 'key differs from name' FROM ports WHERE port_id % 72 = 0
UNION ALL SELECT 'pair', l_orderkey, 'not perpendicular' FROM pairs WHERE abs(a_orientation - b_orientation) NOT IN (90, 270)""",
)
def _(spark, sf):
    rows = view(spark, sf, "ports")
    rows = rows.withColumn("key", F.when(F.col("port_id") % 9 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    rows = rows.withColumn("orientation", F.when(F.col("port_id") % 8 == 0, F.col("orientation") + 45).otherwise(F.col("orientation")))
    one = ports.port_checks(rows).select(F.lit("port").alias("kind"), F.col("port_id").alias("id"), "problem")
    two = ports.perpendicular_checks(_pairs(spark, sf))
    return one.union(two.select(F.lit("pair").alias("kind"), F.col("l_orderkey").alias("id"), "problem"))


PIN_NAMES = """
SELECT l_orderkey, l_linenumber, l_partkey,
       concat('mult_', CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'row0' END, '_', CASE l_partkey % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'drain' ELSE 'gate' END, '_E') AS n1,
       concat('A_', CASE l_suppkey % 2 WHEN 0 THEN 'B' ELSE 'x' END, '_', CASE l_suppkey % 3 WHEN 0 THEN 'drain' WHEN 1 THEN 'gate' ELSE 'none' END) AS n2
FROM {lineitem}
"""


@query(
    "device_pin",
    with_views(pins=PIN_NAMES) + """
, p AS (SELECT *, concat(CASE WHEN contains(n1, '_A_') THEN 'A' WHEN contains(n1, '_B_') THEN 'B' ELSE '' END, '_', split_part(n1, '_', 3)) AS pin_a,
         concat(CASE WHEN contains(n2, '_B_') THEN 'B' ELSE 'A' END, '_', replace(split_part(n2, '_', 3), 'none', '')) AS pin_b FROM pins)
SELECT *, (pin_a = 'A_source' AND pin_b = 'B_drain') OR (pin_b = 'A_source' AND pin_a = 'B_drain') AS matches FROM p""",
)
def _(spark, sf):
    return ports.route_matches(run_sql(spark, sf, PIN_NAMES), "n1", "n2", "A_source", "B_drain")
