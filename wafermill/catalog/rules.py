"""Queries over layer rules and layer maps."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import rules

# One technology for each 40 parts.
VIEWS["rule_rows"] = """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS pdk,
       CASE p_partkey % 5 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' WHEN 2 THEN 'met2' WHEN 3 THEN 'poly' ELSE 'active_diff' END AS glayer1,
       CASE p_size % 4 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' WHEN 2 THEN 'met2' ELSE 'poly' END AS glayer2,
       CASE p_partkey % 4 WHEN 0 THEN 'min_separation' WHEN 1 THEN 'min_width' WHEN 2 THEN 'min_enclosure' ELSE 'max_area' END AS rule,
       p_retailprice / 1000 AS value, p_partkey AS ord FROM {part}
"""
VIEWS["rules"] = "SELECT pdk, glayer1, glayer2, rule, max(value) AS value FROM rule_rows GROUP BY pdk, glayer1, glayer2, rule"
VIEWS["glayers"] = """
SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS pdk,
       CASE p_partkey % 10 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' WHEN 2 THEN 'met2' WHEN 3 THEN 'poly' WHEN 4 THEN 'pad'
            WHEN 5 THEN 'active_diff' ELSE concat('extra', p_partkey % 10) END AS glayer,
       CASE WHEN p_size % 3 > 0 THEN concat('L', p_size % 6) END AS layer_name,
       CASE WHEN p_size % 3 = 0 THEN p_size % 4 END AS number, CASE WHEN p_size % 3 = 0 THEN 20 END AS datatype, p_partkey AS ord
FROM {part}
"""
VIEWS["layers"] = """
SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS pdk, concat('L', p_partkey % 10) AS layer_name,
       CAST(p_partkey % 4 AS INTEGER) AS number, 20 AS datatype, p_partkey AS ord FROM {part}
"""


def _rules(spark, sf):
    rows = view(spark, sf, "rule_rows")
    return rows.groupBy("pdk", "glayer1", "glayer2", "rule").agg(F.max("value").alias("value"))


SHEET = """
SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS sheet, p_partkey % 30 + 3 AS row_no,
       concat(CASE CAST(floor(p_partkey % 30 / 3) AS INTEGER) % 3 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' ELSE 'met2' END, CAST(CAST(floor(p_partkey % 30 / 3) AS BIGINT) AS VARCHAR), ',',
              CASE p_size % 5 WHEN 0 THEN concat('"s, min_width = ', p_size, '.5"') WHEN 1 THEN '' WHEN 2 THEN concat('"s,min_sep=', p_size, '"') WHEN 3 THEN 'lonely=1' ELSE '"s,fixme"' END, ',',
              CASE p_size % 3 WHEN 0 THEN concat('"c,cap=(', p_size, ',', p_size % 7, ')"') WHEN 1 THEN concat('"c,min_enc=.', p_size, '"') ELSE '' END, ',') AS line
FROM {part}
UNION ALL SELECT DISTINCT CAST(floor(p_partkey / 30) AS BIGINT), CAST(0 AS BIGINT), 'name,met1,poly,via1' FROM {part}
UNION ALL SELECT DISTINCT CAST(floor(p_partkey / 30) AS BIGINT), CAST(1 AS BIGINT), 'label,"a,b",c,d' FROM {part}
"""


@query(
    "rule_sheet_to_long",
    """
WITH p AS (SELECT *, p_partkey // 30 AS sheet, (p_partkey % 30) // 3 AS g FROM part),
n AS (SELECT *, concat(CASE g % 3 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' ELSE 'met2' END, g) AS glayer1 FROM p),
c AS (SELECT sheet, g, glayer1, p_partkey, 'met1' AS glayer2, CASE p_size % 5 WHEN 0 THEN 'min_width' WHEN 2 THEN 'min_sep' WHEN 3 THEN 'lonely' ELSE 'fixme' END AS rule,
       CASE p_size % 5 WHEN 0 THEN p_size + CAST(0.5 AS DOUBLE) WHEN 2 THEN p_size WHEN 3 THEN 1 END AS value, CAST(NULL AS VARCHAR) AS text_value,
       CASE p_size % 5 WHEN 3 THEN 'no comma' WHEN 4 THEN 'no value' END AS problem FROM n WHERE p_size % 5 <> 1
 UNION ALL SELECT sheet, g, glayer1, p_partkey, 'poly', CASE p_size % 3 WHEN 0 THEN 'cap' ELSE 'min_enc' END,
       CASE p_size % 3 WHEN 1 THEN CAST(concat('.', p_size) AS DOUBLE) END, CASE p_size % 3 WHEN 0 THEN concat(p_size, ',', p_size % 7) END, NULL FROM n WHERE p_size % 3 < 2)
SELECT sheet, glayer1, glayer2, rule, value, text_value, problem FROM c
QUALIFY row_number() OVER (PARTITION BY sheet, g, glayer2, rule ORDER BY p_partkey DESC) = 1""",
)
def _(spark, sf):
    return rules.rule_sheet_to_long(run_sql(spark, sf, SHEET.replace("AS VARCHAR", "AS STRING")))


@query("rules_long", with_views("rule_rows") + "SELECT ord, pdk, glayer1, glayer2, rule, value FROM rule_rows WHERE ord % 6 <> 0")
def _(spark, sf):
    rows = view(spark, sf, "rule_rows")
    inner = F.when(F.col("ord") % 6 != 0, F.create_map("rule", "value"))
    nested = rows.select("ord", "pdk", F.create_map("glayer1", F.create_map("glayer2", inner)).alias("rules"))
    return rules.rules_long(nested, "rules", "ord", "pdk")


PAIRS = """
SELECT p_partkey AS pair_id, CAST(floor(p_partkey / 40) AS BIGINT) AS pdk,
       CASE p_partkey % 3 WHEN 0 THEN 'met1' WHEN 1 THEN 'via1' ELSE 'poly' END AS glayer1,
       CASE p_size % 4 WHEN 0 THEN 'met1' WHEN 1 THEN 'met2' WHEN 2 THEN 'active_diff' END AS glayer2 FROM {part}
"""


@query(
    "rule_lookup",
    with_views("rule_rows", "rules", pairs=PAIRS) + """
, q AS (SELECT pair_id, pdk, glayer1 AS a, COALESCE(glayer2, glayer1) AS b FROM pairs)
SELECT pair_id, rule, value FROM q LEFT JOIN rules r ON r.pdk = q.pdk AND (
   (r.glayer1 = a AND r.glayer2 = b) OR (r.glayer1 = b AND r.glayer2 = a AND NOT EXISTS (SELECT 1 FROM rules s WHERE s.pdk = q.pdk AND s.glayer1 = a AND s.glayer2 = b)))""",
)
def _(spark, sf):
    got = rules.rule_lookup(run_sql(spark, sf, PAIRS), _rules(spark, sf))
    return got.select("pair_id", F.explode_outer("rules").alias("rule", "value"))


@query(
    "max_separation",
    with_views("rule_rows", "rules") + """
SELECT pdk, CAST(ceil(CAST(max(value) AS DECIMAL(24,9)) / CAST(0.01 AS DECIMAL(18,6))) * 10 AS BIGINT) AS thousandths FROM rules
WHERE glayer1 = glayer2 AND glayer1 IN ('met1', 'met2', 'met3') AND rule = 'min_separation' GROUP BY pdk""",
)
def _(spark, sf):
    got = rules.max_separation(_rules(spark, sf), 3, 0.005)
    return got.select("pdk", (F.col("max_separation") * 1000).cast("long").alias("thousandths"))


WANTED = "SELECT p_partkey AS ask, CAST(floor(p_partkey / 10) AS BIGINT) AS pdk, CASE p_size % 4 WHEN 0 THEN 'met1' WHEN 1 THEN 'pad' WHEN 2 THEN 'via1' ELSE 'met9' END AS glayer FROM {part}"


@query(
    "resolve_layer",
    with_views("glayers", "layers", wanted=WANTED) + """
SELECT ask, w.pdk, w.glayer, COALESCE(g.number, l.number) AS number, COALESCE(g.datatype, l.datatype) AS datatype FROM wanted w
LEFT JOIN glayers g ON g.pdk = w.pdk AND g.glayer = w.glayer LEFT JOIN layers l ON l.pdk = w.pdk AND l.layer_name = g.layer_name""",
)
def _(spark, sf):
    return rules.resolve_layer(run_sql(spark, sf, WANTED), view(spark, sf, "glayers"), view(spark, sf, "layers"))


TUPLES = "SELECT p_partkey AS ask, CAST(floor(p_partkey / 10) AS BIGINT) AS pdk, p_size % 5 AS number, 20 AS datatype FROM {part}"


@query(
    "reverse_layer",
    with_views("glayers", "layers", tuples=TUPLES) + """
SELECT ask, t.pdk, t.number, t.datatype, COALESCE(
  (SELECT arg_max(glayer, ord) FROM glayers g WHERE g.pdk = t.pdk AND g.number = t.number AND g.datatype = t.datatype),
  (SELECT arg_max(glayer, ord) FROM glayers g WHERE g.pdk = t.pdk AND g.layer_name =
      (SELECT arg_max(layer_name, ord) FROM layers l WHERE l.pdk = t.pdk AND l.number = t.number AND l.datatype = t.datatype))) AS glayer
FROM tuples t""",
)
def _(spark, sf):
    return rules.reverse_layer(run_sql(spark, sf, TUPLES), view(spark, sf, "glayers"), view(spark, sf, "layers"))


VALID = ["met1", "via1", "met2", "poly", "pad", "active_diff", "extra6", "extra7"]


@query(
    "missing_layers",
    with_views("glayers", wanted=WANTED) + f"""
SELECT DISTINCT pdk, glayer, 'not mapped' AS problem FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM glayers g WHERE g.pdk = w.pdk AND g.glayer = w.glayer)
UNION ALL SELECT DISTINCT pdk, glayer, 'not valid' FROM glayers WHERE glayer NOT IN {tuple(VALID)}""",
)
def _(spark, sf):
    return rules.missing_layers(run_sql(spark, sf, WANTED), view(spark, sf, "glayers"), VALID)


@query(
    "routable_layers",
    with_views("glayers") + "SELECT pdk, glayer FROM glayers WHERE contains(glayer, 'met') OR contains(glayer, 'active') OR contains(glayer, 'poly')",
)
def _(spark, sf):
    return rules.routable_layers(view(spark, sf, "glayers").select("pdk", "glayer"))


@query(
    "rule_graph_edges",
    with_views("rule_rows", "rules") + """
SELECT pdk, glayer1, glayer2, rule, CASE WHEN contains(rule, 'min_separ') THEN 'separation' WHEN contains(rule, 'min_enclos') THEN 'enclosure'
       WHEN contains(rule, 'width') THEN 'width' ELSE 'other' END AS edge_class FROM rules""",
)
def _(spark, sf):
    return rules.rule_graph_edges(_rules(spark, sf))
