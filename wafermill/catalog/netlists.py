"""Queries over netlist tables."""

from pyspark.sql import functions as F

from wafermill.catalog import ORACLES, query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import netlist
from wafermill.session import scratch_path

# Three libraries of subcircuits: one per order, its line items are the instances.
VIEWS["netlist"] = """
SELECT concat('lib', o_orderkey % 3) AS path, o_orderkey * 10 * 1000000000 AS line_no,
       concat('.subckt cell_', o_orderkey, ' A', o_custkey % 5, ' B VDD') AS line FROM {orders}
UNION ALL SELECT concat('lib', l_orderkey % 3), (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000,
       concat(CASE l_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'R' WHEN 2 THEN 'c' ELSE 'X' END, l_partkey, ' n', l_linenumber, ' B  floating', l_suppkey % 4,
              CASE WHEN l_suppkey % 2 = 0 THEN ' cell_' ELSE ' nfet_lvt' END, l_partkey % 60, ' w=', l_suppkey, ' l=0.5', CASE WHEN l_partkey % 5 = 0 THEN ' ad=1 pd=2p' ELSE '' END) FROM {lineitem}
UNION ALL SELECT concat('lib', o_orderkey % 3), (o_orderkey * 10 + 9) * 1000000000,
       CASE WHEN o_custkey % 7 = 0 THEN '.ends' ELSE concat('.ends cell_', o_orderkey) END FROM {orders}
"""
CHUNK = 10**14


@query(
    "netlist_instances",
    """
SELECT concat('lib', l_orderkey % 3) AS path, concat('cell_', l_orderkey) AS subckt,
       concat(CASE l_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'R' WHEN 2 THEN 'c' ELSE 'X' END, l_partkey) AS inst,
       concat('n', l_linenumber, ' B floating', l_suppkey % 4) AS nets, concat(CASE WHEN l_suppkey % 2 = 0 THEN 'cell_' ELSE 'nfet_lvt' END, l_partkey % 60) AS model,
       CAST(l_suppkey AS VARCHAR) AS w, CASE WHEN l_partkey % 5 = 0 THEN '2p' END AS pd FROM lineitem""",
)
def _(spark, sf):
    got = netlist.netlist_instances(view(spark, sf, "netlist"), CHUNK)
    return got.select(
        "path", "subckt", "inst", F.array_join("nets", " ").alias("nets"), "model",
        F.col("params")["w"].alias("w"), F.col("params")["pd"].alias("pd"),
    )


@query(
    "netlist_name",
    "SELECT concat('lib', o_orderkey % 3) AS path, concat('cell_', min(o_orderkey)) AS circuit_name FROM orders GROUP BY 1",
)
def _(spark, sf):
    return netlist.netlist_name(view(spark, sf, "netlist"))


@query(
    "top_design_name",
    """SELECT concat('lib', o_orderkey % 3) AS path, CASE WHEN arg_max(o_custkey, o_orderkey) % 7 <> 0 THEN concat('cell_', max(o_orderkey)) END AS top FROM orders GROUP BY 1""",
)
def _(spark, sf):
    return netlist.top_design_name(view(spark, sf, "netlist"))


@query(
    "connection_table",
    """
WITH i AS (SELECT l_orderkey, l_partkey % 60 AS child, l_orderkey % 3 AS lib, concat(CASE l_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'R' WHEN 2 THEN 'c' ELSE 'X' END, l_partkey) AS inst,
   ['n' || l_linenumber, 'B', 'floating' || (l_suppkey % 4)] AS nets FROM lineitem WHERE l_suppkey % 2 = 0),
k AS (SELECT i.*, concat('A', o_custkey % 5) AS first_pin FROM i JOIN orders ON o_orderkey = child AND o_orderkey % 3 = lib)
SELECT concat('lib', lib) AS path, concat('cell_', l_orderkey) AS subckt, inst, concat('cell_', child) AS child, CAST(p AS INTEGER) AS pos,
       CASE p WHEN 0 THEN first_pin WHEN 1 THEN 'B' ELSE 'VDD' END AS pin, nets[p + 1] AS net FROM k CROSS JOIN range(3) t(p)""",
)
def _(spark, sf):
    lines = view(spark, sf, "netlist")
    got = netlist.connection_table(netlist.netlist_instances(lines, CHUNK), netlist.subcircuits(lines))
    return got.select("path", "subckt", "inst", "child", "pos", "pin", "net")


MODELS = [("nfet_lvt1", "nslow"), ("nfet_lvt", "nfast")]


@query(
    "normalise_netlist_lines",
    with_views("netlist") + r"""
, a AS (SELECT *, replace(replace(line, 'nfet_lvt1', 'nslow'), 'nfet_lvt', 'nfast') AS n FROM netlist),
b AS (SELECT *, CASE WHEN contains(n, 'nslow') OR contains(n, 'nfast') THEN concat('M', substring(n, 2)) ELSE n END AS m FROM a),
c AS (SELECT *, CASE WHEN contains(lower(line), '.subckt') AND contains(line, 'A3') THEN '.subckt top AVSS' ELSE m END AS h FROM b),
d AS (SELECT *, CASE WHEN contains(line, 'floating') OR lower(line[1]) IN ('c', 'r') THEN concat('* ', h) ELSE h END AS f FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(f, 'ad=(\S*)', '', 'g'), 'pd=(\S*)', '', 'g') AS g FROM d)
SELECT path, line_no, regexp_replace(regexp_replace(g, '(w=)([0-9.]+)(\s|$)', '\1\2u\3', 'g'), '(l=)([0-9.]+)(\s|$)', '\1\2u\3', 'g') AS line FROM e""",
)
def _(spark, sf):
    return netlist.normalise_netlist_lines(
        view(spark, sf, "netlist"), MODELS, [".subckt", "a3"], ".subckt top AVSS", drop_parasitics=True, micron_units=True
    )


TREE = with_views("hierarchy", recursive=True)[:-1]


@query(
    "expand_hierarchy",
    TREE + """, w AS (SELECT child AS node, concat('chip/', child) AS path, n, 1 AS depth FROM hierarchy WHERE parent = 'chip'
  UNION ALL SELECT h.child, concat(w.path, '/', h.child), w.n * h.n, w.depth + 1 FROM w JOIN hierarchy h ON h.parent = w.node)
SELECT node, path, n, depth FROM w""",
)
def _(spark, sf):
    return netlist.expand_hierarchy(view(spark, sf, "hierarchy"), "chip")


@query(
    "device_totals",
    TREE + """, w AS (SELECT parent AS ancestor, child AS node, n FROM hierarchy
  UNION ALL SELECT w.ancestor, h.child, w.n * h.n FROM w JOIN hierarchy h ON h.parent = w.node)
SELECT ancestor, node, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY ancestor, node""",
)
def _(spark, sf):
    return netlist.device_totals(view(spark, sf, "hierarchy"))


DEVICES = """
SELECT p_partkey, p_size % 5 + 1 AS fingers, CAST(p_partkey % 2 + 1 AS INTEGER) AS multipliers, CAST(p_partkey % 3 AS INTEGER) AS dummies, p_size AS width, p_size % 4 AS length FROM {part}
"""


@query(
    "device_rows",
    with_views(dev=DEVICES) + """
SELECT p_partkey, concat('XMAIN', i + 1) AS inst, 'D G S B' AS nets, length, width FROM dev, LATERAL (SELECT unnest(range(fingers * multipliers)) AS i)
UNION ALL SELECT p_partkey, concat('XDUMMY', i + 1), 'B B B B', length, width FROM dev, LATERAL (SELECT unnest(range(dummies * multipliers)) AS i)""",
)
def _(spark, sf):
    return netlist.device_rows(run_sql(spark, sf, DEVICES), "p_partkey")


DEFINITIONS = """
SELECT l_suppkey AS netlist, concat('m', l_partkey % 3) AS name, concat('.subckt m', l_partkey % 3, ' q', CAST(l_quantity AS BIGINT) % 8) AS text, l_orderkey AS pos FROM {lineitem}
"""


@query(
    "unique_subcircuits",
    with_views(defs=DEFINITIONS) + """
, o AS (SELECT netlist, name, text, min(pos) AS first FROM defs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY netlist, name ORDER BY first, text) AS k FROM o)
SELECT netlist, name, text, first, CASE WHEN k = 1 THEN name ELSE concat(name, '_', k - 1) END AS unique_name FROM r""",
)
def _(spark, sf):
    return netlist.unique_subcircuits(run_sql(spark, sf, DEFINITIONS))


OWN = "SELECT l_partkey AS netlist, concat('net', l_suppkey % 9) AS node FROM {lineitem}"
CHILDREN = "SELECT p_partkey AS netlist, p_partkey + p_size AS child FROM {part}"


@query(
    "global_nodes",
    with_views(own=OWN, kids=CHILDREN) + "SELECT netlist, node FROM own UNION SELECT k.netlist, o.node FROM kids k JOIN own o ON o.netlist = k.child",
)
def _(spark, sf):
    return netlist.global_nodes(run_sql(spark, sf, OWN), run_sql(spark, sf, CHILDREN))


WIRES = """
SELECT l_suppkey AS netlist, concat('i', l_partkey % 997, '.', l_linenumber) AS pin_a, concat('i', l_orderkey % 1009, '.', l_linenumber % 7) AS pin_b
FROM {lineitem}
"""


@query(
    "name_wires",
    with_views(wires=WIRES, recursive=True)[:-1] + """
, p AS (SELECT netlist, pin_a AS a, pin_b AS b FROM wires UNION SELECT netlist, pin_b, pin_a FROM wires UNION SELECT netlist, pin_a, pin_a FROM wires UNION SELECT netlist, pin_b, pin_b FROM wires),
reach AS (SELECT netlist, a, b FROM p UNION SELECT r.netlist, r.a, p.b FROM reach r JOIN p ON p.netlist = r.netlist AND p.a = r.b),
l AS (SELECT netlist, a AS pin, min(b) AS label FROM reach GROUP BY 1, 2)
SELECT netlist, pin, concat('wire', dense_rank() OVER (PARTITION BY netlist ORDER BY label) - 1) AS wire FROM l""",
)
def _(spark, sf):
    return netlist.name_wires(run_sql(spark, sf, WIRES))


@query(
    "render_subcircuits",
    """
SELECT o_custkey % 10 AS netlist, 1 AS part, o_orderkey AS def_no, CAST(-1 AS BIGINT) AS line_no, concat('.subckt cell_', o_orderkey, ' A B') AS line FROM orders
UNION ALL SELECT o_custkey % 10, 1, o_orderkey, 4611686018427387904, concat('.ends cell_', o_orderkey) FROM orders
UNION ALL SELECT o_custkey % 10, 1, o_orderkey, l_linenumber, concat('X', l_partkey, ' n', l_suppkey, ' B m', l_partkey % 3) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT o_custkey % 10, 0, 0, 0, concat('.global ', string_agg(DISTINCT concat('g', o_orderkey % 3), ' ' ORDER BY concat('g', o_orderkey % 3))) FROM orders GROUP BY 1""",
)
def _(spark, sf):
    return _rendered(spark, sf)


def _rendered(spark, sf):
    heads = run_sql(spark, sf, "SELECT o_custkey % 10 AS netlist, o_orderkey AS def_no, concat('cell_', o_orderkey) AS name, array('A', 'B') AS pins FROM {orders}")
    body = run_sql(spark, sf, """
        SELECT o_custkey % 10 AS netlist, o_orderkey AS def_no, CAST(l_linenumber AS BIGINT) AS line_no, CAST(l_partkey AS STRING) AS inst,
               array(concat('n', l_suppkey), 'B') AS nets, concat('m', l_partkey % 3) AS model FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""")
    nodes = run_sql(spark, sf, "SELECT DISTINCT o_custkey % 10 AS netlist, concat('g', o_orderkey % 3) AS node FROM {orders}")
    return netlist.render_subcircuits(nodes, heads, body)


@query("write_netlists", "SELECT netlist, line FROM (" + ORACLES["render_subcircuits"] + ") r")
def _(spark, sf):
    """The netlists as text files, read back; ``tests/test_sinks.py`` looks at the order of lines."""
    path = scratch_path(spark, "netlists")
    netlist.write_netlists(_rendered(spark, sf), path)
    return spark.read.schema("value string, netlist bigint").text(path).select("netlist", F.col("value").alias("line"))
