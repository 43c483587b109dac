"""Queries over spatial predicates, rule checks and nets."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import run_sql, view, with_views
from wafermill.catalog.shapes import shape_view, slabs
from wafermill.operators import boundary, nets, spatial

CL = ["component", "layer"]
# Distinct rectangles with the smallest id of their copies.
RECTS = "rects AS (SELECT component, layer, xl, yl, xh, yh, min(shape_id) AS id, count(*) AS copies FROM shapes GROUP BY ALL)"
TOUCH = "a.xl <= b.xh AND b.xl <= a.xh AND a.yl <= b.yh AND b.yl <= a.yh"
DX = "greatest(0, a.xl - b.xh, b.xl - a.xh)"
DY = "greatest(0, a.yl - b.yh, b.yl - a.yh)"
GAP2 = f"({DX} * {DX} + {DY} * {DY})"
NEAR = "a.xl - {d} <= b.xh AND b.xl - {d} <= a.xh AND a.yl - {d} <= b.yh AND b.yl - {d} <= a.yh"
MARGIN = "least(b.xl - a.xl, b.yl - a.yl, a.xh - b.xh, a.yh - b.yh)"
HEAD = with_views("shapes") + ", " + RECTS
RHEAD = with_views("shapes", recursive=True) + ", " + RECTS
# Merged shapes: smallest id reached over touching rectangles of one layer.
LABELS = f""", touch AS (SELECT a.id AS u, b.id AS v FROM rects a JOIN rects b ON a.component = b.component AND a.layer = b.layer AND {TOUCH}),
reach AS (SELECT u, v FROM touch UNION SELECT r.u, t.v FROM reach r JOIN touch t ON t.u = r.v), labels AS (SELECT u AS id, min(v) AS label FROM reach GROUP BY u)
"""


def on(spark, sf, *layers):
    return shape_view(spark, sf).where(F.col("layer").isin(*layers))


def runs(width, gaps):
    """Oracle text: area of merged runs (or gaps) below a width, per direction."""
    turned = "tur AS (SELECT component, layer, yl AS xl, xl AS yl, yh AS xh, xh AS yh FROM shapes)"
    parts = []
    for d, src in (("y", "shapes"), ("x", "tur")):
        rows = f"iv_{src}"
        if gaps:
            rows = f"(SELECT component, layer, x0, x1, y1 AS y0, lead(y0) OVER (PARTITION BY component, layer, x0 ORDER BY y0) AS y1 FROM iv_{src})"
        parts.append(f"SELECT component, layer, '{d}' AS direction, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM {rows} g WHERE y1 - y0 < {width} GROUP BY 1, 2")
    return with_views("shapes") + ", " + turned + "," + slabs(CL, "shapes") + "," + slabs(CL, "tur") + " " + " UNION ALL ".join(parts)


def _run_area(found):
    return found.groupBy("component", "layer", "direction").agg(F.sum((F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))).alias("area"))


@query("min_width", runs(30, False))
def _(spark, sf):
    return _run_area(spatial.min_width(shape_view(spark, sf), CL, 30))


@query("notches", runs(25, True))
def _(spark, sf):
    return _run_area(spatial.notches(shape_view(spark, sf), CL, 25))


def whole_runs(source, xl, yl, xh, yh):
    """Oracle text: merged runs narrower than their rule; slabs side by side with one run are one box."""
    return f"""wr_{source} AS (SELECT component, layer, y0, y1, min(x0) AS x0, max(x1) AS x1 FROM (
  SELECT *, sum(new) OVER (PARTITION BY component, layer, y0, y1 ORDER BY x0) AS box FROM (
    SELECT *, CASE WHEN lag(x1) OVER (PARTITION BY component, layer, y0, y1 ORDER BY x0) = x0 THEN 0 ELSE 1 END AS new FROM iv_{source}) n) g GROUP BY component, layer, y0, y1, box),
w_{source} AS (SELECT component, rule, glayer1, glayer2, CAST(NULL AS BIGINT) AS a_id, CAST(NULL AS BIGINT) AS b_id, CAST(y1 - y0 AS DOUBLE) AS measured, {xl} AS xl, {yl} AS yl, {xh} AS xh, {yh} AS yh
  FROM wr_{source} JOIN ruleset ON layer = glayer1 AND glayer1 = glayer2 AND rule = 'min_width' WHERE y1 - y0 < value)"""


SPACING = f"SELECT a.component, a.layer, a.id AS a_id, b.id AS b_id, {GAP2} AS gap2 FROM rects a JOIN rects b ON a.component = b.component AND a.layer = b.layer AND a.id < b.id AND {NEAR.format(d=20)}"


@query("min_spacing", RHEAD + LABELS + f", p AS ({SPACING}) SELECT p.* FROM p JOIN labels x ON x.id = a_id JOIN labels y ON y.id = b_id WHERE x.label <> y.label AND gap2 > 0 AND gap2 < 400")
def _(spark, sf):
    return spatial.min_spacing(shape_view(spark, sf), CL, 20)


@query("min_spacing_space", HEAD + f", p AS ({SPACING}) SELECT * FROM p WHERE gap2 > 0 AND gap2 < 400")
def _(spark, sf):
    return spatial.min_spacing(shape_view(spark, sf), CL, 20, "space")


@query(
    "min_separation",
    HEAD + f", p AS (SELECT a.component, a.id AS a_id, b.id AS b_id, {GAP2} AS gap2 FROM rects a JOIN rects b ON a.component = b.component AND a.layer = 'met1' AND b.layer = 'met2' AND {NEAR.format(d=15)}) SELECT * FROM p WHERE gap2 > 0 AND gap2 < 225",
)
def _(spark, sf):
    return spatial.min_separation(on(spark, sf, "met1"), on(spark, sf, "met2"), ["component"], 15)


def enclosed(keys, outer, inner, limit):
    """Oracle text: margins of merged shapes of ``inner`` inside the union of ``outer``.

    What the union leaves free is written out, slab by slab, and every distance is taken to that."""
    ks, far = ", ".join(keys), 10**9
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return slabs(keys, outer).lstrip() + f"""
, free AS (
  SELECT {ks}, x0, x1, COALESCE(lag(y1) OVER (PARTITION BY {ks}, x0 ORDER BY y0), -{far}) AS y0, y0 AS y1 FROM iv_{outer}
  UNION ALL SELECT {ks}, x0, x1, max(y1), {far} FROM iv_{outer} GROUP BY {ks}, x0, x1
  UNION ALL SELECT {ks}, x0, x1, -{far}, {far} FROM sl_{outer} s WHERE x1 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM iv_{outer} i WHERE {on("i", "s")} AND i.x0 = s.x0)
  UNION ALL SELECT {ks}, -{far}, min(x0), -{far}, {far} FROM sl_{outer} GROUP BY {ks} UNION ALL SELECT {ks}, max(x0), {far}, -{far}, {far} FROM sl_{outer} GROUP BY {ks}),
ri AS (SELECT {ks}, xl, yl, xh, yh, min(shape_id) AS id FROM {inner} GROUP BY {ks}, xl, yl, xh, yh),
ti AS (SELECT a.{", a.".join(keys)}, a.id AS u, b.id AS v FROM ri a JOIN ri b ON {on("a", "b")} AND {TOUCH}),
rch AS (SELECT {ks}, u, v FROM ti UNION SELECT r.{", r.".join(keys)}, r.u, t.v FROM rch r JOIN ti t ON {on("r", "t")} AND t.u = r.v), li AS (SELECT {ks}, u AS id, min(v) AS label FROM rch GROUP BY {ks}, u),
mg AS (SELECT b.{", b.".join(keys)}, b.id, min(greatest(b.xl - g.x1, g.x0 - b.xh, b.yl - g.y1, g.y0 - b.yh)) AS m FROM ri b JOIN free g ON {on("b", "g")} GROUP BY b.{", b.".join(keys)}, b.id),
held AS (SELECT mg.{", mg.".join(keys)}, label, min(m) AS margin FROM mg JOIN li ON {on("mg", "li")} AND mg.id = li.id GROUP BY mg.{", mg.".join(keys)}, label HAVING min(m) >= 0 AND min(m) < {limit})
"""


@query(
    "min_enclosure",
    with_views("shapes", recursive=True) + ", outside AS (SELECT * FROM shapes WHERE layer IN ('met1', 'poly', 'met2')), vias AS (SELECT * FROM shapes WHERE layer = 'via1'), "
    + enclosed(["component"], "outside", "vias", 12) + "SELECT component, label, margin FROM held",
)
def _(spark, sf):
    return spatial.min_enclosure(on(spark, sf, "met1", "poly", "met2"), on(spark, sf, "via1"), ["component"], 12)


def merged(name, layers):
    """Oracle text: shapes of some layers with the smallest id of their merged shape, per component."""
    return f"""s{name} AS (SELECT * FROM shapes WHERE layer IN ({layers})), t{name} AS (SELECT a.shape_id AS u, b.shape_id AS v FROM s{name} a JOIN s{name} b ON a.component = b.component AND {TOUCH}),
r{name} AS (SELECT u, v FROM t{name} UNION SELECT r.u, t.v FROM r{name} r JOIN t{name} t ON t.u = r.v),
m{name} AS (SELECT s.*, label FROM s{name} s JOIN (SELECT u, min(v) AS label FROM r{name} GROUP BY u) l ON s.shape_id = l.u)"""


HITS = merged("a", "'met1'") + ", " + merged("b", "'via1', 'met2'") + f""", counts AS (SELECT a.label, count(DISTINCT b.label) AS n FROM ma a JOIN mb b ON a.component = b.component AND {TOUCH} GROUP BY 1),
hits AS (SELECT shape_id, COALESCE(n, 0) AS n FROM ma LEFT JOIN counts USING (label))"""
for _name, _test, _options in (
    ("interacting", "n > 0", {}), ("not_interacting", "n = 0", {"negate": True}), ("interacting_count", "n BETWEEN 2 AND 3", {"least": 2, "most": 3}),
):
    @query(_name, with_views("shapes", recursive=True) + ", " + HITS + f" SELECT shape_id FROM hits WHERE {_test}")
    def _(spark, sf, options=_options):
        got = spatial.interacting(on(spark, sf, "met1"), on(spark, sf, "via1", "met2"), ["component"], **options)
        return got.select("shape_id")


COVER = """, cl AS (SELECT a.shape_id, (a.xh - a.xl) * (a.yh - a.yl) AS size, greatest(a.xl, b.xl) AS xl, greatest(a.yl, b.yl) AS yl, least(a.xh, b.xh) AS xh, least(a.yh, b.yh) AS yh
  FROM shapes a JOIN shapes b ON a.component = b.component AND a.layer = 'via1' AND b.layer <> 'via1' AND a.xl < b.xh AND b.xl < a.xh AND a.yl < b.yh AND b.yl < a.yh),
""" + slabs(["shape_id"], "cl") + """
, cov AS (SELECT s.shape_id, (s.xh - s.xl) * (s.yh - s.yl) AS size, COALESCE(area, 0) AS covered FROM shapes s LEFT JOIN ar_cl c USING (shape_id) WHERE layer = 'via1')
"""
for _name, _test in (("inside", "covered = size"), ("not_inside", "covered < size"), ("outside", "covered = 0"), ("overlapping", "covered > 0")):
    @query(_name, with_views("shapes") + COVER + f" SELECT shape_id FROM cov WHERE {_test}")
    def _(spark, sf, kind=_name):
        return spatial.relation(on(spark, sf, "via1"), on(spark, sf, "met1", "met2", "poly"), ["component"], kind).select("shape_id")


@query(
    "covering",
    with_views("shapes", recursive=True) + ", " + merged("a", "'met1'") + ", " + enclosed(["component"], "sa", "small", 10**9).replace("ri AS", "small AS (SELECT * FROM shapes WHERE layer = 'via1'), ri AS", 1)
    + f", hold AS (SELECT DISTINCT a.label FROM ma a JOIN ri b ON a.component = b.component AND {TOUCH} JOIN li ON li.component = b.component AND li.id = b.id JOIN held h ON h.component = li.component AND h.label = li.label) SELECT shape_id FROM ma JOIN hold USING (label)",
)
def _(spark, sf):
    return spatial.relation(on(spark, sf, "met1"), on(spark, sf, "via1"), ["component"], "covering").select("shape_id")


@query("merge_shapes", RHEAD + LABELS + " SELECT s.shape_id, l.label FROM shapes s JOIN rects r ON r.component = s.component AND r.layer = s.layer AND r.xl = s.xl AND r.yl = s.yl AND r.xh = s.xh AND r.yh = s.yh JOIN labels l ON l.id = r.id")
def _(spark, sf):
    return spatial.merge_shapes(shape_view(spark, sf), CL).select("shape_id", "label")


# Shrinking by 8: what is left of the union after taking away all grown gap rectangles.
SHRINK = """, grown AS (SELECT component, layer, xl - 5 AS xl, yl - 5 AS yl, xh + 5 AS xh, yh + 5 AS yh FROM shapes),
""" + slabs(CL, "grown")


@query("grow", with_views("shapes") + SHRINK + " SELECT component, layer, area FROM ar_grown")
def _(spark, sf):
    from wafermill.operators.boolean import merged_area

    return merged_area(spatial.grow_shrink(shape_view(spark, sf), CL, 5), CL)


@query(
    "grow_shrink",
    with_views("shapes") + ", big AS (SELECT component, layer, min(xl) - 50 AS bx0, min(yl) - 50 AS by0, max(xh) + 50 AS bx1, max(yh) + 50 AS by1 FROM shapes GROUP BY 1, 2), "
    "framed AS (SELECT component, layer, xl, yl, xh, yh FROM shapes UNION ALL SELECT component, layer, bx0, by0, bx1, by0 FROM big UNION ALL SELECT component, layer, bx0, by1, bx1, by1 FROM big), "
    + slabs(CL, "framed").lstrip() + """
, holes AS (SELECT component, layer, x0 - 8 AS xl, y1 - 8 AS yl, x1 + 8 AS xh, lead(y0) OVER (PARTITION BY component, layer, x0 ORDER BY y0) + 8 AS yh FROM iv_framed),
solid AS (SELECT component, layer, xl, yl, xh, yh FROM holes WHERE yh IS NOT NULL),
whole AS (SELECT * FROM solid UNION ALL SELECT component, layer, xl, yl, xh, yh FROM shapes),
""" + slabs(CL, "solid") + "," + slabs(CL, "whole") + " SELECT component, layer, CAST(w.area - s.area AS BIGINT) AS area FROM ar_whole w JOIN ar_solid s USING (component, layer) WHERE w.area > s.area",
)
def _(spark, sf):
    from wafermill.operators.boolean import rect_area

    got = spatial.grow_shrink(shape_view(spark, sf), CL, -8)
    return got.groupBy(CL).agg(F.sum(rect_area()).alias("area"))


# What is left of the union without the grown gaps, inside the extent, grown back.
WIDE = """
, big AS (SELECT component, layer, min(xl) AS bx0, min(yl) AS by0, max(xh) AS bx1, max(yh) AS by1 FROM shapes GROUP BY 1, 2),
framed AS (SELECT component, layer, xl, yl, xh, yh FROM shapes UNION ALL SELECT component, layer, bx0 - 50, by0 - 50, bx1 + 50, by0 - 50 FROM big UNION ALL SELECT component, layer, bx0 - 50, by1 + 50, bx1 + 50, by1 + 50 FROM big), """ + slabs(CL, "framed").lstrip() + """
, holes AS (SELECT component, layer, x0 - 8 AS xl, y1 - 8 AS yl, x1 + 8 AS xh, lead(y0) OVER (PARTITION BY component, layer, x0 ORDER BY y0) + 8 AS yh FROM iv_framed),
solid AS (SELECT component, layer, xl, yl, xh, yh FROM holes WHERE yh IS NOT NULL), """ + slabs(CL, "solid").lstrip() + """
, left_over AS (
  SELECT component, layer, x0 AS xl, COALESCE(lag(y1) OVER w, -1000000) AS yl, x1 AS xh, y0 AS yh FROM iv_solid WINDOW w AS (PARTITION BY component, layer, x0 ORDER BY y0)
  UNION ALL SELECT component, layer, x0, max(y1), x1, 1000000 FROM iv_solid GROUP BY component, layer, x0, x1
  UNION ALL SELECT component, layer, x0, -1000000, x1, 1000000 FROM sl_solid s WHERE x1 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM iv_solid i WHERE i.component = s.component AND i.layer = s.layer AND i.x0 = s.x0)),
wide AS (SELECT l.component, l.layer, greatest(xl, bx0) - 8 AS xl, greatest(yl, by0) - 8 AS yl, least(xh, bx1) + 8 AS xh, least(yh, by1) + 8 AS yh FROM left_over l JOIN big b ON l.component = b.component AND l.layer = b.layer
  WHERE greatest(xl, bx0) < least(xh, bx1) AND greatest(yl, by0) < least(yh, by1)), """ + slabs(CL, "wide").lstrip()


@query("wide_parts", with_views("shapes") + WIDE + " SELECT component, layer, area FROM ar_wide")
def _(spark, sf):
    from wafermill.operators.boolean import merged_area

    return merged_area(spatial.wide_parts(shape_view(spark, sf), CL, 16), CL)


LABELLED = RHEAD + LABELS + """, lab AS (SELECT r.component, r.layer, l.label, r.xl, r.yl, r.xh, r.yh FROM rects r JOIN labels l ON l.id = r.id)"""


@query("area_filter", LABELLED + "," + slabs(["component", "layer", "label"], "lab") + " SELECT component, layer, label, area FROM ar_lab WHERE area >= 2500 AND area < 6000")
def _(spark, sf):
    return spatial.area_filter(shape_view(spark, sf), CL, 2500, 6000)


@query(
    "bbox_filter",
    LABELLED + ", b AS (SELECT component, layer, label, min(xl) AS xl, min(yl) AS yl, max(xh) AS xh, max(yh) AS yh FROM lab GROUP BY 1, 2, 3) SELECT * FROM b WHERE greatest(xh - xl, yh - yl) >= 80 AND greatest(xh - xl, yh - yl) < 130",
)
def _(spark, sf):
    return spatial.bbox_filter(shape_view(spark, sf), CL, 80, 130)


def outline(source, at, pos, low, high):
    """Oracle text: whole boundary edges of a merged layer across one axis, from the slabs along it."""
    return f"""
st_{source} AS (SELECT component, layer, a, p, sum(d) AS d FROM (
  SELECT component, layer, x0 AS a, y0 AS p, 1 AS d FROM iv_{source} UNION ALL SELECT component, layer, x0, y1, -1 FROM iv_{source}
  UNION ALL SELECT component, layer, x1, y0, -1 FROM iv_{source} UNION ALL SELECT component, layer, x1, y1, 1 FROM iv_{source}) e GROUP BY ALL HAVING sum(d) <> 0),
ed_{source} AS (SELECT component, layer, CASE WHEN net > 0 THEN '{low}' ELSE '{high}' END AS side, a AS {at}l, p AS {pos}l, a AS {at}h, q AS {pos}h, q - p AS length FROM (
  SELECT *, sum(d) OVER w AS net, lead(p) OVER w AS q FROM st_{source} WINDOW w AS (PARTITION BY component, layer, a ORDER BY p)) s WHERE net <> 0)"""


EDGES = (
    with_views("shapes") + ", tur AS (SELECT component, layer, yl AS xl, xl AS yl, yh AS xh, xh AS yh FROM shapes)," + slabs(CL, "shapes") + "," + slabs(CL, "tur")
    + "," + outline("shapes", "x", "y", "left", "right") + "," + outline("tur", "y", "x", "bottom", "top")
    + ", edges AS (SELECT component, layer, side, xl, yl, xh, yh, length FROM ed_shapes UNION ALL SELECT component, layer, side, xl, yl, xh, yh, length FROM ed_tur)"
)


@query("edge_length_filter", EDGES + " SELECT * FROM edges WHERE length BETWEEN 25 AND 31")
def _(spark, sf):
    return spatial.edge_length_filter(shape_view(spark, sf), CL, 25, 31)


@query("boundary_edges", EDGES + " SELECT component, layer, side, count(*) AS edges, CAST(sum(length) AS BIGINT) AS length FROM edges GROUP BY ALL")
def _(spark, sf):
    edges = boundary.boundary_edges(shape_view(spark, sf), CL)
    return edges.groupBy(*CL, "side").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("length"))


@query(
    "offgrid",
    with_views("shapes") + """
, c AS (SELECT component, shape_id, layer, unnest([{'corner': 'll', 'x': xl, 'y': yl}, {'corner': 'lr', 'x': xh, 'y': yl}, {'corner': 'ur', 'x': xh, 'y': yh}, {'corner': 'ul', 'x': xl, 'y': yh}]) AS p FROM shapes)
SELECT component, shape_id, layer, p.corner AS corner, p.x AS x, p.y AS y FROM c WHERE p.x % 5 <> 0 OR p.y % 5 <> 0""",
)
def _(spark, sf):
    return spatial.offgrid(shape_view(spark, sf), 5)


@query(
    "overlap_min",
    with_views("shapes") + """
, common AS (SELECT a.component, 'common' AS layer, greatest(a.xl, b.xl) AS xl, greatest(a.yl, b.yl) AS yl, least(a.xh, b.xh) AS xh, least(a.yh, b.yh) AS yh FROM shapes a JOIN shapes b ON a.component = b.component
  AND a.layer IN ('poly', 'met2') AND b.layer IN ('via1', 'met1') AND a.xl < b.xh AND b.xl < a.xh AND a.yl < b.yh AND b.yl < a.yh),
turned AS (SELECT component, layer, yl AS xl, xl AS yl, yh AS xh, xh AS yh FROM common),
ruleset AS (SELECT 'common' AS glayer1, 'common' AS glayer2, 'min_width' AS rule, 10 AS value),""" + slabs(CL, "common") + "," + slabs(CL, "turned") + ",\n"
    + whole_runs("common", "x0", "y0", "x1", "y1") + ", " + whole_runs("turned", "y0", "x0", "y1", "x1") + """
SELECT component, xl, yl, xh, yh, 'y' AS direction, yh - yl AS overlap FROM w_common UNION ALL SELECT component, xl, yl, xh, yh, 'x', xh - xl FROM w_turned""",
)
def _(spark, sf):
    return spatial.overlap_min(on(spark, sf, "poly", "met2"), on(spark, sf, "via1", "met1"), ["component"], 10)


LINKS = [("met1", "via1"), ("via1", "met2")]
NETS = RHEAD + f""", touch AS (SELECT a.id AS u, b.id AS v FROM rects a JOIN rects b ON a.component = b.component AND {TOUCH}
  AND (a.layer = b.layer OR (a.layer IN ('met1', 'via1') AND b.layer IN ('met1', 'via1')) OR (a.layer IN ('met2', 'via1') AND b.layer IN ('met2', 'via1')))),
reach AS (SELECT u, v FROM touch UNION SELECT r.u, t.v FROM reach r JOIN touch t ON t.u = r.v), labels AS (SELECT u AS id, min(v) AS net FROM reach GROUP BY u)
"""


@query("extract_nets", NETS + " SELECT s.shape_id, l.net FROM shapes s JOIN rects r ON r.component = s.component AND r.layer = s.layer AND r.xl = s.xl AND r.yl = s.yl AND r.xh = s.xh AND r.yh = s.yh JOIN labels l ON l.id = r.id")
def _(spark, sf):
    return nets.extract_nets(shape_view(spark, sf), LINKS).select("shape_id", "net")


@query(
    "net_aware_spacing",
    NETS + f""", p AS (SELECT a.component, a.id AS a_id, b.id AS b_id, {GAP2} AS gap2, x.net AS na, y.net AS nb FROM rects a JOIN rects b ON a.component = b.component AND a.layer = 'met1' AND b.layer = 'met2' AND {NEAR.format(d=30)} JOIN labels x ON x.id = a.id JOIN labels y ON y.id = b.id)
SELECT component, a_id, b_id, gap2, 'connected' AS rule FROM p WHERE gap2 > 0 AND gap2 < 144 UNION ALL SELECT component, a_id, b_id, gap2, 'not connected' FROM p WHERE gap2 > 0 AND gap2 < 900 AND na <> nb""",
)
def _(spark, sf):
    return nets.net_aware_spacing(nets.extract_nets(shape_view(spark, sf), LINKS), "met1", "met2", 12, 30)


def density(window, step):
    """Oracle text: union area per window from the global slabs."""
    shift = 0 if window == step else step // 2
    return with_views("shapes") + "," + slabs(CL, "shapes") + f"""
, o AS (SELECT component, layer, min(xl) + {shift} AS ox, min(yl) + {shift} AS oy, max(xh) AS ex, max(yh) AS ey FROM shapes GROUP BY 1, 2),
t AS (SELECT o.*, wx, wy, ox + wx * {step} AS x0, oy + wy * {step} AS y0 FROM o, LATERAL (SELECT unnest(range(CAST(ceil((ex - ox) / CAST({step} AS DOUBLE)) AS BIGINT))) AS wx), LATERAL (SELECT unnest(range(CAST(ceil((ey - oy) / CAST({step} AS DOUBLE)) AS BIGINT))) AS wy)),
c AS (SELECT t.component, t.layer, wx, wy, CAST(sum((least(i.x1, t.x0 + {window}) - greatest(i.x0, t.x0)) * (least(i.y1, t.y0 + {window}) - greatest(i.y0, t.y0))) AS BIGINT) AS covered
  FROM t JOIN iv_shapes i ON i.component = t.component AND i.layer = t.layer AND i.x0 < t.x0 + {window} AND i.x1 > t.x0 AND i.y0 < t.y0 + {window} AND i.y1 > t.y0 GROUP BY 1, 2, 3, 4),
d AS (SELECT t.component, t.layer, t.wx, t.wy, COALESCE(covered, 0) AS covered, COALESCE(covered, 0) / CAST((least(ex, t.x0 + {window}) - t.x0) * (least(ey, t.y0 + {window}) - t.y0) AS DOUBLE) AS density FROM t LEFT JOIN c USING (component, layer, wx, wy))
SELECT component, layer, wx, wy, covered, round(density, 12) AS density FROM d WHERE density < 0.04 OR density > 0.09"""


for _name, _window, _step in (("window_density", 800, 800), ("window_density_sliding", 800, 400)):
    @query(_name, density(_window, _step))
    def _(spark, sf, window=_window, step=_step):
        got = spatial.window_density(shape_view(spark, sf), CL, window, step, 0.04, 0.09)
        return got.withColumn("density", F.round("density", 12))


# Rules from the part table: the last part of a rule and layer pair gives its value.
RULES = """
SELECT glayer1, glayer2, rule, CAST(max(v) AS BIGINT) AS value FROM (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'met1' WHEN 1 THEN 'met2' ELSE 'poly' END AS glayer1,
         CASE WHEN p_partkey % 4 < 2 THEN CASE p_partkey % 3 WHEN 0 THEN 'met1' WHEN 1 THEN 'met2' ELSE 'poly' END ELSE 'via1' END AS glayer2,
         CASE p_partkey % 4 WHEN 0 THEN 'min_width' WHEN 1 THEN 'min_separation' WHEN 2 THEN 'min_separation' ELSE 'min_enclosure' END AS rule, p_size % 22 + 5 AS v
  FROM {part}) r GROUP BY glayer1, glayer2, rule
"""
BOX_OF = ", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in ("xl", "yl", "xh", "yh"))


PAIR = ["component", "glayer1", "glayer2", "value"]
RULED = with_views("shapes", recursive=True, ruleset=RULES) + ", " + RECTS + LABELS + f"""
, tur AS (SELECT component, layer, yl AS xl, xl AS yl, yh AS xh, xh AS yh FROM shapes),{slabs(CL, "shapes")},{slabs(CL, "tur")},
{whole_runs("shapes", "x0", "y0", "x1", "y1")}, {whole_runs("tur", "y0", "x0", "y1", "x1")},
s AS (SELECT a.component, rule, glayer1, glayer2, a.id AS a_id, b.id AS b_id, {GAP2} AS g, value FROM rects a JOIN ruleset ON a.layer = glayer1 AND rule = 'min_separation' JOIN rects b ON b.component = a.component AND b.layer = glayer2 AND (glayer1 <> glayer2 OR a.id < b.id) AND {NEAR.format(d='value')}),
outside AS (SELECT component, glayer1, glayer2, value, xl, yl, xh, yh FROM shapes JOIN ruleset ON layer = glayer1 AND rule = 'min_enclosure' AND glayer1 <> glayer2),
within AS (SELECT component, glayer1, glayer2, value, shape_id, xl, yl, xh, yh FROM shapes JOIN ruleset ON layer = glayer2 AND rule = 'min_enclosure' AND glayer1 <> glayer2),
{enclosed(PAIR, "outside", "within", "any_value(mg.value)")},
found AS (SELECT * FROM w_shapes UNION ALL SELECT * FROM w_tur
UNION ALL SELECT component, rule, glayer1, glayer2, a_id, b_id, round(sqrt(g), 6), {BOX_OF} FROM s JOIN labels x ON x.id = a_id JOIN labels y ON y.id = b_id WHERE g > 0 AND g < value * value AND (glayer1 <> glayer2 OR x.label <> y.label)
UNION ALL SELECT component, 'min_enclosure', glayer1, glayer2, NULL, label, CAST(margin AS DOUBLE), {BOX_OF} FROM held)
"""


@query("check_rule_table", RULED + "SELECT * FROM found")
def _(spark, sf):
    got = spatial.check_rule_table(shape_view(spark, sf), run_sql(spark, sf, RULES))
    return got.withColumn("measured", F.round("measured", 6))


@query(
    "violation_report",
    EDGES + f""", {RECTS}, p AS ({SPACING})
SELECT component, 'm.grid' AS category, 'corner off grid' AS description, 4 * count(*) - count(*) FILTER (xl % 5 = 0 AND yl % 5 = 0) - count(*) FILTER (xh % 5 = 0 AND yl % 5 = 0) - count(*) FILTER (xh % 5 = 0 AND yh % 5 = 0) - count(*) FILTER (xl % 5 = 0 AND yh % 5 = 0) AS violations FROM shapes GROUP BY 1
UNION ALL SELECT component, 'm.space', 'space below 20', count(*) FROM p WHERE gap2 > 0 AND gap2 < 400 GROUP BY 1
UNION ALL SELECT component, 'm.edge', 'edge of 25 to 31', count(*) FROM edges WHERE length BETWEEN 25 AND 31 GROUP BY 1""",
)
def _(spark, sf):
    rows = shape_view(spark, sf)
    return spatial.violation_report({
        "m.grid": ("corner off grid", spatial.offgrid(rows, 5)),
        "m.space": ("space below 20", spatial.min_spacing(rows, CL, 20, "space")),
        "m.edge": ("edge of 25 to 31", spatial.edge_length_filter(rows, CL, 25, 31)),
    }, ["component"])
