"""Queries over rectangle tables: measures, transforms, boolean layers."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import boolean, rules, shapes

BOX_COLUMNS = "xl, yl, xh, yh"


def slabs(keys, source):
    """Oracle text: union area per key of a CTE with keys and box, by global x slabs."""
    on = " AND ".join(f"r.{k} = s.{k}" for k in keys)
    ks = ", ".join(keys)
    rks = ", ".join(f"r.{k}" for k in keys)
    return f"""
ex_{source} AS (SELECT DISTINCT {ks}, x FROM (SELECT {ks}, xl AS x FROM {source} UNION ALL SELECT {ks}, xh FROM {source}) e),
sl_{source} AS (SELECT {ks}, x AS x0, lead(x) OVER (PARTITION BY {ks} ORDER BY x) AS x1 FROM ex_{source}),
in_{source} AS (SELECT DISTINCT {rks}, s.x0, s.x1, r.yl, r.yh FROM {source} r JOIN sl_{source} s ON {on} AND r.xl <= s.x0 AND s.x0 < r.xh),
mx_{source} AS (SELECT *, max(yh) OVER (PARTITION BY {ks}, x0 ORDER BY yl, yh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM in_{source}),
gp_{source} AS (SELECT *, sum(CASE WHEN top >= yl THEN 0 ELSE 1 END) OVER (PARTITION BY {ks}, x0 ORDER BY yl, yh ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM mx_{source}),
iv_{source} AS (SELECT {ks}, x0, x1, g, min(yl) AS y0, max(yh) AS y1 FROM gp_{source} GROUP BY {ks}, x0, x1, g),
ar_{source} AS (SELECT {ks}, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM iv_{source} GROUP BY {ks})"""


def shape_view(spark, sf):
    return view(spark, sf, "shapes")


@query("extract_layers", with_views("shapes") + "SELECT shape_id, layer FROM shapes WHERE layer IN ('met1', 'poly')")
def _(spark, sf):
    return shapes.extract_layers(shape_view(spark, sf), ["met1", "poly"]).select("shape_id", "layer")


@query(
    "bbox",
    with_views("shapes") + """
, b AS (SELECT component, layer, min(xl) - 5 AS xl, min(yl) AS yl, max(xh) AS xh, max(yh) + 7 AS yh FROM shapes GROUP BY ALL)
SELECT *, xh - xl AS width, yh - yl AS height, (xl + xh) / CAST(2 AS DOUBLE) AS cx, (yl + yh) / CAST(2 AS DOUBLE) AS cy, (xh - xl) / CAST(2 AS DOUBLE) AS to_west_east, (yh - yl) / CAST(2 AS DOUBLE) AS to_south_north FROM b""",
)
def _(spark, sf):
    return shapes.bbox(shape_view(spark, sf), ["component", "layer"], {"left": 5, "top": 7})


@query(
    "component_area",
    with_views("shapes") + "," + slabs(["component", "layer"], "shapes") + """
SELECT a.component, a.layer, CAST(sum((xh - xl) * (yh - yl)) AS BIGINT) AS drawn, any_value(area) AS merged FROM shapes s JOIN ar_shapes a ON a.component = s.component AND a.layer = s.layer GROUP BY 1, 2""",
)
def _(spark, sf):
    rows, by = shape_view(spark, sf), ["component", "layer"]
    drawn = shapes.component_area(rows, by).withColumnRenamed("area", "drawn")
    return drawn.join(shapes.component_area(rows, by, merged=True).withColumnRenamed("area", "merged"), by)


MIRROR = """
plain AS (SELECT component, 'p' AS side, xl, yl, xh, yh FROM shapes),
mx AS (SELECT component, -xh AS xl, yl, -xl AS xh, yh FROM shapes), my AS (SELECT component, xl, -yh AS yl, xh, -yl AS yh FROM shapes),
both_x AS (SELECT component, xl, yl, xh, yh FROM shapes UNION ALL SELECT * FROM mx), both_y AS (SELECT component, xl, yl, xh, yh FROM shapes UNION ALL SELECT * FROM my),
"""


@query(
    "symmetry_scores",
    with_views("shapes") + "," + MIRROR + slabs(["component"], "shapes") + "," + slabs(["component"], "both_x") + "," + slabs(["component"], "both_y") + """
, d AS (SELECT component, CAST(sum((xh - xl) * (yh - yl)) AS BIGINT) AS area FROM shapes GROUP BY 1)
SELECT d.component, d.area, round(1 - (2 * x.area - 2 * s.area) / CAST(d.area AS DOUBLE), 9) AS symmetry_horizontal, round(1 - (2 * y.area - 2 * s.area) / CAST(d.area AS DOUBLE), 9) AS symmetry_vertical
FROM d JOIN ar_shapes s USING (component) JOIN ar_both_x x USING (component) JOIN ar_both_y y USING (component)""",
)
def _(spark, sf):
    got = shapes.symmetry_scores(shape_view(spark, sf), ["component"])
    return got.select(
        "component", "area", F.round("symmetry_horizontal", 9).alias("symmetry_horizontal"),
        F.round("symmetry_vertical", 9).alias("symmetry_vertical"),
    )


@query(
    "move_shapes",
    with_views("shapes") + """
, b AS (SELECT component, min(xl) AS xl, min(yl) AS yl, max(xh) AS xh, max(yh) AS yh FROM shapes GROUP BY 1),
m AS (SELECT component, CASE WHEN component < 3 THEN CAST(floor(component * 10 - (xl + xh) / CAST(2 AS DOUBLE)) AS BIGINT) ELSE 0 END AS dx,
             CASE WHEN component < 3 THEN CAST(floor(0 - (yl + yh) / CAST(2 AS DOUBLE)) AS BIGINT) ELSE 0 END AS dy FROM b)
SELECT shape_id, s.xl + dx + 3 AS xl, s.yl + dy - 2 AS yl, s.xh + dx + 3 AS xh, s.yh + dy - 2 AS yh FROM shapes s JOIN m USING (component)""",
)
def _(spark, sf):
    rows = shape_view(spark, sf)
    names = rows.select("component").distinct()
    targets = names.where("component < 3").select("component", (F.col("component") * 10).alias("x"), F.lit(None).cast("long").alias("y"))
    centred = shapes.move_shapes(rows, targets, to_centre=True)
    shifted = shapes.move_shapes(centred, names.select("component", F.lit(3).alias("dx"), F.lit(-2).alias("dy")))
    return shifted.select("shape_id", "xl", "yl", "xh", "yh")


@query(
    "snap_up",
    """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(24,9)) - 30000 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(sign(x) * ceil(abs(x) * 100) AS BIGINT) AS steps2,
       CAST(sign(x) * ceil(abs(x) * 50) AS BIGINT) AS steps4 FROM v""",
)
def _(spark, sf):
    rows = run_sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(24,9)) - 30000 AS x FROM {lineitem}")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (rules.snap_up(F.col("x"), 0.005) * 100).cast("long").alias("steps2"),
        (rules.snap_up(F.col("x"), 0.005, 4) * 50).cast("long").alias("steps4"),
    )


@query(
    "array_copy",
    with_views("shapes") + """
, b AS (SELECT component, max(xh) - min(xl) + 10 AS px, max(yh) - min(yl) + 20 AS py FROM shapes GROUP BY 1)
SELECT shape_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, xl + c * px AS xl, yl + r * py AS yl, xh + c * px AS xh, yh + r * py AS yh, concat('row', r, '_col', c, '_') AS port_prefix
FROM shapes s JOIN b USING (component), LATERAL (SELECT unnest(range(component % 2 + 1)) AS r), LATERAL (SELECT unnest(range(2)) AS c)""",
)
def _(spark, sf):
    rows = shape_view(spark, sf)
    plan = rows.select("component").distinct().select(
        "component", (F.col("component") % 2 + 1).alias("rows"), F.lit(2).alias("cols"), F.lit(10).alias("dx"), F.lit(20).alias("dy")
    )
    return shapes.array_copy(rows, plan).drop("component", "layer")


@query(
    "perimeter_ports",
    with_views("shapes") + """
, b AS (SELECT component, min(xl) AS xl, min(yl) AS yl, max(xh) AS xh, max(yh) AS yh FROM shapes WHERE layer = 'met2' GROUP BY 1), h AS (SELECT *, CAST(2 AS DOUBLE) AS two FROM b)
SELECT component, 'met2' AS layer, '_W' AS name, yh - yl AS width, 180 AS orientation, CAST(xl AS DOUBLE) AS cx, (yl + yh) / two AS cy FROM h
UNION ALL SELECT component, 'met2', '_N', xh - xl, 90, (xl + xh) / two, yh FROM h UNION ALL SELECT component, 'met2', '_E', yh - yl, 0, xh, (yl + yh) / two FROM h
UNION ALL SELECT component, 'met2', '_S', xh - xl, 270, (xl + xh) / two, yl FROM h""",
)
def _(spark, sf):
    return shapes.perimeter_ports(shape_view(spark, sf), "met2")


@query(
    "chip_totals",
    with_views("shapes") + "SELECT component, (max(xh) - min(xl)) * (max(yh) - min(yl)) AS extent_area, count(*) AS n_shapes FROM shapes GROUP BY component",
)
def _(spark, sf):
    return shapes.chip_totals(shape_view(spark, sf), ["component"])


@query(
    "cell_select",
    with_views("shapes") + "SELECT shape_id, 'in' AS kind FROM shapes WHERE shape_id % 7 IN (1, 2) UNION ALL SELECT shape_id, 'out' FROM shapes WHERE shape_id % 7 NOT IN (1, 2)",
)
def _(spark, sf):
    rows = shape_view(spark, sf).withColumn("cell", F.concat(F.lit("cell_"), F.col("shape_id") % 7))
    hit = shapes.cell_select(rows, "cell_1|.*_2").select("shape_id", F.lit("in").alias("kind"))
    return hit.union(shapes.cell_select(rows, "cell_1|.*_2", inside=False).select("shape_id", F.lit("out").alias("kind")))


AB = """
la AS (SELECT component, xl, yl, xh, yh FROM shapes WHERE layer IN ('met1', 'poly')), lb AS (SELECT component, xl, yl, xh, yh FROM shapes WHERE layer IN ('met2', 'via1')),
lu AS (SELECT * FROM la UNION ALL SELECT * FROM lb),
""" + slabs(["component"], "la") + "," + slabs(["component"], "lb") + "," + slabs(["component"], "lu")


def _ab(spark, sf):
    rows = shape_view(spark, sf)
    return shapes.extract_layers(rows, ["met1", "poly"]), shapes.extract_layers(rows, ["met2", "via1"])


def _area(rects):
    return rects.groupBy("component").agg(F.sum(boolean.rect_area()).alias("area"))


for _name, _expr in {"layer_and": "a.area + b.area - u.area", "layer_or": "u.area", "layer_not": "u.area - b.area"}.items():
    @query(
        _name,
        with_views("shapes") + "," + AB + f" SELECT component, CAST({_expr} AS BIGINT) AS area FROM ar_la a JOIN ar_lb b USING (component) JOIN ar_lu u USING (component)",
    )
    def _(spark, sf, name=_name):
        return _area(getattr(boolean, name)(*_ab(spark, sf), ["component"]))
