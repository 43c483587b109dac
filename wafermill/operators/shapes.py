"""Rectangle tables: measures and transforms.

Shapes are ``(component, shape_id, layer, xl, yl, xh, yh)`` in whole database units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.operators.boolean import boolean_rects, merged_area
from wafermill.plans.attach import attach, null_safe_join


def extract_layers(shapes: DataFrame, layers: list[str]) -> DataFrame:
    """Shapes on the listed layers."""
    return shapes.where(F.col("layer").isin(layers))


def bbox(shapes: DataFrame, by: list[str], padding: dict[str, int] | None = None) -> DataFrame:
    """Bounding box per group with size, centre, and distance from the centre to each edge.

    ``padding`` widens the box: left, right, bottom, top.
    """
    pad = {"left": 0, "right": 0, "bottom": 0, "top": 0} | (padding or {})
    box = shapes.groupBy(*by).agg(
        (F.min("xl") - pad["left"]).alias("xl"), (F.min("yl") - pad["bottom"]).alias("yl"),
        (F.max("xh") + pad["right"]).alias("xh"), (F.max("yh") + pad["top"]).alias("yh"),
    )
    width, height = F.col("xh") - F.col("xl"), F.col("yh") - F.col("yl")
    return box.select(
        "*",
        width.alias("width"),
        height.alias("height"),
        ((F.col("xl") + F.col("xh")) / 2).alias("cx"),
        ((F.col("yl") + F.col("yh")) / 2).alias("cy"),
        (width / 2).alias("to_west_east"),
        (height / 2).alias("to_south_north"),
    )


def component_area(shapes: DataFrame, by: list[str], merged: bool = False) -> DataFrame:
    """Area per group: the sum over all shapes, or with overlaps counted once."""
    if merged:
        return merged_area(shapes, by)
    size = (F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))
    return shapes.groupBy(*by).agg(F.sum(size).alias("area"))


def symmetry_scores(shapes: DataFrame, by: list[str]) -> DataFrame:
    """1 - xor/area against the mirror image about each origin axis; (1, 1) for area 0.

    The horizontal score mirrors x, the vertical one mirrors y. The area counts overlaps
    as often as they are drawn; the xor works on the union.
    """
    area = component_area(shapes, by)
    plain = shapes.select(*by, "xl", "yl", "xh", "yh")
    out = area
    for name, axis in (("horizontal", "x"), ("vertical", "y")):
        # The difference is its own mirror image, so it is measured on one side of the axis: the
        # shapes there against what lies on the other side, folded over.
        low, high = F.col(f"{axis}l"), F.col(f"{axis}h")
        zero = F.lit(0).cast("long")
        here = plain.where(high > 0).withColumn(f"{axis}l", F.greatest(low, zero))
        there = plain.where(low < 0).select(
            *by, *[
                {f"{axis}l": F.greatest(-high, zero), f"{axis}h": -low}.get(c, F.col(c)).alias(c) for c in ("xl", "yl", "xh", "yh")
            ]
        )
        odd = boolean_rects(here, there, by, "xor")
        size = 2 * (F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))
        out = null_safe_join(out, odd.groupBy(*by).agg(F.sum(size).alias(f"_{name}")), by, "left")
    zero = F.col("area") == 0

    def score(name: str) -> Column:
        share = F.coalesce(F.col(f"_{name}"), F.lit(0)) / F.col("area")
        return F.when(zero, 1.0).otherwise(1.0 - share).alias(f"symmetry_{name}")

    return out.select(*by, "area", score("horizontal"), score("vertical"))


def move_shapes(shapes: DataFrame, moves: DataFrame, to_centre: bool = False) -> DataFrame:
    """Shift each component by (dx, dy), or bring its centre to (x, y).

    ``moves`` has one row per component. With ``to_centre`` a null coordinate means 0 and
    half units go down; components without a row stay where they are.
    """
    if to_centre:
        box = bbox(null_safe_join(shapes, moves.select("component").distinct(), ["component"], "left_semi"), ["component"])
        placed = null_safe_join(moves, box.select("component", "cx", "cy"), ["component"])
        moves = placed.select(
            "component",
            F.floor(F.coalesce("x", F.lit(0)) - F.col("cx")).alias("dx"),
            F.floor(F.coalesce("y", F.lit(0)) - F.col("cy")).alias("dy"),
        )
    both = attach(shapes, moves.select("component", "dx", "dy"), ["component"], "left")
    for axis in ("x", "y"):
        step = F.coalesce(f"d{axis}", F.lit(0))
        for end in ("l", "h"):
            both = both.withColumn(f"{axis}{end}", (F.col(f"{axis}{end}") + step).cast("long"))
    return both.select(*shapes.columns)


def array_copy(shapes: DataFrame, arrays: DataFrame, between: bool = True) -> DataFrame:
    """Rows x columns copies of each component, with the port prefix of each copy.

    ``arrays`` has (component, rows, cols, dx, dy); with ``between`` the spacing is that
    between the bounding boxes, else from origin to origin.
    """
    plan = arrays
    if between:
        box = bbox(shapes, ["component"]).select("component", "width", "height")
        plan = null_safe_join(arrays, box, ["component"]).select(
            "component", "rows", "cols", (F.col("dx") + F.col("width")).alias("dx"), (F.col("dy") + F.col("height")).alias("dy")
        )
    copies = attach(shapes, plan, ["component"])
    copies = copies.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
    copies = copies.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols").cast("int") - 1)))
    x, y = F.col("col") * F.col("dx"), F.col("row") * F.col("dy")
    return copies.select(
        "component", "shape_id", "layer", "row", "col",
        (F.col("xl") + x).alias("xl"), (F.col("yl") + y).alias("yl"),
        (F.col("xh") + x).alias("xh"), (F.col("yh") + y).alias("yh"),
        F.concat(F.lit("row"), "row", F.lit("_col"), "col", F.lit("_")).alias("port_prefix"),
    )


def perimeter_ports(shapes: DataFrame, layer: str, prefix: str = "_") -> DataFrame:
    """Four ports on the bounding box of one layer of each component."""
    if "_" not in prefix:
        raise ValueError("the prefix needs an underscore")
    box = bbox(extract_layers(shapes, [layer]), ["component"])
    sides = [
        ("W", "height", 180, F.col("xl").cast("double"), F.col("cy")),
        ("N", "width", 90, F.col("cx"), F.col("yh").cast("double")),
        ("E", "height", 0, F.col("xh").cast("double"), F.col("cy")),
        ("S", "width", 270, F.col("cx"), F.col("yl").cast("double")),
    ]
    ports = F.array(*[
        F.struct(
            F.lit(prefix + name).alias("name"), F.col(width).alias("width"), F.lit(angle).alias("orientation"),
            x.alias("cx"), y.alias("cy"),
        )
        for name, width, angle, x, y in sides
    ])
    return box.select("component", F.lit(layer).alias("layer"), F.explode(ports).alias("p")).select("component", "layer", "p.*")


def chip_totals(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Area of the extent over all layers, and the number of shapes."""
    return shapes.groupBy(*by).agg(
        ((F.max("xh") - F.min("xl")) * (F.max("yh") - F.min("yl"))).alias("extent_area"),
        F.count(F.lit(1)).alias("n_shapes"),
    )


def cell_select(shapes: DataFrame, pattern: str, inside: bool = True) -> DataFrame:
    """Shapes of cells whose whole name matches the pattern, or of all other cells."""
    hit = F.col("cell").rlike(f"^(?:{pattern})$")
    return shapes.where(hit if inside else ~hit)
