"""Boundary edges of merged layers, and checks that work on them.

Abutting and overlapping rectangles are one shape: an edge counts only where one side is covered and
the other is not. The layer is cut into disjoint rectangles first; each gives a signed edge on
every side, and where two of them meet the signs cancel. What is left is swept along each line
into whole edges, so it does not matter how a shape was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafermill.operators.boolean import BOX, boolean_rects
from wafermill.plans.attach import null_safe_join
from wafermill.plans.gridjoin import near_pairs

#: (axis of the edge's place, sign of the covered side) -> name of the side of the shape.
SIDES = {("x", 1): "left", ("x", -1): "right", ("y", 1): "bottom", ("y", -1): "top"}


def boundary_edges(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Whole edges of the merged shapes: ``by``, ``side``, the box (flat along one axis), ``length``.

    Only the box columns and ``by`` are read. Rectangles without an area have no edges.
    """
    return edges_of_parts(boolean_rects(shapes, None, by, "or"), by)


def edges_of_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """The edges of the union of disjoint rectangles."""
    ends = F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), F.col(at).alias("at"), F.col(pos).alias("pos"), F.lit(delta).alias("delta"))
        for axis, low, high, start, end in (("x", "xl", "xh", "yl", "yh"), ("y", "yl", "yh", "xl", "xh"))
        for at, sign in ((low, 1), (high, -1))
        for pos, delta in ((start, sign), (end, -sign))
    ]))
    steps = parts.select(*by, ends.alias("e")).select(*by, "e.*").groupBy(*by, "axis", "at", "pos").agg(F.sum("delta").alias("delta"))
    line = Window.partitionBy(*by, "axis", "at").orderBy("pos")
    swept = steps.where("delta <> 0").withColumn("net", F.sum("delta").over(line)).withColumn("end", F.lead("pos").over(line))
    side = F.lit(None).cast("string")
    for (axis, sign), name in SIDES.items():
        side = F.when((F.col("axis") == axis) & (F.sign("net") == sign), name).otherwise(side)
    upright = F.col("axis") == "x"
    return swept.where("net <> 0").select(
        *by, side.alias("side"),
        F.when(upright, F.col("at")).otherwise(F.col("pos")).alias("xl"), F.when(upright, F.col("pos")).otherwise(F.col("at")).alias("yl"),
        F.when(upright, F.col("at")).otherwise(F.col("end")).alias("xh"), F.when(upright, F.col("end")).otherwise(F.col("at")).alias("yh"),
        (F.col("end") - F.col("pos")).alias("length"),
    )


def margins(parts: DataFrame, inner: DataFrame, by: list[str], reach: Column | int) -> DataFrame:
    """Rectangles of ``inner`` (``by``, ``id``, box) that are nearer than ``reach`` to the outline of the
    disjoint ``parts``: ``by``, ``id``, ``margin``. The margin is how far all sides can be moved out
    before the rectangle crosses the outline."""
    edges = edges_of_parts(parts, by).select(*by, F.monotonically_increasing_id().alias("id"), *BOX)
    pairs = near_pairs(inner, edges, by, reach)
    none = F.lit(0).cast("long")
    margin = F.greatest(none, *[F.col(f"{p}_{a}l") - F.col(f"{q}_{a}h") for a in "xy" for p, q in (("a", "b"), ("b", "a"))])
    return pairs.groupBy(*by, F.col("a_id").alias("id")).agg(F.min(margin).alias("margin"))


def held_shapes(parts: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """Of ``inner`` (``by``, ``id``, ``label``, box) the merged shapes, named by ``label``, that the disjoint
    ``parts`` cover whole: their rectangles."""
    pairs = near_pairs(inner, parts.select(*by, F.monotonically_increasing_id().alias("id"), *BOX), by)
    sides = [F.least(f"a_{a}h", f"b_{a}h") - F.greatest(f"a_{a}l", f"b_{a}l") for a in "xy"]
    covered = pairs.groupBy(*by, F.col("a_id").alias("id")).agg(F.sum(sides[0] * sides[1]).alias("_covered"))
    whole = F.coalesce("_covered", F.lit(0)) == (F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))
    checked = null_safe_join(inner, covered, [*by, "id"], "left").withColumn("_out", ~whole)
    out = checked.where("_out").select(*by, "label").distinct()
    return null_safe_join(inner, out, [*by, "label"], "left_anti")
