"""Spatial predicates and rule checks over rectangle tables.

Copies of one rectangle are one shape: pairs are found between distinct rectangles, named
by the smallest id of their copies, so a pile of equal rectangles makes no pairs of its
own. Filters give back all copies.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafermill.operators.boolean import BOX, boolean_rects, rect_area, slab_intervals, two_sides
from wafermill.operators.boundary import boundary_edges, held_shapes, margins
from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.components import connected_components
from wafermill.plans.expand import numbered_rows
from wafermill.plans.gridjoin import gap_squared, near_pairs
from wafermill.session import cut_lineage


def distinct_rects(shapes: DataFrame, by: list[str]) -> DataFrame:
    """One row per distinct rectangle: smallest id and number of copies."""
    return shapes.groupBy(*by, *BOX).agg(F.min("shape_id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _swap(df: DataFrame) -> DataFrame:
    turn = {"xl": "yl", "yl": "xl", "xh": "yh", "yh": "xh"}
    return df.select(*[F.col(turn[c]).alias(c) if c in turn else F.col(c) for c in df.columns])


def _runs(shapes: DataFrame, by: list[str], reach: int, gaps: bool, limit: Column) -> DataFrame:
    """Merged intervals (or the gaps between them) shorter than ``limit``, both directions.

    The slabs are swept along y, then with x and y exchanged along x. Slabs side by side with the
    same interval are one box, so the boxes do not depend on how a shape was cut.
    """
    found = []
    for direction in ("y", "x"):
        turned = shapes if direction == "y" else _swap(shapes)
        runs = slab_intervals(two_sides(turned, None, by), by, "or", reach, joined=True, gaps=gaps)
        own = (F.col("yl") >= F.col("_y0")) & (F.col("yl") < F.col("_y1"))
        short = _side_by_side(runs.where(own & (F.col("yh") - F.col("yl") < limit)).drop("_y0", "_y1"), by)
        back = short if direction == "y" else _swap(short).select(*short.columns)
        found.append(back.select(*by, *BOX, F.lit(direction).alias("direction")))
    return found[0].union(found[1])


def _side_by_side(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Boxes with the same y interval that touch along x become one."""
    line = Window.partitionBy(*by, "yl", "yh").orderBy("xl")
    new = F.coalesce(F.lag("xh").over(line) < F.col("xl"), F.lit(True)).cast("int")
    numbered = boxes.withColumn("_new", new).withColumn("_box", F.sum("_new").over(line))
    return numbered.groupBy(*by, "yl", "yh", "_box").agg(F.min("xl").alias("xl"), F.max("xh").alias("xh")).select(*by, *BOX)


def min_width(shapes: DataFrame, by: list[str], width: int) -> DataFrame:
    """Parts of the merged shapes that are narrower than ``width`` along x or y."""
    return _runs(shapes, by, width, False, F.lit(width))


def notches(shapes: DataFrame, by: list[str], space: int) -> DataFrame:
    """Gaps shorter than ``space`` along x or y between parts of the merged layer."""
    return _runs(shapes, by, space, True, F.lit(space))


def merge_shapes(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Label every shape with the smallest id of the touching shapes it belongs to."""
    rects = distinct_rects(shapes, by)
    touching = near_pairs(rects, rects, by).where("a_id < b_id")
    return null_safe_join(shapes, _labelled(rects, touching, by).drop("id"), [*by, *BOX])


def _labelled(rects: DataFrame, touching: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, ``id``, box, ``label``): the smallest id reached over ``touching`` pairs."""
    labels = connected_components(touching.select(*by, F.col("a_id").alias("u"), F.col("b_id").alias("v")), by)
    named = null_safe_join(rects, labels.select(*by, F.col("node").alias("id"), "label"), [*by, "id"], "left")
    return named.select(*by, "id", *BOX, F.coalesce("label", "id").alias("label"))


def _spaced(pairs: DataFrame, distance: Column | int) -> DataFrame:
    limit = F.lit(distance) if isinstance(distance, int) else distance
    return pairs.withColumn("gap2", gap_squared()).where((F.col("gap2") > 0) & (F.col("gap2") < limit * limit))


def min_spacing(shapes: DataFrame, by: list[str], distance: int, mode: str = "isolated") -> DataFrame:
    """Same-layer rectangle pairs with 0 < Euclidean gap < ``distance``.

    ``isolated`` keeps pairs of different merged shapes, ``space`` all pairs.
    """
    rects = distinct_rects(shapes, by)
    # One search serves both: touching pairs make the merged shapes, the others are measured.
    pairs = near_pairs(rects, rects, by, distance).where("a_id < b_id").withColumn("gap2", gap_squared())
    pairs = pairs.where((F.col("gap2") < distance * distance)).select(*by, "a_id", "b_id", "gap2")
    if mode == "isolated":
        pairs = cut_lineage(pairs)
        labels = connected_components(pairs.where("gap2 = 0").select(*by, F.col("a_id").alias("u"), F.col("b_id").alias("v")), by)
        pairs = pairs.where("gap2 > 0")
        for end in ("a", "b"):
            named = labels.select(*by, F.col("node").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
            pairs = null_safe_join(pairs, named, [*by, f"{end}_id"], "left")
        pairs = pairs.where(F.coalesce("a_label", "a_id") != F.coalesce("b_label", "b_id"))
    return pairs.where("gap2 > 0").select(*by, "a_id", "b_id", "gap2")


def min_separation(a: DataFrame, b: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Pairs of two layers with 0 < Euclidean gap < ``distance``."""
    pairs = near_pairs(distinct_rects(a, by), distinct_rects(b, by), by, distance)
    return _spaced(pairs, distance).select(*by, "a_id", "b_id", "gap2")


def _margin() -> Column:
    return F.least(
        F.col("b_xl") - F.col("a_xl"), F.col("b_yl") - F.col("a_yl"),
        F.col("a_xh") - F.col("b_xh"), F.col("a_yh") - F.col("b_yh"),
    )


def min_enclosure(outer: DataFrame, inner: DataFrame, by: list[str], distance: Column | int) -> DataFrame:
    """Merged inner shapes that the outer layer holds with a margin below ``distance``.

    Both layers are merged first, so seams between abutting rectangles are no edges. A shape is named
    by ``label``, the smallest id of its rectangles; the margin is how far its sides can be
    moved out before they cross the outline of the outer layer. Shapes that stick out belong to
    :func:`relation`. ``distance`` may be a column of ``by``.
    """
    limit = F.lit(distance) if isinstance(distance, int) else distance
    parts = cut_lineage(boolean_rects(outer, None, by, "or"))
    held = cut_lineage(held_shapes(parts, labelled_rects(inner, by), by))
    near = null_safe_join(margins(parts, held, by, distance), held.select(*by, "id", "label"), [*by, "id"])
    return near.groupBy(*by, "label").agg(F.min("margin").alias("margin")).where(F.col("margin") < limit)


def labelled_rects(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, ``id``, box, ``label``) of the distinct rectangles, labelled by their merged shape."""
    rects = distinct_rects(shapes, by)
    return cut_lineage(_labelled(rects, near_pairs(rects, rects, by).where("a_id < b_id"), by))


def region_adjacency(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Merged shapes of two layers that touch or overlap: (``by``, ``a_label``, ``b_label``).

    Both inputs come from :func:`labelled_rects`. A row stands for any number of rectangle pairs, which
    are made one before the shuffle.
    """
    return near_pairs(a, b, by, carry=["label"]).select(*by, "a_label", "b_label").distinct()


def _of_labels(shapes: DataFrame, rects: DataFrame, labels: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """Shapes whose merged shape is among ``labels(by, label)``, or not among them."""
    boxes = null_safe_join(rects, labels, [*by, "label"], how).select(*by, *BOX)
    return null_safe_join(shapes, boxes, [*by, *BOX], "left_semi")


def interacting(
    a: DataFrame, b: DataFrame, by: list[str], least: int = 1, most: int | None = None, negate: bool = False
) -> DataFrame:
    """Shapes of ``a`` whose merged shape touches or overlaps between ``least`` and ``most`` merged
    shapes of ``b``.

    ``negate`` gives the others.
    """
    rects = labelled_rects(a, by)
    counted = region_adjacency(rects, labelled_rects(b, by), by).groupBy(*by, F.col("a_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    hits = counted.where((F.col("n") >= least) & (F.lit(most is None) | (F.col("n") <= (most or 0))))
    return _of_labels(a, rects, hits.drop("n"), by, "left_anti" if negate else "left_semi")


def covered_area(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """For each distinct rectangle of ``a`` the area of it that the union of ``b`` covers."""
    rects = distinct_rects(a, by)
    pairs = near_pairs(rects, distinct_rects(b, by), by)
    inner = pairs.select(
        *by, F.col("a_id").alias("id"),
        F.greatest("a_xl", "b_xl").alias("xl"), F.greatest("a_yl", "b_yl").alias("yl"),
        F.least("a_xh", "b_xh").alias("xh"), F.least("a_yh", "b_yh").alias("yh"),
    ).where("xl < xh AND yl < yh")
    area = boolean_rects(inner, None, [*by, "id"], "or").groupBy(*by, "id").agg(F.sum(rect_area()).alias("covered"))
    return null_safe_join(rects, area, [*by, "id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def relation(a: DataFrame, b: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Shapes of ``a`` by their place against ``b``.

    ``inside``, ``not_inside`` (of the union of b), ``outside`` (no common area),
    ``overlapping`` (some common area), ``covering`` (its merged shape holds a whole merged shape of b).
    """
    if kind == "covering":
        rects, inner = labelled_rects(a, by), labelled_rects(b, by)
        held = held_shapes(boolean_rects(a, None, by, "or"), inner, by).select(*by, F.col("label").alias("b_label")).distinct()
        found = null_safe_join(region_adjacency(rects, inner, by), held, [*by, "b_label"]).select(*by, F.col("a_label").alias("label"))
        return _of_labels(a, rects, found.distinct(), by)
    else:
        area = covered_area(a, b, by)
        tests = {
            "inside": F.col("covered") == rect_area(),
            "not_inside": F.col("covered") < rect_area(),
            "outside": F.col("covered") == 0,
            "overlapping": F.col("covered") > 0,
        }
        hits = area.where(tests[kind]).select(*by, *BOX)
    return null_safe_join(a, hits, [*by, *BOX], "left_semi")


def _sized(shapes: DataFrame, by: list[str], d: int) -> DataFrame:
    return shapes.select(
        *by, (F.col("xl") - d).alias("xl"), (F.col("yl") - d).alias("yl"),
        (F.col("xh") + d).alias("xh"), (F.col("yh") + d).alias("yh"),
    )


def _shrink_y(shapes: DataFrame, by: list[str], d: int) -> DataFrame:
    """Every merged y interval without ``d`` at both ends.

    A tile sees ``d`` beyond its borders, so the part of the result inside it is exact.
    """
    runs = slab_intervals(two_sides(shapes, None, by), by, "or", d, joined=True)
    return runs.select(
        *by, "xl", F.greatest(F.col("yl") + d, F.col("_y0")).alias("yl"), "xh", F.least(F.col("yh") - d, F.col("_y1")).alias("yh")
    ).where("yl < yh")


def grow_shrink(shapes: DataFrame, by: list[str], d: int) -> DataFrame:
    """Merged shapes grown by ``d``, or shrunk when it is negative.

    Shrinking by a square is shrinking along y and then along x; each is one slab pass
    over the union.
    """
    if d >= 0:
        return _sized(shapes, by, d)
    once = _shrink_y(shapes, by, -d)
    return _swap(_shrink_y(_swap(once), by, -d)).select(*by, *BOX)


def wide_parts(shapes: DataFrame, by: list[str], width: int) -> DataFrame:
    """Parts of the union at least ``width`` (even) wide: shrink by half, then grow back."""
    return _sized(grow_shrink(shapes, by, -(width // 2)), by, width // 2)


def shape_areas(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Area of every merged shape."""
    labelled = merge_shapes(shapes, by)
    return boolean_rects(labelled, None, [*by, "label"], "or").groupBy(*by, "label").agg(F.sum(rect_area()).alias("area"))


def area_filter(shapes: DataFrame, by: list[str], low: int, high: int | None = None, inside: bool = True) -> DataFrame:
    """Merged shapes with an area in [low, high), or outside of that range."""
    hit = F.col("area") >= low
    if high is not None:
        hit = hit & (F.col("area") < high)
    return shape_areas(shapes, by).where(hit if inside else ~hit).select(*by, "label", "area")


def bbox_filter(shapes: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """Extents of merged shapes whose larger box side is in [low, high)."""
    labelled = merge_shapes(shapes, by)
    box = labelled.groupBy(*by, "label").agg(
        F.min("xl").alias("xl"), F.min("yl").alias("yl"), F.max("xh").alias("xh"), F.max("yh").alias("yh")
    )
    side = F.greatest(F.col("xh") - F.col("xl"), F.col("yh") - F.col("yl"))
    return box.where((side >= low) & (side < high))


def edge_length_filter(shapes: DataFrame, by: list[str], low: int, high: int | None = None, inside: bool = True) -> DataFrame:
    """Edges of the merged shapes with a length in [low, high] (exactly ``low`` without ``high``), or all
    others: ``by``, ``side``, the edge as a flat box, ``length``."""
    hit = F.col("length").between(low, low if high is None else high)
    return boundary_edges(shapes, by).where(hit if inside else ~hit)


def offgrid(shapes: DataFrame, grid: int) -> DataFrame:
    """Corner points that are not on a multiple of the grid."""
    corners = F.array(*[
        F.struct(F.lit(name).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"))
        for name, x, y in (("ll", "xl", "yl"), ("lr", "xh", "yl"), ("ur", "xh", "yh"), ("ul", "xl", "yh"))
    ])
    flat = shapes.select("component", "shape_id", "layer", F.explode(corners).alias("p")).select("component", "shape_id", "layer", "p.*")
    return flat.where((F.col("x") % grid != 0) | (F.col("y") % grid != 0))


def overlap_min(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """Places where the common part of two merged layers is narrower than ``width`` along x or y:
    whole boxes with their ``direction`` and ``overlap``."""
    thin = _runs(boolean_rects(a, b, by, "and"), by, width, False, F.lit(width))
    along = F.when(F.col("direction") == "y", F.col("yh") - F.col("yl")).otherwise(F.col("xh") - F.col("xl"))
    return thin.withColumn("overlap", along)


def _box_sums(cells: DataFrame, by: list[str], value: str, spans: dict[str, int]) -> DataFrame:
    """Sums of ``value`` over boxes of cells that begin at every cell of a full grid ``cx``, ``cy``.

    A summed-area table an axis at a time: running sums along a line of cells, and the difference of
    two of them. What a box costs does not depend on how many cells it has.
    """
    for axis, span in spans.items():
        line = [*by, *[c for c in ("cx", "cy") if c != axis]]
        order = Window.partitionBy(*line).orderBy(axis)
        upto = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
        sums = cells.withColumn("_upto", upto)
        # The sum of a line is taken once: a frame up to the end of the line is read anew for every row.
        whole = F.sum(value).over(Window.partitionBy(*line))
        end = F.coalesce(F.lead("_upto", span - 1).over(order), whole)
        cells = sums.withColumn("_sum", end - F.col("_upto") + F.col(value)).drop("_upto", value).withColumnRenamed("_sum", value)
    return cells


def window_density(
    shapes: DataFrame, by: list[str], window: int, step: int, low: float, high: float
) -> DataFrame:
    """Windows whose covered share is below ``low`` or above ``high``.

    Windows start at the lower left of the extent, half a step further in when they slide;
    the share is taken of the part of the window inside the extent. Empty windows count
    with share 0. The union is cut once into disjoint rectangles and these into cells as long as
    the largest common measure of window and step; windows are sums over cells by a
    summed-area table, so parts are not repeated for windows that overlap.
    """
    shift = 0 if step == window else step // 2
    cell = math.gcd(window, step)
    box = shapes.groupBy(*by).agg(
        (F.min("xl") + shift).alias("_ox"), (F.min("yl") + shift).alias("_oy"),
        F.max("xh").alias("_ex"), F.max("yh").alias("_ey"),
    ).where("_ox < _ex AND _oy < _ey")
    ny = F.ceil((F.col("_ey") - F.col("_oy")) / cell)
    grid = numbered_rows(box.withColumn("_ny", ny), F.ceil((F.col("_ex") - F.col("_ox")) / cell) * ny, "_k", by)
    grid = grid.select(*by, F.floor(F.col("_k") / F.col("_ny")).alias("cx"), (F.col("_k") % F.col("_ny")).alias("cy"), F.lit(0).cast("long").alias("covered"))
    parts = attach(boolean_rects(shapes, None, by, "or"), box, by)
    for axis in ("x", "y"):
        origin = F.col(f"_o{axis}")
        first = F.greatest(F.lit(0), F.floor((F.col(f"{axis}l") - origin) / cell))
        last = F.floor((F.col(f"{axis}h") - 1 - origin) / cell)
        parts = parts.where(last >= first).withColumn(f"c{axis}", F.explode(F.sequence(first, last)))
        at = origin + F.col(f"c{axis}") * cell
        parts = parts.withColumn(f"_{axis}", F.least(f"{axis}h", at + cell) - F.greatest(f"{axis}l", at))
    covered = parts.select(*by, "cx", "cy", (F.col("_x") * F.col("_y")).alias("covered"))
    cells = grid.unionByName(covered).groupBy(*by, "cx", "cy").agg(F.sum("covered").alias("covered"))
    if window > cell:
        cells = _box_sums(cells, by, "covered", {"cx": window // cell, "cy": window // cell})
    each = step // cell
    starts = attach(cells.where((F.col("cx") % each == 0) & (F.col("cy") % each == 0)), box, by)
    x0, y0 = F.col("_ox") + F.col("cx") * cell, F.col("_oy") + F.col("cy") * cell
    size = (F.least("_ex", x0 + window) - x0) * (F.least("_ey", y0 + window) - y0)
    shares = starts.withColumn("density", F.col("covered") / size)
    wx, wy = (F.col(c) / each for c in ("cx", "cy"))
    return shares.where((F.col("density") < low) | (F.col("density") > high)).select(
        *by, wx.cast("long").alias("wx"), wy.cast("long").alias("wy"), "covered", "density"
    )


def check_rule_table(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply the width, separation and enclosure rules of a table to all merged shapes at once.

    ``rules`` has (glayer1, glayer2, rule, value) in database units. Output: component, rule, glayer1,
    glayer2, ``a_id``, ``b_id``, ``measured`` and a box. A width row has the narrow part of the merged
    layer as its box; a separation row names two rectangles (of different merged shapes,
    if of one layer); an enclosure row names the merged inner shape as ``b_id``.
    """
    none = F.lit(None).cast("long")
    by = ["component", "glayer1", "glayer2", "value"]
    rules = cut_lineage(rules.select("glayer1", "glayer2", "rule", F.col("value").cast("long").alias("value")).distinct())

    def ruled(kind: str, end: int) -> DataFrame:
        wanted = rules.where(F.col("rule") == kind).drop("rule").withColumn("layer", F.col(f"glayer{end}"))
        return attach(shapes, wanted, ["layer"]).select(*by, "shape_id", *BOX)

    def found(rows: DataFrame, kind: str, a, b, measured, box) -> DataFrame:
        return rows.select(
            "component", F.lit(kind).alias("rule"), "glayer1", "glayer2",
            a.alias("a_id"), b.alias("b_id"), measured.cast("double").alias("measured"), *[c.alias(n) for c, n in zip(box, BOX)],
        )

    no_box, own_box = [none] * 4, [F.col(c) for c in BOX]
    widest = rules.where("rule = 'min_width'").agg(F.coalesce(F.max("value"), F.lit(0))).first()[0]
    narrow = _runs(ruled("min_width", 1).where("glayer1 = glayer2"), by, widest, False, F.col("value"))
    along = F.when(F.col("direction") == "y", F.col("yh") - F.col("yl")).otherwise(F.col("xh") - F.col("xl"))
    narrow = found(narrow, "min_width", none, none, along, own_box)

    first, second = (distinct_rects(ruled("min_separation", end), by) for end in (1, 2))
    apart = near_pairs(first, second, by, F.col("value")).withColumn("gap2", gap_squared())
    apart = cut_lineage(apart.where((F.col("glayer1") != F.col("glayer2")) | (F.col("a_id") < F.col("b_id"))))
    one = apart.where("glayer1 = glayer2 AND gap2 = 0")
    labels = connected_components(one.select(*by, F.col("a_id").alias("u"), F.col("b_id").alias("v")), by)
    apart = apart.where((F.col("gap2") > 0) & (F.col("gap2") < F.col("value") * F.col("value"))).select(*by, "a_id", "b_id", "gap2")
    for end in ("a", "b"):
        named = labels.select(*by, F.col("node").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
        apart = null_safe_join(apart, named, [*by, f"{end}_id"], "left")
    same = F.coalesce("a_label", "a_id") == F.coalesce("b_label", "b_id")
    apart = apart.where((F.col("glayer1") != F.col("glayer2")) | ~same)
    apart = found(apart, "min_separation", F.col("a_id"), F.col("b_id"), F.sqrt("gap2"), no_box)

    other = F.col("glayer1") != F.col("glayer2")
    held = min_enclosure(ruled("min_enclosure", 1).where(other), ruled("min_enclosure", 2).where(other), by, F.col("value"))
    held = found(held, "min_enclosure", none, F.col("label"), F.col("margin"), no_box)
    return narrow.union(apart).union(held)


def violation_report(checks: dict[str, tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """Violations per category with its description; ``checks`` is name -> (text, rows).

    Every check is counted on its own before the union, so no violation rows are moved.
    """
    counted = [
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("violations"))
        .select(*by, F.lit(name).alias("category"), F.lit(text).alias("description"), "violations")
        for name, (text, rows) in checks.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), counted)
