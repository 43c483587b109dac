"""Boolean combination of rectangle layers by tiles and slabs.

Tiles follow the data, not a unit of length: the plane is cut into strips at quantiles of the x
edges, and each strip into tiles at quantiles of the y edges inside it, so tiles hold about PER_TILE
rectangles each also where the data lie along a line. The number of strips follows the shape of the
layer and of its rectangles, so that a long layer is not cut into tiles flatter than what they hold. One
rectangle alone is one tile, however large it is. In a tile the distinct x edges make slabs, and in a slab the y edges
are swept with a running depth for each side (``plans/sweep.py``, in arrays).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.plans.attach import attach
from wafermill.plans.sweep import swept_tiles
from wafermill.session import cut_lineage

PER_TILE = 64
#: Sampled edges for each border: the more, the more even the tiles.
SAMPLED = 16
#: Borders of an axis that a row may carry while it is placed; where there are more, they go in two steps.
MOST_PLACES = 128
#: Rectangles of a group that shape its tiles, and rectangles that one task sweeps.
SHAPED, PER_TASK = 4096, 50_000
#: Stands for the open end of the first and the last tile.
FAR = 2**60
BOX = ["xl", "yl", "xh", "yh"]

OPERATIONS = {
    "or": lambda a, b: a | b,
    "and": lambda a, b: a & b,
    "not": lambda a, b: a & ~b,
    "xor": lambda a, b: a != b,
}


def borders(rects: DataFrame, by: list[str], axis: str, classes: Column, within: tuple[str, str] | None = None) -> DataFrame:
    """Sorted places ``_b`` that cut the edges of an axis into even parts in every group.

    Of the digests of edges one in ``classes`` is sampled, and every SAMPLED-th sample is a border.
    Groups of so few edges that one part holds them are left out. ``within`` names the columns of
    the ends between which borders are wanted.
    """
    ends = [F.col(c).alias(f"_e{k}") for k, c in enumerate(within or ())]
    edges = rects.select(*by, classes.alias("_c"), F.xxhash64(*BOX).alias("_h"), *ends, F.explode(F.array(f"{axis}l", f"{axis}h")).alias("v"))
    if within:
        edges = edges.where("_e0 < v AND v < _e1")
    picked = edges.where(F.pmod(F.xxhash64("_h", "v"), F.col("_c")) == 0).groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("_v"))
    every = F.filter("_v", lambda v, k: k % SAMPLED == SAMPLED // 2)
    return picked.where(F.size("_v") > SAMPLED).select(*by, F.array_distinct(every).alias("_b"))


def _below(places: Column, value: Column, equal: bool) -> Column:
    """How many of the sorted ``places`` are below ``value`` (or equal to it): a binary search."""

    def step(found: Column, size: Column) -> Column:
        at = F.get(places, found + size - 1)
        return F.when(at <= value if equal else at < value, found + size).otherwise(found)

    sizes = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(F.filter(sizes, lambda x: x <= F.size(places)), F.lit(0), step))


def _cut(rects: DataFrame, by: list[str], axis: str, places: DataFrame, halo: int, within: tuple[str, str] | None = None) -> DataFrame:
    """A row for each part between ``places`` that a rectangle touches along ``axis``: its number
    ``t{axis}`` and its ends ``_{axis}0`` and ``_{axis}1``. Of a rectangle only what lies ``within`` two
    columns counts, and they are the outer ends."""
    none = F.array().cast("array<bigint>")
    placed = attach(rects, places, by, "left").withColumn("_b", F.coalesce("_b", none))
    outer = [F.col(c) for c in within] if within else [F.lit(-FAR).cast("long"), F.lit(FAR).cast("long")]
    first = _below(F.col("_b"), F.greatest(F.col(f"{axis}l") - halo, outer[0]), True)
    last = _below(F.col("_b"), F.least(F.col(f"{axis}h") + halo, outer[1]), False)
    placed = placed.withColumn("_first", first).withColumn("_last", F.greatest("_first", last))
    placed = placed.withColumn(f"t{axis}", F.explode(F.sequence("_first", "_last")))
    place = F.col(f"t{axis}")
    start = F.coalesce(F.when(place > 0, F.get("_b", place - 1)), outer[0])
    return placed.withColumn(f"_{axis}0", start).withColumn(f"_{axis}1", F.coalesce(F.get("_b", place), outer[1])).drop("_b", "_first", "_last")


def _cut_twice(rects: DataFrame, by: list[str], axis: str, coarse: DataFrame, fine: Column, halo: int) -> DataFrame:
    """Like :func:`_cut`, first into the parts that ``coarse`` (``by``, ``_c``) asks for and these into finer
    ones, so that no row carries more than about the root of all places."""
    names, ends = [f"t{axis}", f"_{axis}0", f"_{axis}1"], ("_from", "_to")
    parted = _cut(rects, by, axis, borders(attach(rects, coarse, by), by, axis, F.col("_c")), halo)
    parted = cut_lineage(parted.withColumnsRenamed(dict(zip(names, ["_part", *ends]))))
    inner = [*by, "_part"]
    cut = _cut(parted, inner, axis, borders(parted, inner, axis, fine, ends), halo, ends)
    return cut.withColumn(names[0], F.col("_part") * F.lit(1 << 32) + F.col(names[0])).drop("_part", *ends)


def _tile_plan(rects: DataFrame, by: list[str], per_tile: int) -> DataFrame:
    """For every group of more than a tile: rows ``_n``, and strips along x (``_strips``) and tiles in a
    strip (``_each``) for which tiles are cut across by as few rectangles as can be.

    A rectangle touches about (1 + w strips / W) (1 + h each / H) tiles of a group W long and H high, so
    both terms are made alike: a long, flat layer gets many strips and a square one as many as tiles
    in each. Lengths come from about SHAPED rectangles of a group; they only shape the tiles.
    """
    sizes = rects.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_tile)
    sampled = attach(rects, sizes, by).where(F.pmod(F.xxhash64(*BOX), F.greatest(F.lit(1), F.floor(F.col("_n") / SHAPED))) == 0)
    spans = []
    for axis in ("x", "y"):
        ends = F.percentile(f"{axis}l", F.array(F.lit(0.05), F.lit(0.95)))
        spans += [F.greatest(ends[1] - ends[0], F.lit(1.0)).alias(f"_span{axis}"), F.greatest(F.avg(F.col(f"{axis}h") - F.col(f"{axis}l")), F.lit(1.0)).alias(f"_side{axis}")]
    shaped = sampled.groupBy(*by, "_n").agg(*spans)
    tiles = F.ceil(F.col("_n") / F.lit(float(per_tile)))
    strips = F.round(F.sqrt(tiles * F.col("_spanx") * F.col("_sidey") / (F.col("_spany") * F.col("_sidex"))))
    planned = shaped.withColumn("_strips", F.least(tiles, F.greatest(F.lit(1), strips)).cast("long"))
    return cut_lineage(planned.select(*by, "_n", "_strips", F.ceil(tiles / F.col("_strips")).alias("_each")))


def tiled(rects: DataFrame, by: list[str], per_tile: int = PER_TILE, halo: int = 0) -> DataFrame:
    """A row for each tile (``tx``, ``ty``, ends ``_x0`` to ``_y1``) that a rectangle touches; along y
    also those that only its ``halo`` touches."""
    plan = _tile_plan(rects, by, per_tile)
    most = plan.agg(F.coalesce(F.max("_strips"), F.lit(1)).alias("x"), F.coalesce(F.max("_each"), F.lit(1)).alias("y")).first()

    def one_in(parts: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(2 * F.col("_n") / (parts * SAMPLED))).cast("long")

    fine = plan.where("_strips > 1").select(*by, one_in(F.col("_strips")).alias("_classes"))
    if most["x"] <= MOST_PLACES:
        cut = _cut(rects, by, "x", borders(attach(rects, fine, by), by, "x", F.col("_classes")), 0)
    else:
        coarse = plan.where(F.col("_strips") > MOST_PLACES).select(*by, one_in(F.ceil(F.sqrt("_strips"))).alias("_c"))
        planned = attach(rects, fine, by, "left").withColumn("_classes", F.coalesce("_classes", F.lit(FAR).cast("long")))
        cut = _cut_twice(planned, by, "x", coarse, F.col("_classes"), 0).drop("_classes")
    cut = cut_lineage(cut)
    inside, dense = [*by, "tx"], F.lit(max(1, 2 * per_tile // SAMPLED))
    if most["y"] <= MOST_PLACES:
        return _cut(cut, inside, "y", borders(cut, inside, "y", dense), halo)
    counted = cut.groupBy(*inside).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_PLACES * per_tile)
    coarse = counted.select(*inside, one_in(F.ceil(F.sqrt(F.col("_n") / F.lit(float(per_tile))))).alias("_c"))
    return _cut_twice(cut, inside, "y", coarse, dense, halo)


def slab_intervals(sides: DataFrame, by: list[str], op: str, halo: int = 0, per_tile: int = PER_TILE, joined: bool = False, gaps: bool = False) -> DataFrame:
    """Maximal y intervals of the combined layers in every slab of every tile, or the gaps between them.

    ``sides`` has ``by``, the box, and ``a``/``b`` with 1 on the side a rectangle is on.
    With ``halo`` a tile also sees that far beyond its lower and upper border, so an
    interval that starts in the tile is either whole or longer than the halo. With ``joined`` slabs side
    by side with the same interval are one in each tile, or every rectangle would come out cut at the edges
    of all others.
    Output: by, _y0, _y1 (range of the tile), xl, xh (slab), yl, yh.
    """
    cut = sides.where("xl < xh AND yl < yh").select(*by, *BOX, "a", "b")
    cut = cut_lineage(cut.groupBy(*by, *BOX).agg(F.max("a").alias("a"), F.max("b").alias("b")))
    count = cut.count()
    cut = tiled(cut, by, per_tile, halo).select(
        *by, "tx", "ty", "a", "b", "_y0", "_y1",
        F.greatest("xl", "_x0").alias("xl"), F.greatest("yl", F.col("_y0") - halo).alias("yl"),
        F.least("xh", "_x1").alias("xh"), F.least("yh", F.col("_y1") + halo).alias("yh"),
    )
    # All that follows works inside tiles, so the rows are shuffled once. The number of tasks follows the
    # rows: a task holds the rectangles of its tiles and sweeps some of them at a time.
    place = [*by, "tx", "ty"]
    tasks = math.ceil(count / PER_TASK)
    many = tasks > cut.sparkSession.sparkContext.defaultParallelism
    cut = cut.repartition(tasks, *place) if many else cut.repartition(*place)
    whole = cut.groupBy(*place, "_y0", "_y1").agg(F.collect_list(F.struct(*BOX, "a", "b")).alias("r"))
    kept, on = [*by, "_y0", "_y1"], OPERATIONS[op]
    schema = T.StructType([*[T.StructField(c, whole.schema[c].dataType) for c in kept], *[T.StructField(c, T.LongType()) for c in BOX]])
    return whole.select(*kept, "r").mapInArrow(lambda batches: swept_tiles(batches, on, joined, gaps), schema)


def two_sides(a: DataFrame, b: DataFrame | None, by: list[str]) -> DataFrame:
    """Both layers in one table with a flag per side."""
    left = a.select(*by, *BOX, F.lit(1).alias("a"), F.lit(0).alias("b"))
    if b is None:
        return left
    return left.union(b.select(*by, *BOX, F.lit(0).alias("a"), F.lit(1).alias("b")))


def boolean_rects(a: DataFrame, b: DataFrame | None, by: list[str], op: str, per_tile: int = PER_TILE) -> DataFrame:
    """Disjoint rectangles that cover exactly ``a op b`` (or, and, not, xor)."""
    return slab_intervals(two_sides(a, b, by), by, op, 0, per_tile, joined=True).select(*by, *BOX)


def rect_area() -> Column:
    return (F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))


def merged_area(shapes: DataFrame, by: list[str], per_tile: int = PER_TILE) -> DataFrame:
    """Area of the union per group."""
    return boolean_rects(shapes, None, by, "or", per_tile).groupBy(*by).agg(F.sum(rect_area()).alias("area"))


def layer_and(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Where both layers are."""
    return boolean_rects(a, b, by, "and")


def layer_or(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Where at least one layer is."""
    return boolean_rects(a, b, by, "or")


def layer_not(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Where the first layer is and the second is not."""
    return boolean_rects(a, b, by, "not")
