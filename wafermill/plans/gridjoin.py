"""Pairs of nearby rectangles as an equi-join on grid cells.

Each axis has its own pyramid of grids. A rectangle lives, along each axis, on the first level
whose cells are at least as long as the grown rectangle, so it touches at most two cells an
axis, whatever its shape: a long wire has long, flat cells. Two rectangles meet on the coarser
of their levels along each axis. So along each axis one of them is on its own level, which
makes four cases; a rectangle is only sent to levels that rectangles of the other table have.

The levels of an axis follow the sizes in the data: of the powers of two in use, RUNGS at most are
kept, so that a rectangle goes to few pairs of levels however mixed the sizes are, and those are
kept that make the cells fit most rectangles best. Sizes that are much alike share one level, and all
do where the cells of the largest hold few rectangles.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import eq, ge, gt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.session import cut_lineage

BOX = ["xl", "yl", "xh", "yh"]
#: Levels an axis at most.
RUNGS = 3
#: Rectangles in a cell of the largest size, as a rectangle finds them, up to which it is the only level.
THIN = 16
#: Whether a pair meets on the level of its first rectangle, along x and y.
CASES = [(True, True), (True, False), (False, True), (False, False)]


def ladder(counts: dict[int, int], rungs: int = RUNGS) -> list[int]:
    """The sizes (exponents of two) to keep for the given numbers of rectangles by size.

    Each rectangle goes to the next rung. For every number of rungs those are chosen for which the
    cells are the least too long, summed over the rectangles; of these choices the one that balances
    long cells (more candidates) with many rungs (more rows a rectangle) is taken.
    """
    sizes = sorted(counts)

    def waste(low: int, top: int) -> float:
        return sum(counts[sizes[k]] * 2.0 ** (sizes[top] - sizes[k]) for k in range(low, top + 1))

    best = {top: (waste(0, top), [sizes[top]]) for top in range(len(sizes))}
    choices = []
    for n in range(1, rungs + 1):
        if sizes:
            least, chosen = best[len(sizes) - 1]
            choices.append((math.sqrt(least) * (n + 1), chosen))
        best = {
            top: min([best[top]] + [(best[low][0] + waste(low + 1, top), [*best[low][1], sizes[top]]) for low in range(top)])
            for top in range(len(sizes))
        }
    return min(choices)[1] if choices else []


def _level(side: Column) -> Column:
    """Smallest power of two that is at least ``side``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side.cast("double"), F.lit(1.0))))).cast("int")


def _floor_div(value: Column, size: Column) -> Column:
    return F.floor(value.cast("double") / size).cast("long")


def _levelled(df: DataFrame) -> DataFrame:
    for axis in ("x", "y"):
        df = df.withColumn(f"_l{axis}", _level(F.col(f"{axis}h") - F.col(f"{axis}l") + 2 * F.col("_g")))
    return df.where("_lx IS NOT NULL AND _ly IS NOT NULL")


def _levels(df: DataFrame) -> dict[tuple[int, int], int]:
    """The pairs of sizes in use, at most one for each two powers of two, and how many have them."""
    return {(r["_lx"], r["_ly"]): r["count"] for r in df.groupBy("_lx", "_ly").count().collect()}


def _ladders(*levels: dict[tuple[int, int], int]) -> list[dict[int, int]]:
    """For each axis the rung of every size in use on either side."""
    out = []
    for axis in (0, 1):
        counts: dict[int, int] = {}
        for side in levels:
            for pair, n in side.items():
                counts[pair[axis]] = counts.get(pair[axis], 0) + n
        rungs = ladder(counts)
        out.append({size: next(r for r in rungs if r >= size) for size in counts})
    return out


def _thin(sides: list[DataFrame], by: list[str], tops: list[int]) -> bool:
    """Whether cells of the sizes ``tops`` hold THIN rectangles of a side or fewer.

    All rectangles are counted, each in the cell of its lower-left corner, and a full cell counts for every
    rectangle in it. A rectangle touches four cells at most, so with one level there are no more than
    8 THIN candidates for each, wherever the rectangles lie.
    """
    cells = [_floor_div(F.col(f"{axis}l"), F.lit(2.0**top)).alias(f"_c{axis}") for axis, top in zip("xy", tops)]
    homes = [df.select(F.lit(n).alias("_side"), F.xxhash64(*by).alias("_cell"), *cells) for n, df in enumerate(sides)]
    counts = reduce(DataFrame.union, homes).groupBy("_side", "_cell", "_cx", "_cy").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("met")).first()
    return seen["met"] <= THIN * seen["n"]


def _on_rungs(df: DataFrame, ladders: list[dict[int, int]]) -> DataFrame:
    for axis, rungs in zip(("_lx", "_ly"), ladders):
        level = F.col(axis)
        for size, rung in rungs.items():
            if size != rung:
                level = F.when(F.col(axis) == size, rung).otherwise(level)
        df = df.withColumn(axis, level)
    return df


def _placed(df: DataFrame, places: Column) -> DataFrame:
    """One row for each place (case and two levels) and cell that a rectangle touches there."""
    out = df.withColumn("_at", F.explode(places))
    for axis in ("x", "y"):
        size = F.pow(F.lit(2.0), F.col(f"_at.{axis}")).cast("long")
        low = _floor_div(F.col(f"{axis}l") - F.col("_g"), size)
        high = _floor_div(F.col(f"{axis}h") + F.col("_g"), size)
        out = out.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    return out


def placed_sides(
    a: DataFrame, b: DataFrame, by: list[str], grow: Column | int = 0, carry: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join: a row for each place and cell of a rectangle."""
    grow = F.lit(grow) if isinstance(grow, int) else grow
    kept = ["id", *BOX, *(carry or [])]
    own = [*by, *kept]
    first = cut_lineage(_levelled(a.withColumn("_g", grow.cast("long"))).select(*own, "_g", "_lx", "_ly"))
    second = _levelled((first if a is b else b).select(*own).withColumn("_g", F.lit(0).cast("long")))
    second = cut_lineage(second.select(*own, "_g", "_lx", "_ly"))
    of_a, of_b = _levels(first), _levels(second)
    ladders = _ladders(of_a, of_b)
    tops = [max(rungs.values(), default=0) for rungs in ladders]
    if any(len(set(rungs.values())) > 1 for rungs in ladders) and _thin([first] if a is b else [first, second], by, tops):
        ladders = [dict.fromkeys(rungs, top) for rungs, top in zip(ladders, tops)]
    of_a, of_b = ({(ladders[0][x], ladders[1][y]) for x, y in pairs} for pairs in (of_a, of_b))
    first, second = _on_rungs(first, ladders), _on_rungs(second, ladders)
    # The level of a pair along an axis is that of a, or of b if it is the coarser one: four cases.
    cases = [(p[0] >= q[0], p[1] >= q[1], max(p[0], q[0]), max(p[1], q[1])) for p in of_a for q in of_b]
    lx, ly = F.col("_lx"), F.col("_ly")

    def places(tests: list[tuple]) -> Column:
        """For each case the places where a pair can meet and for which the tests of both axes hold."""
        kind = "array<struct<case:int,x:int,y:int>>"
        found = [F.array().cast(kind)]
        for case, (along_x, along_y) in enumerate(tests, 1):
            met = sorted({(x, y) for of_ax, of_ay, x, y in cases if (of_ax, of_ay) == CASES[case - 1]})
            items = [F.struct(F.lit(case).alias("case"), F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in met]
            if items:
                found.append(F.filter(F.array(*items).cast(kind), fits(along_x, along_y)))
        return F.concat(*found)

    def fits(along_x, along_y):
        return lambda p: along_x(p["x"], lx) & along_y(p["y"], ly)

    places_a = places([(eq if of_ax else gt, eq if of_ay else gt) for of_ax, of_ay in CASES])
    places_b = places([(ge if of_ax else eq, ge if of_ay else eq) for of_ax, of_ay in CASES])

    def side(df: DataFrame, tag: str, places: Column) -> DataFrame:
        place = F.col("_at.case") * 10_000 + F.col("_at.x") * 100 + F.col("_at.y")
        return _placed(df, places).select(
            *[F.col(c).alias(f"{tag}_{c}") for c in [*by, *kept]], place.alias(f"{tag}__place"),
            F.xxhash64(*by, place).alias("_cell"), "_cx", "_cy", *([F.col("_at.x").alias("_px"), F.col("_at.y").alias("_py"), "_g"] if tag == "a" else []),
        )

    return side(first, "a", places_a), side(second, "b", places_b)


def candidates(
    a: DataFrame, b: DataFrame, by: list[str], grow: Column | int = 0, carry: list[str] | None = None
) -> DataFrame:
    """The pairs that share a cell, before their boxes are compared: what the join has to look at."""
    left, right = placed_sides(a, b, by, grow, carry)
    # Rows multiply after the point where their number was estimated: never broadcast them.
    met = left.join(right.hint("merge"), ["_cell", "_cx", "_cy"])
    # The digest stands for group and place; the groups and places themselves decide.
    same = F.col("a__place") == F.col("b__place")
    for c in by:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return met.where(same).select(*[F.col(f"a_{c}").alias(c) for c in by], *[c for c in met.columns if c not in {f"{t}_{k}" for t in "ab" for k in by}])


def near_pairs(
    a: DataFrame,
    b: DataFrame,
    by: list[str],
    grow: Column | int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """All (a, b) in the same ``by`` whose boxes touch once ``a`` is grown by ``grow``.

    Inputs carry ``by``, ``id``, ``xl``, ``yl``, ``xh``, ``yh``; ``grow`` may be a column
    of ``a``. Output has ``by``, ``a_id``, ``a_xl``.. and ``b_id``, ``b_xl``... A pair is
    kept only in the cell that holds the lower-left corner of the common box, so no
    ``distinct`` is needed. Columns named in ``carry`` come along from both sides. Null groups
    match each other. The inputs are written out once, since the levels and the join read them.
    """
    pairs = candidates(a, b, by, grow, carry)
    g = F.col("_g")
    for axis in ("x", "y"):
        size = F.pow(F.lit(2.0), F.col(f"_p{axis}")).cast("long")
        low, high = F.col(f"a_{axis}l") - g, F.col(f"a_{axis}h") + g
        pairs = pairs.where(
            (low <= F.col(f"b_{axis}h"))
            & (high >= F.col(f"b_{axis}l"))
            & (_floor_div(F.greatest(low, F.col(f"b_{axis}l")), size) == F.col(f"_c{axis}"))
        )
    return pairs.select(*by, *[f"{t}_{c}" for t in ("a", "b") for c in ["id", *BOX, *(carry or [])]])


def gap_squared() -> Column:
    """Squared Euclidean gap between the boxes of a pair, 0 when they touch."""
    dx = F.greatest(F.lit(0).cast("long"), F.col("a_xl") - F.col("b_xh"), F.col("b_xl") - F.col("a_xh"))
    dy = F.greatest(F.lit(0).cast("long"), F.col("a_yl") - F.col("b_yh"), F.col("b_yl") - F.col("a_yh"))
    return dx * dx + dy * dy
