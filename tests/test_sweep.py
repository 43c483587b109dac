"""The sweep of tiles in arrays: the same boxes however few parts are swept at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafermill.operators import boolean
from wafermill.plans import sweep as sweeps

SCHEMA = "component int, shape_id bigint, layer string, xl bigint, yl bigint, xh bigint, yh bigint"


def boxes(n, seed, span=60):
    rng = random.Random(seed)
    low = [(rng.randrange(span), rng.randrange(span)) for _ in range(n)]
    return [(x, y, x + rng.randint(1, span // 3), y + rng.randint(1, span // 3)) for x, y in low]


@pytest.mark.parametrize("op", list(boolean.OPERATIONS))
@pytest.mark.parametrize("gaps", [False, True])
def test_any_chunk_gives_the_same_boxes(monkeypatch, op, gaps):
    rows = boxes(90, 5)
    tile = np.repeat([0, 1, 2], [40, 1, 49])
    box = {c: np.array([r[i] for r in rows]) for i, c in enumerate(boolean.BOX)}
    sides = tuple(np.array([int(k % 3 != s) for k in range(90)]) for s in (1, 2))

    def swept(joined):
        owner, got = sweeps.sweep(tile, box, sides, boolean.OPERATIONS[op], joined, gaps)
        return sorted(zip(owner.tolist(), *(got[c].tolist() for c in boolean.BOX)))

    whole, slabs = swept(True), swept(False)
    monkeypatch.setattr(sweeps, "PARTS", 7)
    assert swept(True) == whole and swept(False) == slabs
    for t in range(3):
        a, b = (np.zeros((100, 100), bool) for _ in range(2))
        for k in np.flatnonzero(tile == t):
            xl, yl, xh, yh = rows[k]
            a[xl:xh, yl:yh] |= bool(sides[0][k])
            b[xl:xh, yl:yh] |= bool(sides[1][k])
        grid = boolean.OPERATIONS[op](a, b)
        if gaps:
            grid = np.array([[not v and line[:y].any() and line[y:].any() for y, v in enumerate(line)] for line in grid])
        for found in (whole, slabs):
            seen = np.zeros((100, 100), int)
            for owner, xl, yl, xh, yh in found:
                if owner == t:
                    seen[xl:xh, yl:yh] += 1
            assert (seen == grid).all()


def test_slabs_are_no_rows_of_a_sort(spark):
    """Parts of rectangles in slabs stay in arrays: no aggregate, sort or window runs over them."""
    rows = [(1, k, "l", *b) for k, b in enumerate(boxes(200, 8, 400))]
    sides = boolean.two_sides(spark.createDataFrame(rows, SCHEMA), None, ["component"])
    runs = boolean.slab_intervals(sides, ["component"], "or", joined=True)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    assert runs.agg(F.count(F.lit(1))).first()[0] > 0


def test_a_tile_of_many_overlaps(spark):
    """A pile of rectangles that no tile border can part is swept in bounded pieces."""
    n = 1500
    rows = [(1, k, "l", k, k, 4 * n - k, 4 * n - k) for k in range(n)] + [(None, 0, "l", 0, 0, 1, 1)]
    got = boolean.boolean_rects(spark.createDataFrame(rows, SCHEMA), None, ["component"], "or").collect()
    assert sum((r.xh - r.xl) * (r.yh - r.yl) for r in got) == (4 * n) ** 2 + 1
