"""Sums of windows: the cost of a line of cells grows with its length."""

from wafermill.operators import spatial


def test_no_frame_is_read_anew_for_every_cell(spark):
    cells = spark.range(60).selectExpr("1 AS g", "id DIV 6 AS cx", "id % 6 AS cy", "id * id AS covered")
    got = spatial._box_sums(cells, ["g"], "covered", {"cx": 3, "cy": 2})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "currentrow$(), unboundedfollowing$()" not in plan
    value = {(k // 6, k % 6): k * k for k in range(60)}
    want = {(x, y): sum(value.get((x + i, y + j), 0) for i in range(3) for j in range(2)) for x in range(10) for y in range(6)}
    assert {(r.cx, r.cy): r.covered for r in got.collect()} == want
