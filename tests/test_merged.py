"""Checks on merged layers: seams between abutting rectangles are no edges. Null components stay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafermill.operators import boundary, nets, ports, shapes, spatial

SCHEMA = "component int, shape_id bigint, layer string, xl bigint, yl bigint, xh bigint, yh bigint"
RULES = "glayer1 string, glayer2 string, rule string, value int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_boxes(rng, n, span, layer="m", start=0):
    rows = []
    for k in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        rows.append((None if k % 3 == 0 else 1, start + k, layer, x, y, x + rng.randint(1, span // 4), y + rng.randint(1, span // 4)))
    return rows


def grid(rows, span):
    full = np.zeros((2 * span, 2 * span), bool)
    for *_, xl, yl, xh, yh in rows:
        full[xl:xh, yl:yh] = True
    return full


def slow_edges(full):
    """Maximal boundary edges of a bitmap: (side, xl, yl, xh, yh)."""
    out = set()
    padded = np.pad(full, 1)
    for side, turned, name in (("x", padded, ("left", "right")), ("y", padded.T, ("bottom", "top"))):
        step = turned[1:].astype(int) - turned[:-1].astype(int)
        for at, line in enumerate(step):
            for sign, which in ((1, name[0]), (-1, name[1])):
                hit = np.flatnonzero(line == sign)
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    if len(run):
                        lo, hi = int(run[0]) - 1, int(run[-1])
                        out.add((which, at, lo, at, hi) if side == "x" else (which, lo, at, hi, at))
    return out


def test_boundary_edges_equal_bitmap(spark):
    rows = random_boxes(random.Random(4), 60, 60)
    got = boundary.boundary_edges(frame(spark, rows), ["component"]).collect()
    for component in (None, 1):
        want = slow_edges(grid([r for r in rows if r[0] == component], 60))
        mine = [(r.side, r.xl, r.yl, r.xh, r.yh) for r in got if r.component == component]
        assert len(mine) == len(set(mine)) and set(mine) == want
    assert all(r.length == r.xh - r.xl + r.yh - r.yl for r in got)


def test_seams_are_no_edges(spark):
    rows = [(None, k, "m", 10 * k, 0, 10 * k + 10, 7) for k in range(200)]
    got = spatial.edge_length_filter(frame(spark, rows), ["component"], 0, 10**6).collect()
    assert sorted((r.side, r.length) for r in got) == [("bottom", 2000), ("left", 7), ("right", 7), ("top", 2000)]
    assert spatial.edge_length_filter(frame(spark, rows), ["component"], 7, inside=False).count() == 2


def test_enclosure_at_a_seam(spark):
    outer = frame(spark, [(None, 1, "o", 0, 0, 50, 50), (None, 2, "o", 50, 0, 100, 50)])
    inner = lambda *box: frame(spark, [(None, 9, "i", *box)])
    assert spatial.min_enclosure(outer, inner(10, 10, 45, 40), ["component"], 8).count() == 0
    assert spatial.min_enclosure(outer, inner(30, 10, 70, 40), ["component"], 8).count() == 0
    assert [tuple(r) for r in spatial.min_enclosure(outer, inner(30, 3, 70, 40), ["component"], 8).collect()] == [(None, 9, 3)]
    assert spatial.min_enclosure(outer, inner(30, 3, 170, 40), ["component"], 8).count() == 0
    two = frame(spark, [(None, 5, "i", 10, 10, 20, 20), (None, 4, "i", 20, 10, 99, 20)])
    assert [tuple(r) for r in spatial.min_enclosure(outer, two, ["component"], 8).collect()] == [(None, 4, 1)]


def test_enclosure_equals_bitmap(spark):
    rng = random.Random(11)
    outer = random_boxes(rng, 40, 80, "o")
    inner = [(c, i, "i", x, y, x + w, y + h) for c, i, _, x, y, *_ in random_boxes(rng, 60, 80, start=1000) for w, h in [(rng.randint(1, 6), rng.randint(1, 6))]]
    got = {(r.component, r.label): r.margin for r in spatial.min_enclosure(frame(spark, outer), frame(spark, inner), ["component"], 5).collect()}
    want = {}
    for component in (None, 1):
        full = np.pad(grid([r for r in outer if r[0] == component], 80), 10)
        mine = [r for r in inner if r[0] == component]
        label = {r[1]: r[1] for r in mine}
        for _ in mine:
            for a in mine:
                for b in mine:
                    if a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]:
                        label[a[1]] = label[b[1]] = min(label[a[1]], label[b[1]])
        for name in set(label.values()):
            def margin(box):
                xl, yl, xh, yh = (v + 10 for v in box)
                m = -1
                while m < 6 and full[xl - m - 1 : xh + m + 1, yl - m - 1 : yh + m + 1].all():
                    m += 1
                return m if full[xl:xh, yl:yh].all() else -1

            least = min(margin(r[3:]) for r in mine if label[r[1]] == name)
            if 0 <= least < 5:
                want[component, name] = least
    assert got == want and want


def test_rule_table_on_merged_shapes(spark):
    rules = spark.createDataFrame([("m", "m", "min_width", 30), ("m", "m", "min_separation", 12), ("m", "v", "min_enclosure", 6)], RULES)
    cut = [(None, 1, "m", 0, 0, 10, 100), (None, 2, "m", 10, 0, 100, 100), (None, 3, "v", 4, 20, 30, 40)]
    got = [(r.rule, r.a_id, r.b_id, r.measured, r.xl, r.xh) for r in spatial.check_rule_table(frame(spark, cut), rules).collect()]
    assert got == [("min_enclosure", None, 3, 4.0, None, None)]
    strips = [(None, 1, "m", 0, 0, 100, 10), (None, 2, "m", 100, 0, 200, 10), (None, 5, "m", 0, 18, 200, 60), (None, 6, "m", 0, 60, 200, 70), (None, 7, "m", 0, 70, 200, 75)]
    got = sorted((r.rule, r.a_id or 0, r.b_id or 0, r.measured, r.xl, r.xh) for r in spatial.check_rule_table(frame(spark, strips), rules).collect())
    assert got == [("min_separation", 1, 5, 8.0, None, None), ("min_separation", 2, 5, 8.0, None, None), ("min_width", 0, 0, 10.0, 0, 200)]


BY = ["component", "layer"]


def test_null_components_stay_in_every_operator(spark):
    rows = [(None, 1, "m", 0, 0, 10, 10), (None, 2, "m", 10, 0, 20, 10), (None, 3, "m", 25, 0, 40, 10), (None, 4, "v", 2, 2, 8, 8)]
    df = frame(spark, rows)
    m, v = df.where("layer = 'm'"), df.where("layer = 'v'")
    assert {r.shape_id: r.label for r in spatial.merge_shapes(df, BY).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [(r.a_id, r.b_id, r.gap2) for r in spatial.min_spacing(df, BY, 10).collect()] == [(2, 3, 25)]
    assert spatial.min_spacing(df, BY, 16, "space").count() == 2
    assert spatial.min_separation(m, v, ["component"], 20).count() == 2
    assert {r.shape_id for r in spatial.interacting(m, v, ["component"]).collect()} == {1, 2}
    assert {r.shape_id for r in spatial.interacting(m, v, ["component"], negate=True).collect()} == {3}
    assert {r.shape_id for r in spatial.relation(v, m, ["component"], "inside").collect()} == {4}
    assert {r.shape_id for r in spatial.relation(m, v, ["component"], "outside").collect()} == {2, 3}
    assert {r.shape_id for r in spatial.relation(m, v, ["component"], "covering").collect()} == {1, 2}
    assert {r.shape_id: r.net for r in nets.extract_nets(df, [("m", "v")]).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert [(r.label, r.area) for r in spatial.area_filter(m, BY, 151, 300).collect()] == [(1, 200)]
    assert spatial.bbox_filter(m, BY, 16, 30).count() == 1
    assert spatial.overlap_min(m, v, ["component"], 8).count() == 2
    full = spatial.window_density(frame(spark, rows[:2]), BY, 10, 10, 0.5, 2.0)
    assert full.count() == 0
    off = shapes.symmetry_scores(frame(spark, [(None, 1, "m", 5, 5, 15, 15)]), ["component"]).first()
    assert (off.symmetry_horizontal, off.symmetry_vertical) == (-1.0, -1.0)
    moved = shapes.move_shapes(df, spark.createDataFrame([(None, 0, 0)], "component int, x int, y int"), to_centre=True)
    assert moved.agg(F.min("xl"), F.max("xh")).first()[:] == (-20, 20)


def test_inline_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ports, "PER_BUCKET", 7)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), k, rng.choice([0.0, 0.05, rng.uniform(-2, 2)]), rng.choice([3.0, rng.uniform(-2, 2)]), rng.choice([0, 90, 180, 270, -90, 45, 360])) for k in range(250)]
    rows += [(1, 1000, None, None, 0), (1, 1001, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "component int, port_id bigint, cx double, cy double, orientation int")
    got = [(r.component, r.a_id, r.b_id) for r in ports.find_inline_pairs(df, 0.1).collect()]
    want = set()
    for a in rows:
        for b in rows:
            if a[1] < b[1] and a[0] == b[0] and None not in (*a[2:], *b[2:]) and a[4] % 90 == b[4] % 90 == 0 and (a[4] - b[4]) % 180 == 0:
                low, high = sorted([a[2], b[2]] if a[4] % 180 else [a[3], b[3]])
                if not low < high - 0.1:
                    want.add((a[0], a[1], b[1]))
    assert len(got) == len(set(got)) and set(got) == want
