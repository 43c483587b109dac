"""The shared plans against brute force, with hot keys and copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafermill.operators import boolean, coverage, design, nets, spatial
from wafermill.plans.attach import attach
from wafermill.plans.components import connected_components
from wafermill.plans.expand import numbered_rows
from wafermill.plans.gridjoin import candidates, ladder, near_pairs, placed_sides
from wafermill.plans.metricindex import MetricIndex
from wafermill.plans.quantiles import exact_percentiles
from wafermill.plans.ranks import hash_rank, range_rank, running_sums

SCHEMA = "component int, shape_id bigint, layer string, xl bigint, yl bigint, xh bigint, yh bigint"


def hot_rows(n=3000):
    rng = random.Random(1)
    return [("hot" if i % 10 < 7 else f"k{i % 50}", i, float(rng.randrange(40))) for i in range(n)]


def test_range_rank_with_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, x double").repartition(8)
    got = {r.id: r.r for r in range_rank(df, ["k"], [F.col("x").desc(), F.col("id").asc()], "r", 8).collect()}
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in order] == list(range(1, len(order) + 1))


def test_range_rank_spreads_a_hot_key(spark):
    df = spark.createDataFrame(hot_rows(), "k string, id bigint, x double")
    keys = [F.col("k"), F.col("x").desc(), F.col("id")]
    sizes = df.repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.4 * 3000


def test_hash_rank(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, x double").withColumn("t", F.md5(F.col("id").cast("string")))
    got = hash_rank(df, ["k"], "t", ["id"], "r", 1).collect()
    for key in {r.k for r in got}:
        part = sorted((r for r in got if r.k == key), key=lambda r: r.t)
        assert [r.r for r in part] == list(range(1, len(part) + 1))


def test_running_sums(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, x double").repartition(5)
    got = {r.id: r.s for r in running_sums(df, ["k"], [F.col("id").asc()], {"s": F.col("x")}, 6).collect()}
    total = {}
    for key, i, x in rows:
        total[key] = total.get(key, 0) + x
        assert got[i] == total[key]


def test_exact_percentiles(spark):
    rows = hot_rows()
    df = spark.createDataFrame([*rows, ("hot", -1, None)], "k string, id bigint, x double")
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for r in exact_percentiles(df, ["k"], "x", points).collect():
        values = [x for k, _, x in rows if k == r.k]
        assert [r[n] for n in points] == pytest.approx(np.percentile(values, [100 * p for p in points.values()]).tolist())


def test_numbered_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 70000)], "k int, n int")
    got = numbered_rows(df, F.col("n"), "i", ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b"))
    assert sorted(map(tuple, got.collect())) == [(2, 3, 0, 2), (3, 70000, 0, 69999)]


def test_attach_without_broadcast(spark, monkeypatch):
    import wafermill.plans.attach as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = attach(spark.range(10).withColumn("k", F.col("id") % 3), spark.range(2).withColumnRenamed("id", "k"), ["k"])
        assert got.count() == 7 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_components(edges):
    label = {}
    for u, v in edges:
        label.setdefault(u, u)
        label.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(label[u], label[v])
            if label[u] != m or label[v] != m:
                label[u] = label[v] = m
                changed = True
    return label


@pytest.mark.parametrize("per_task", [1 << 20, 100])
def test_components_of_chain_star_and_noise(spark, per_task):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    noise = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = chain + star + [e for e in noise if e[0] != e[1]]
    df = spark.createDataFrame([(1, u, v) for u, v in edges], "g int, u bigint, v bigint")
    got = {r.node: r.label for r in connected_components(df, ["g"], per_task).collect()}
    assert got == brute_components(edges)


def random_shapes(n, seed, span=1500, copies=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(-span // 2, span), rng.randrange(-span // 2, span)
        w, h = (rng.randrange(400, 1500), rng.randrange(400, 1500)) if i % 50 == 0 else (rng.randrange(5, 60), rng.randrange(5, 60))
        rows.append((i % 2, i, f"l{i % 3}", x, y, x + w, y + h))
    rows += [(0, n + i, "l0", 10, 10, 40, 40) for i in range(copies)]
    return rows


def gap2(a, b):
    dx, dy = max(0, a[3] - b[5], b[3] - a[5]), max(0, a[4] - b[6], b[4] - a[6])
    return dx * dx + dy * dy


def test_near_pairs_equal_all_pairs(spark):
    rows = random_shapes(300, 5, copies=0)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shape_id", "id")
    got = {(r.a_id, r.b_id) for r in near_pairs(df, df, ["component"], 17).collect()}
    want = {
        (a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[3] - 17 <= b[5] and a[5] + 17 >= b[3] and a[4] - 17 <= b[6] and a[6] + 17 >= b[4]
    }
    assert got == want
    assert near_pairs(df, df, ["component"], 17).count() == len(want)


def wires_and_squares():
    wires = [(0, k, "l", 0, 100 * k, 1_000_000, 100 * k + 10) for k in range(400)]
    rng = random.Random(5)
    squares = [(0, 1000 + k, "l", x, y, x + 40, y + 40) for k in range(600) for x, y in [(rng.randrange(10**6), rng.randrange(10**6, 2 * 10**6))]]
    return wires, squares


def test_long_wires_meet_their_neighbours_only(spark):
    wires, squares = wires_and_squares()

    def looked_at(rows):
        df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shape_id", "id")
        return candidates(df, df, ["component"], 20).count()

    alone, small = looked_at(wires), looked_at(squares)
    assert alone < 12 * len(wires) and small < 12 * len(squares)
    assert looked_at(wires + squares) < 4 * (alone + small)
    turned = [(c, i, layer, yl, xl, yh, xh) for c, i, layer, xl, yl, xh, yh in wires]
    assert looked_at(turned) == alone


def test_mixed_sizes_go_to_few_levels(spark):
    rng = random.Random(6)
    side = lambda: int(2 ** rng.uniform(0, 11))
    rows = [(0, k, "l", x, y, x + side(), y + side()) for k in range(2000) for x, y in [(rng.randrange(60_000), rng.randrange(60_000))]]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shape_id", "id")
    left, right = placed_sides(df, df, ["component"])
    assert left.count() + right.count() < 20 * len(rows)
    assert candidates(df, df, ["component"]).count() < 0.03 * len(rows) ** 2
    want = {(a[1], b[1]) for a in rows for b in rows if a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]}
    assert {(r.a_id, r.b_id) for r in near_pairs(df, df, ["component"]).collect()} == want


def test_thin_layers_have_one_level(spark):
    rng = random.Random(8)
    side = lambda: rng.choice([rng.randrange(20, 60), rng.randrange(140, 200)])
    rows = [(0, k, "l", x, y, x + side(), y + side()) for k in range(1200) for x, y in [(rng.randrange(7000), rng.randrange(7000))]]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shape_id", "id")
    left, right = placed_sides(df, df, ["component"], 5)
    assert left.count() + right.count() < 5 * len(rows)
    want = {(a[1], b[1]) for a in rows for b in rows if a[3] - 5 <= b[5] and b[3] <= a[5] + 5 and a[4] - 5 <= b[6] and b[4] <= a[6] + 5}
    assert {(r.a_id, r.b_id) for r in near_pairs(df, df, ["component"], 5).collect()} == want
    # A dense spot of small rectangles beside a large one keeps small cells.
    spot = [(0, k, "l", x, y, x + 4, y + 4) for k in range(2000) for x, y in [(rng.randrange(1000), rng.randrange(1000))]]
    dense = spark.createDataFrame([*spot, (0, 9999, "l", 5000, 5000, 6000, 6000)], SCHEMA).withColumnRenamed("shape_id", "id")
    assert candidates(dense, dense, ["component"]).count() < 0.02 * len(spot) ** 2


def test_tiles_are_even_along_a_diagonal(spark):
    rng = random.Random(3)
    rows = [(0, k, "l", x, y, x + 30, y + 30) for k in range(20_000) for x in [rng.randrange(10**6)] for y in [x + rng.randrange(-500, 500)]]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = sorted(r["count"] for r in boolean.tiled(df, ["component"]).groupBy("tx", "ty").count().collect())
    assert sizes[-1] < 4 * 64 and len(sizes) > 200
    assert sum(sizes) < 1.4 * len(rows)


def test_ladder_keeps_the_sizes_in_use():
    assert ladder({3: 5, 7: 9}) == [3, 7] and ladder({}) == []
    assert ladder({k: 10 for k in range(12)})[-1] == 11 and len(ladder({k: 10 for k in range(12)})) == 3
    assert ladder({5: 21, 6: 52, 7: 26}) == [7]
    assert ladder({0: 1, 1: 10**6, 2: 1, 9: 1, 10: 10**6, 15: 1}) == [1, 10, 15]


def test_large_shapes_make_few_pieces(spark):
    rows = [(0, 1, "l", 0, 0, 10**6, 10**6), (0, 2, "l", 10**6, 0, 2 * 10**6, 10**6), (None, 3, "l", -5, -5, 10**9, 10**9)]
    pieces = boolean.layer_or(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA), ["component"]).collect()
    assert len(pieces) <= 6
    assert sum((r.xh - r.xl) * (r.yh - r.yl) for r in pieces) == 2 * 10**12 + (10**9 + 5) ** 2
    wires, squares = wires_and_squares()
    cover = (0, 9, "l", -100, -100, 3 * 10**6, 3 * 10**6)
    pieces = boolean.layer_or(spark.createDataFrame(wires + squares + [cover], SCHEMA), spark.createDataFrame([], SCHEMA), ["component"])
    assert pieces.agg(F.sum((F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl")))).first()[0] == (3 * 10**6 + 100) ** 2
    assert pieces.count() < 20 * (len(wires) + len(squares))


def test_null_groups_meet(spark):
    df = spark.createDataFrame([(None, 1, "l", 0, 0, 5, 5), (None, 2, "l", 5, 5, 9, 9), (1, 3, "l", 0, 0, 9, 9)], SCHEMA).withColumnRenamed("shape_id", "id")
    assert near_pairs(df, df, ["component"]).where("a_id < b_id").count() == 1


def test_copies_make_no_pairs_of_their_own(spark):
    rows = random_shapes(0, 1, copies=500) + [(0, 9000, "l0", 45, 10, 60, 40)]
    got = spatial.min_spacing(spark.createDataFrame(rows, SCHEMA), ["component", "layer"], 20, "space").collect()
    assert [(r.a_id, r.b_id, r.gap2) for r in got] == [(0, 9000, 25)]
    merged = spatial.merge_shapes(spark.createDataFrame(rows, SCHEMA), ["component", "layer"])
    assert merged.count() == 501 and merged.select("label").distinct().count() == 2


def test_spacing_equals_all_pairs(spark):
    rows = random_shapes(250, 8, copies=0)
    got = {(r.a_id, r.b_id) for r in spatial.min_spacing(spark.createDataFrame(rows, SCHEMA), ["component", "layer"], 25, "space").collect()}
    want = {
        (a[1], b[1]) for a in rows for b in rows
        if a[1] < b[1] and a[0] == b[0] and a[2] == b[2] and 0 < gap2(a, b) < 625
    }
    assert got == want


def raster(rows, low=-2000, high=4000):
    grid = np.zeros((high - low, high - low), bool)
    for r in rows:
        grid[r[3] - low:r[5] - low, r[4] - low:r[6] - low] = True
    return grid


def area(df):
    return df.agg(F.sum(boolean.rect_area())).first()[0] or 0


@pytest.mark.parametrize("op", ["or", "and", "not", "xor"])
def test_boolean_layers_equal_raster(spark, op):
    rows = [r for r in random_shapes(240, 11) if r[0] == 0]
    a, b = [r for r in rows if r[2] == "l0"], [r for r in rows if r[2] == "l1"]
    ga, gb = raster(a), raster(b)
    want = {"or": ga | gb, "and": ga & gb, "not": ga & ~gb, "xor": ga ^ gb}[op].sum()
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    assert area(boolean.boolean_rects(da, db, ["component"], op)) == want
    assert area(boolean.boolean_rects(da, db, ["component"], op, per_tile=5)) == want
    assert area(boolean.boolean_rects(da, db, ["component"], op, per_tile=10**6)) == want


def test_shrink_and_wide_parts_equal_raster(spark):
    rows = [r for r in random_shapes(300, 21) if r[0] == 0]
    grid = raster(rows)
    c = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
    c[1:, 1:] = grid.cumsum(0).cumsum(1)
    d = 6
    k = 2 * d + 1
    full = (c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) == k * k
    df = spark.createDataFrame(rows, SCHEMA)
    shrunk = spatial.grow_shrink(df, ["component"], -d)
    assert area(shrunk) == full.sum()
    opened = np.zeros_like(grid)
    for x, y in zip(*np.nonzero(full), strict=True):
        opened[x:x + k, y:y + k] = True
    assert area(boolean.boolean_rects(spatial.wide_parts(df, ["component"], 2 * d), None, ["component"], "or")) == opened.sum()


@pytest.mark.parametrize("dims", [1, 2, 3, 16])
def test_nearest_neighbour_in_clusters(spark, dims):
    rng = np.random.default_rng(4)
    dense = rng.normal(0, 1e-4, (150, dims))
    wide = rng.uniform(-1, 1, (60, dims))
    points = np.vstack([dense, wide, dense[:5], [[7.0] * dims]])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(points)] + [(2, 999, *[0.5] * dims)]
    names = [f"u{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "f int, id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.nn_distance for r in coverage.nearest_neighbour(df, ["f"], "id", names).collect()}
    for i, p in enumerate(points):
        distance = np.sqrt(((points - p) ** 2).sum(1))
        distance[i] = np.inf
        assert got[i] == pytest.approx(distance.min(), rel=1e-12, abs=1e-15)
    assert got[999] is None
    small = {r.f: r.min_distance for r in coverage.min_pairwise_distance(df, ["f"], "id", names).collect()}
    assert small == {1: 0.0, 2: 0.0}


def test_metric_index_compares_few_pairs_of_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.uniform(-1, 1, (25, 16))
    points = np.vstack([c + rng.normal(0, 0.02, (80, 16)) for c in centres])
    rows = [(None if i % 2 else "f", i, p.tolist()) for i, p in enumerate(points)]
    index = MetricIndex(spark.createDataFrame(rows, "f string, id bigint, v array<double>"), ["f"], 16)
    pairs = index.own_ring_pairs().count() + index.visiting_pairs(index.bounded()).count()
    assert pairs < 0.1 * 2 * 1000 * 999
    got = {r.id: r.nearest for r in index.nearest().collect()}
    for part in (0, 1):
        mine = points[part::2]
        for k, p in enumerate(mine):
            distance = np.sqrt(((mine - p) ** 2).sum(1))
            distance[k] = np.inf
            assert got[2 * k + part] == pytest.approx(distance.min(), rel=1e-12)


def test_nearest_neighbour_of_odd_points(spark):
    rows = [(None, 1, 0.0, 0.0), (None, 2, 3.0, 4.0), (None, 3, None, 1.0), (None, 4, float("nan"), 1.0), (None, 5, float("inf"), 1.0), ("a", 6, 0.0, -0.0), ("a", 7, 0.0, 0.0), ("b", 8, 1.0, 1.0)]
    got = coverage.nearest_neighbour(spark.createDataFrame(rows, "f string, id bigint, x double, y double"), ["f"], "id", ["x", "y"])
    assert {r.id: r.nn_distance for r in got.collect()} == {1: 5.0, 2: 5.0, 3: None, 4: None, 5: None, 6: 0.0, 7: 0.0, 8: None}


def test_nets_follow_declared_layers_only(spark):
    rows = [(0, 1, "m1", 0, 0, 10, 10), (0, 2, "v1", 5, 5, 8, 8), (0, 3, "m2", 6, 6, 20, 20), (0, 4, "po", 0, 0, 9, 9), (0, 5, "m1", 10, 0, 12, 5)]
    got = {r.shape_id: r.net for r in nets.extract_nets(spark.createDataFrame(rows, SCHEMA), [("m1", "v1"), ("m2", "v1")]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4}
    with pytest.raises(ValueError):
        nets.net_aware_spacing(spark.createDataFrame(rows, SCHEMA), "m1", "m1", 5, 3)


def test_budgets(spark):
    dims = spark.createDataFrame([(1, i, d, 10) for i, d in enumerate([1, 1, 1, 1])], "plan int, idx int, d int, n int")
    got = {r.idx: r.budget for r in design.allocate_budget(dims, ["plan"], "n", "d", "idx").collect()}
    assert got == {0: 2, 1: 2, 2: 3, 3: 3}
    none = spark.createDataFrame([(1, 0, 1, 7, [7, 100000])], "plan int, idx int, d int, start int, levels array<int>")
    with pytest.raises(ValueError):
        design.find_valid_budget(none, "plan", "start", "d", "idx", "levels", max_search=50)


def test_hypercube_has_one_point_per_cell(spark):
    plans = spark.createDataFrame([("a", "x", 500), ("a", "y", 500)], "pcell string, axis string, n int")
    for axis in ("x", "y"):
        cells = [int(r.u * 500) for r in design.latin_hypercube(plans, ["pcell"], "axis", "n", "s").where(F.col("axis") == axis).collect()]
        assert sorted(cells) == list(range(500))


def test_levels_are_balanced_and_strict(spark):
    plans = spark.createDataFrame([("a", "x", 300, 1, 5)], "pcell string, axis string, n int, min int, max int")
    got = design.balanced_int_levels(plans, ["pcell"], "axis", "n", "s", strict=True).groupBy("level").count().collect()
    assert sorted((r.level, r["count"]) for r in got) == [(i, 60) for i in range(1, 6)]
    odd = plans.withColumn("n", F.lit(7))
    with pytest.raises(Exception, match="not a multiple"):
        design.balanced_int_levels(odd, ["pcell"], "axis", "n", "s", strict=True).collect()


def test_full_sweep_size_and_vectors(spark):
    got = design.full_sweep(spark).agg(F.count("*").alias("n"), F.count_distinct("index").alias("d"), F.min(F.size("params")).alias("k")).first()
    assert (got.n, got.d, got.k) == (787320, 787320, 18)


def test_t_distribution_tail():
    from wafermill.functions.student_t import t_tail

    # Table values: two-sided 5 % and 1 % points.
    t = np.array([12.706205, 2.228139, 2.008559, 63.656741, 1.962339, 0.0])
    df = np.array([1.0, 10.0, 50.0, 1.0, 1000.0, 5.0])
    assert t_tail(t, df) == pytest.approx([0.05, 0.05, 0.05, 0.01, 0.05, 1.0], abs=5e-7)


def test_split_sizes_are_exact(spark):
    from wafermill.operators.training import train_eval_split

    for n in (1, 9, 10, 101):
        got = train_eval_split(spark.range(n), "id", "s").where("split = 'train'").count()
        assert got == int(0.9 * n)


def no_index(*_):
    raise AssertionError("these points need no metric index")


def test_small_families_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MetricIndex", no_index)
    rng = np.random.default_rng(9)
    points = rng.uniform(0, 1, (900, 2))
    rows = [(i % 300, i, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "f int, id bigint, x double, y double")
    got = {r.f: r.min_distance for r in coverage.min_pairwise_distance(df, ["f"], "id", ["x", "y"]).collect()}
    for f in range(300):
        a, b, c = points[f::300]
        assert got[f] == pytest.approx(min(np.hypot(*(a - b)), np.hypot(*(a - c)), np.hypot(*(b - c))), rel=1e-12)


@pytest.mark.parametrize("offset, spread", [(0.0, 1.0), (1e6, 1e-3), (0.0, 1e-200), (0.0, 1e150)])
def test_blocks_of_points_over_many_axes(spark, monkeypatch, offset, spread):
    from wafermill.plans import blockpairs

    monkeypatch.setattr(coverage, "MetricIndex", no_index)
    monkeypatch.setattr(blockpairs, "STRIPE", 50)
    monkeypatch.setattr(blockpairs, "ROWS", 16)
    monkeypatch.setattr(blockpairs, "MEASURED", 100)
    rng = np.random.default_rng(10)
    points = offset + spread * rng.normal(0, 1, (240, 24))
    names = [f"u{i}" for i in range(24)]
    rows = [(None if i % 2 else "f", i, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "f string, id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.nn_distance for r in coverage.nearest_neighbour(df, ["f"], "id", names).collect()}
    for i, p in enumerate(points):
        distance = np.sqrt(((points - p) ** 2).sum(1))
        distance[i] = distance[1 - i % 2 :: 2] = np.inf
        assert got[i] == pytest.approx(distance.min(), rel=1e-12, abs=0)


@pytest.mark.parametrize("turned", [False, True])
def test_a_long_layer_is_not_cut_into_flat_tiles(spark, turned):
    rng = random.Random(3)
    rows = [(0, k, "l", x, y, x + 60, y + 60) for k in range(20_000) for x, y in [(rng.randrange(5 * 10**6), rng.randrange(1000))]]
    if turned:
        rows = [(c, k, layer, yl, xl, yh, xh) for c, k, layer, xl, yl, xh, yh in rows]
    sizes = [r["count"] for r in boolean.tiled(spark.createDataFrame(rows, SCHEMA), ["component"], halo=10).groupBy("tx", "ty").count().collect()]
    assert sum(sizes) < 1.3 * len(rows) and max(sizes) < 4 * 64 and len(sizes) > 200


def test_tiles_in_two_steps_equal_raster(spark, monkeypatch):
    monkeypatch.setattr(boolean, "MOST_PLACES", 2)
    monkeypatch.setattr(boolean, "SAMPLED", 2)
    monkeypatch.setattr(boolean, "PER_TASK", 10)
    rows = [r for r in random_shapes(400, 23) if r[0] == 0]
    grid, df = raster(rows), spark.createDataFrame(rows, SCHEMA)
    pieces = boolean.boolean_rects(df, None, ["component"], "or", per_tile=3)
    assert area(pieces) == grid.sum()
    assert (raster([(0, 0, "l", r.xl, r.yl, r.xh, r.yh) for r in pieces.collect()]) == grid).all()
    sides = boolean.two_sides(df, None, ["component"])
    runs = boolean.slab_intervals(sides, ["component"], "or", 9, per_tile=3).where("yl >= _y0 AND yl < _y1 AND yh - yl < 9")
    inside = np.pad(grid, ((0, 0), (1, 1)))
    short = 0
    for line in inside:
        turns = np.flatnonzero(np.diff(line.astype(int)))
        lengths = turns[1::2] - turns[::2]
        short += lengths[lengths < 9].sum()
    assert area(runs) == short
