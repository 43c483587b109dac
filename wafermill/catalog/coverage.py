"""Queries over design coverage."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import AXES, run_sql, view, with_views
from wafermill.operators import coverage

AXIS_VALUES = """
SELECT o_orderkey AS sample_id, concat('f', o_orderkey % 6) AS pcell, concat('a', k) AS axis, k AS pos, CAST(o_custkey % 50 + k AS DOUBLE) AS value
FROM {orders} {each k 2}
"""
AXIS_SPECS = """
SELECT concat('f', n_nationkey) AS pcell, concat('a', k) AS axis, CAST(n_regionkey AS DOUBLE) AS min, CAST(n_nationkey + 60 AS DOUBLE) AS max
FROM {nation} {each k 2}
"""


@query(
    "normalise_axes",
    with_views(v=AXIS_VALUES, s=AXIS_SPECS) + "SELECT sample_id, v.pcell, v.axis, pos, value, (value - min) / (max - min) AS unit FROM v JOIN s ON s.pcell = v.pcell AND s.axis = v.axis",
)
def _(spark, sf):
    return coverage.normalise_axes(run_sql(spark, sf, AXIS_VALUES), run_sql(spark, sf, AXIS_SPECS))


U = [f"u{i}" for i in range(AXES)]
NN = f"""
, nn AS (SELECT a.pcell, a.vec_id, min(sqrt({" + ".join(f"(a.{u} - b.{u}) ** 2" for u in U)})) AS d FROM points a JOIN points b ON a.pcell = b.pcell AND a.vec_id <> b.vec_id GROUP BY 1, 2)
"""


@query("nearest_neighbour", with_views("points") + NN + "SELECT pcell, vec_id, round(d, 9) AS nn_distance FROM nn")
def _(spark, sf):
    got = coverage.nearest_neighbour(view(spark, sf, "points"), ["pcell"], "vec_id", U)
    return got.select("pcell", "vec_id", F.round("nn_distance", 9).alias("nn_distance"))


@query("min_pairwise_distance", with_views("points") + NN + "SELECT pcell, round(min(d), 9) AS min_distance FROM nn GROUP BY pcell")
def _(spark, sf):
    got = coverage.min_pairwise_distance(view(spark, sf, "points"), ["pcell"], "vec_id", U)
    return got.select("pcell", F.round("min_distance", 9).alias("min_distance"))


@query(
    "coverage_flag",
    with_views("points") + NN + "SELECT pcell, round(min(d), 9) AS min_distance, round(avg(d), 9) AS avg_nearest_neighbour, min(d) < CAST(0.5 AS DOUBLE) * avg(d) AS flagged FROM nn GROUP BY pcell",
)
def _(spark, sf):
    near = coverage.nearest_neighbour(view(spark, sf, "points"), ["pcell"], "vec_id", U)
    got = coverage.coverage_flag(near, ["pcell"])
    return got.select(
        "pcell", F.round("min_distance", 9).alias("min_distance"),
        F.round("avg_nearest_neighbour", 9).alias("avg_nearest_neighbour"), "flagged",
    )
