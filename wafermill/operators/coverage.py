"""How evenly a set of designs covers its space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.blockpairs import nearest_others
from wafermill.plans.metricindex import MetricIndex
from wafermill.session import cut_lineage

#: Larger families of points over at most FEW_AXES axes are looked up in a metric index.
INDEXED, FEW_AXES = 500_000, 16


def normalise_axes(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """(value - min) / (max - min) per (pcell, axis); every place of an axis has its own value."""
    both = attach(samples, specs.select("pcell", "axis", "min", "max"), ["pcell", "axis"])
    return both.withColumn("unit", (F.col("value") - F.col("min")) / (F.col("max") - F.col("min"))).drop("min", "max")


def nearest_neighbour(points: DataFrame, family: list[str], key: str, axes: list[str]) -> DataFrame:
    """Exact distance of each point to the closest other point of its family, over all ``axes``.

    Equal points are merged; copies of a point have distance 0. The others are compared by blocks
    (:mod:`wafermill.plans.blockpairs`), since points spread evenly over many axes are all about equally
    far from each other and every exact method compares most pairs. Over few axes families of more
    than INDEXED points go to a metric index (:mod:`wafermill.plans.metricindex`), which compares only
    rings that may hold a nearer point. A family of one point has no neighbour and gives null, and
    so does a point with a coordinate that is null or not finite, which is nobody's neighbour. Null
    families are one family.
    """
    place = F.array(*[F.col(a).cast("double") + F.lit(0.0) for a in axes])
    named = points.select(*family, key, place.alias("v"))
    known = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    merged = named.where(known).groupBy(*family, "v").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies"))
    merged = cut_lineage(merged)
    indexed = None
    if len(axes) <= FEW_AXES:
        indexed = cut_lineage(merged.groupBy(*family).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > INDEXED).drop("_n"))
    if indexed is None or indexed.isEmpty():
        nearest = nearest_others(merged, family, len(axes))
    else:
        nearest = MetricIndex(null_safe_join(merged, indexed, family, "left_semi"), family, len(axes)).nearest()
        rest = cut_lineage(null_safe_join(merged, indexed, family, "left_anti"))
        nearest = nearest.unionByName(nearest_others(rest, family, len(axes)))
    # Both have a row for each point; the planner's guess of their size may be far too small to go by.
    found = null_safe_join(merged, nearest.hint("merge"), [*family, "id"], "left")
    found = found.select(*family, "v", F.when(F.col("copies") > 1, 0.0).otherwise(F.col("nearest")).alias("nn_distance"))
    return null_safe_join(named, found.hint("merge"), [*family, "v"], "left").select(*family, key, "nn_distance")


def min_pairwise_distance(points: DataFrame, family: list[str], key: str, axes: list[str]) -> DataFrame:
    """Smallest distance between two points of a family, 0.0 for fewer than two points."""
    nearest = nearest_neighbour(points, family, key, axes)
    return nearest.groupBy(*family).agg(F.coalesce(F.min("nn_distance"), F.lit(0.0)).alias("min_distance"))


def coverage_flag(nearest: DataFrame, family: list[str], ratio: float = 0.5) -> DataFrame:
    """Smallest and mean neighbour distance; flagged when the smallest is far below the mean."""
    summed = nearest.groupBy(*family).agg(
        F.min("nn_distance").alias("min_distance"), F.avg("nn_distance").alias("avg_nearest_neighbour")
    )
    return summed.withColumn("flagged", F.col("min_distance") < ratio * F.col("avg_nearest_neighbour"))
