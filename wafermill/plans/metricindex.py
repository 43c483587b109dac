"""Nearest neighbours over many axes by pivots and distance rings.

Some points of every group are pivots. Each point belongs to the cell of its nearest pivot, and a
cell is cut into rings: runs of RING points in the order of their distance to the pivot. A point
that looks for neighbours within a reach visits only rings that may hold one:

- a point of another pivot's cell is at least half as far away as that pivot is further than the
  own one;
- a point of a ring is at least as far away as the ring's distances to its pivot differ from the
  own distance to it (triangle inequality). The same holds for a few reference pivots, to
  which all points know their distance.

Visits are joined to the points by (group, pivot, ring), so every task compares whole rings,
whatever the size of a group or a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.plans.attach import attach, null_safe_join, sized_small
from wafermill.plans.ranks import range_rank
from wafermill.session import cut_lineage

RING = 32
#: Pivots of a group are about the root of its size, and no more than this: they are sent around.
MOST_PIVOTS = 1024
REFERENCES = 4
MOST_TERMS = 24
#: Distances are rounded; bounds on them are widened by this share, or the nearest could be cut off.
SLACK = 1e-12


def distance(a: str, b: str, dims: int) -> Column:
    """Euclidean distance of two points given as arrays. Up to MOST_TERMS terms are written out, so
    that they are compiled; more would not fit into one compiled method."""
    if dims > MOST_TERMS:
        squares = f"zip_with({a}, {b}, (x, y) -> (x - y) * (x - y))"
        return F.expr(f"sqrt(aggregate({squares}, CAST(0 AS DOUBLE), (total, x) -> total + x))")
    return F.expr("sqrt(" + " + ".join(f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in range(dims)) + ")")


class MetricIndex:
    """Rings of distinct ``points(by..., id, v)`` and the search in them.

    ``v`` is an array of ``dims`` finite numbers. ``by`` may hold nulls; ids are unique in a group.
    """

    def __init__(self, points: DataFrame, by: list[str], dims: int, ring: int = RING):
        self.by, self.dims = by, dims
        points = cut_lineage(points.select(*by, "id", "v"))
        sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"))
        classes = F.ceil(F.col("_n") / F.least(F.sqrt("_n"), F.lit(float(MOST_PIVOTS)))).cast("long")
        picked = (F.pmod(F.xxhash64("id", F.lit("pivot")), classes) == 0) | (F.col("id") == F.col("_first"))
        picked = attach(points, sizes, by).where(picked).select(*by, F.col("id").alias("pivot"), F.col("v").alias("p"))
        self.pivots, few = sized_small(picked)
        self.sent = F.broadcast(self.pivots) if few else self.pivots
        # The pivots with the smallest digests are references: a choice among MOST_PIVOTS or so.
        ranked = F.sort_array(F.collect_list(F.struct(F.xxhash64("pivot").alias("h"), "pivot", "p")))
        chosen = self.pivots.groupBy(*by).agg(F.slice(ranked, 1, REFERENCES).alias("_refs"))
        measured = self._measured(points)
        nearest = measured.groupBy(*by, "id").agg(
            F.min("_d").alias("r"), F.min_by("pivot", "_d").alias("pivot"), F.min(F.when(F.col("pivot") != F.col("id"), F.col("_d"))).alias("_other")
        )
        placed = attach(null_safe_join(points, nearest, [*by, "id"]), chosen, by, "left")
        self.marks = [f"_m{k}" for k in range(REFERENCES)]
        for k, mark in enumerate(self.marks):
            placed = placed.withColumn("_ref", F.get("_refs", F.lit(k))["p"])
            placed = placed.withColumn(mark, F.coalesce(distance("v", "_ref", dims), F.lit(0.0))).drop("_ref")
        placed = range_rank(placed.drop("_refs"), [*by, "pivot"], [F.col("r").asc(), F.col("id").asc()], "_rank")
        self.points = cut_lineage(placed.withColumn("ring", F.floor((F.col("_rank") - 1) / ring)).drop("_rank"))
        bounds = [x for c in ("r", *self.marks) for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
        self.rings = self.points.groupBy(*by, "pivot", "ring").agg(*bounds)

    def _measured(self, points: DataFrame) -> DataFrame:
        """Every point with every pivot of its group."""
        return null_safe_join(points, self.sent, self.by).withColumn("_d", distance("v", "p", self.dims))

    def _compared(self, visits: DataFrame) -> DataFrame:
        """Pairs of a visiting point and the points of the ring it visits (``by``, ``id``, ``d``)."""
        there = self.points.select(
            *self.by, "pivot", "ring", F.col("id").alias("_id"), F.col("r").alias("_r"), F.col("v").alias("q")
        )
        met = null_safe_join(visits, there, [*self.by, "pivot", "ring"])
        met = met.where((F.col("id") != F.col("_id")) & (F.abs(F.col("_d") - F.col("_r")) <= F.col("_reach") + SLACK * F.col("_d")))
        return met.withColumn("d", distance("v", "q", self.dims)).select(*self.by, "id", "d")

    def own_ring_pairs(self) -> DataFrame:
        """All pairs inside a ring, from both ends."""
        inside = self.points.select(*self.by, "pivot", "ring", "id", "v")
        return self._compared(inside.withColumn("_d", F.lit(0.0)).withColumn("_reach", F.lit(float("inf"))))

    def bounded(self) -> DataFrame:
        """All points with ``bound``: the distance to some other point, null if there is none."""
        own = self.own_ring_pairs().groupBy(*self.by, "id").agg(F.min("d").alias("_own"))
        return null_safe_join(self.points, own, [*self.by, "id"], "left").withColumn("bound", F.least("_own", "_other")).drop("_own")

    def visiting_pairs(self, seekers: DataFrame) -> DataFrame:
        """Pairs outside of the own ring that ``seekers`` (points with ``bound``) must look at."""
        seekers = seekers.where("bound IS NOT NULL").withColumn("_reach", F.col("bound") * (1 + SLACK))
        seekers = seekers.withColumnRenamed("pivot", "_own_pivot").withColumnRenamed("ring", "_own_ring")
        places = self._measured(seekers).where(F.col("_d") - F.col("r") <= 2 * F.col("_reach") + SLACK * F.col("_d"))
        met = attach(places, self.rings, [*self.by, "pivot"])
        near = (F.col("_own_pivot") != F.col("pivot")) | (F.col("_own_ring") != F.col("ring"))
        for c, own in (("r", "_d"), *((m, m) for m in self.marks)):
            reach = F.col("_reach") + SLACK * F.col(own)
            near = near & (F.col(own) - reach <= F.col(f"hi_{c}")) & (F.col(own) + reach >= F.col(f"lo_{c}"))
        return self._compared(met.where(near).select(*self.by, "pivot", "ring", "id", "v", "_d", "_reach"))

    def nearest(self) -> DataFrame:
        """(``by``, ``id``, ``nearest``): distance to the nearest other point, null if there is none."""
        bounded = cut_lineage(self.bounded())
        found = self.visiting_pairs(bounded).groupBy(*self.by, "id").agg(F.min("d").alias("_near"))
        joined = null_safe_join(bounded, found, [*self.by, "id"], "left")
        return joined.select(*self.by, "id", F.least("bound", "_near").alias("nearest"))
