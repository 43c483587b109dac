"""Nets: shapes connected through layers, and spacing that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.operators.boolean import BOX
from wafermill.operators.spatial import _spaced, distinct_rects
from wafermill.plans.attach import null_safe_join
from wafermill.plans.components import connected_components
from wafermill.plans.gridjoin import near_pairs


def extract_nets(shapes: DataFrame, connections: list[tuple[str, str]]) -> DataFrame:
    """Add ``net``: touching shapes of one layer, or of a declared layer pair, share it.

    The net is named by its smallest shape id.
    """
    rects = distinct_rects(shapes, ["component", "layer"])
    # Each shape is repeated for the links its layer has, so that only linked layers meet.
    ends = [{}, {}]
    for n, pair in enumerate(dict.fromkeys(tuple(sorted(c)) for c in connections if c[0] != c[1])):
        for side, layer in enumerate(pair):
            ends[side].setdefault(layer, []).append(n)

    def linked(side: int) -> DataFrame:
        links = F.array(F.lit(-1))
        for layer, numbers in ends[side].items():
            links = F.when(F.col("layer") == layer, F.array(*[F.lit(n) for n in [-1, *numbers]])).otherwise(links)
        rows = rects.withColumn("_link", F.explode(links))
        # Link -1 is the layer itself.
        return rows.withColumn("_own", F.when(F.col("_link") == -1, F.col("layer")))

    pairs = near_pairs(linked(0), linked(1), ["component", "_link", "_own"]).where("_link >= 0 OR a_id < b_id")
    edges = pairs.select("component", F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    labels = connected_components(edges, ["component"])
    named = null_safe_join(rects, labels.select("component", F.col("node").alias("id"), "label"), ["component", "id"], "left")
    named = named.select("component", "layer", *BOX, F.coalesce("label", "id").alias("net"))
    return null_safe_join(shapes, named, ["component", "layer", *BOX])


def net_aware_spacing(netted: DataFrame, layer1: str, layer2: str, conn: int, not_conn: int) -> DataFrame:
    """Pairs closer than ``conn``, and pairs on different nets closer than ``not_conn``."""
    if conn > not_conn:
        raise ValueError("the distance for connected shapes must not be the larger one")
    keys = ["component", "net", *BOX]

    def on(layer: str) -> DataFrame:
        return netted.where(F.col("layer") == layer).groupBy(*keys).agg(F.min("shape_id").alias("id"))

    pairs = near_pairs(on(layer1), on(layer2), ["component"], not_conn, carry=["net"])
    if layer1 == layer2:
        pairs = pairs.where("a_id < b_id")
    close = _spaced(pairs, not_conn)
    kinds = F.array_compact(F.array(
        F.when(F.col("gap2") < conn * conn, "connected"),
        F.when(F.col("a_net") != F.col("b_net"), "not connected"),
    ))
    return close.select("component", "a_id", "b_id", "gap2", F.explode(kinds).alias("rule"))
