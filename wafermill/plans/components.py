"""Connected components: contraction inside of tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafermill.plans.attach import attach, null_safe_join
from wafermill.session import cut_lineage, written

#: Edges of a group that one task contracts at a time; a larger group is dealt to several.
PER_TASK = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label the nodes of edges that come sorted by part: the smallest node that a part connects
    them to. The edges of one part are held at a time."""
    part, root, schema = None, {}, None

    def find(x):
        while (up := root[x]) != x:
            root[x] = x = root[up]
        return x

    def labelled() -> pa.RecordBatch:
        nodes = list(root)
        keys = [pa.array([v] * len(nodes), schema.field(i).type) for i, v in enumerate(part[:-1])]
        kind = schema.field(len(part)).type
        return pa.RecordBatch.from_arrays([*keys, pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=[*schema.names[: len(part) - 1], "node", "label"])

    for batch in batches:
        schema = batch.schema
        *keys, us, vs = (c.to_pylist() for c in batch.columns)
        for key, u, v in zip(zip(*keys), us, vs):
            if key != part:
                if root:
                    yield labelled()
                part, root = key, {}
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        yield labelled()


def contracted(edges: DataFrame, by: list[str], per_task: int) -> tuple[DataFrame, bool]:
    """(``by``, ``node``, ``label``) for the nodes of ``edges``, and whether these labels are final.

    A group of up to ``per_task`` edges goes to one task, which finds its components. The edges of a
    larger group are dealt to several tasks by their smaller node; a node then has a label from
    each, and the edges between nodes and labels connect what the group connects.
    """
    sizes = edges.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("_parts")).where("_parts > 1")
    sizes = cut_lineage(sizes)
    split = sizes.head(1) != []
    dealt = edges.withColumn("_part", F.lit(0).cast("long"))
    if split:
        dealt = attach(edges, sizes, by, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("_parts")), F.lit(0).cast("long")))
    keys = [*by, "_part"]
    dealt = dealt.select(*keys, "u", "v").repartition(*keys).sortWithinPartitions(*keys)
    node = dealt.schema["u"].dataType
    schema = T.StructType([*[dealt.schema[c] for c in by], T.StructField("node", node), T.StructField("label", node)])
    return cut_lineage(dealt.mapInArrow(_contract, schema)), not split


def _mark(edges: DataFrame, by: list[str]) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, by: list[str], per_task: int = PER_TASK) -> DataFrame:
    """Label every node of ``edges(by..., u, v)`` with the smallest node it reaches.

    Returns (by..., node, label) for nodes that have an edge. Groups of moderate size are settled by
    one task each; larger ones are contracted first and go through rounds. Each round is two joins with
    one row per node on one side and partial aggregates, never a collected neighbour list.
    The small side is written out first, so that both sides of the join are plain exchanges
    and the adaptive skew join can split a hot node. Rounds go on until nothing changes, which
    takes about the logarithm of the size. Each round is checkpointed in the shared folder.
    """
    edges = edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut_lineage(edges)
    if by:
        labels, final = contracted(now, by, per_task)
        if final:
            return labels
        now = cut_lineage(labels.where("node <> label").select(*by, F.col("node").alias("u"), F.col("label").alias("v")).distinct())
    before = _mark(now, by)
    while True:
        both = now.select(*by, "u", "v").union(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy(*by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "component-low")
        large = (
            null_safe_join(both.where("v > u"), low, [*by, "u"])
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = cut_lineage(large)
        low2 = written(large.groupBy(*by, "u").agg(F.min("v").alias("m")), "component-low")
        small = (
            null_safe_join(large, low2, [*by, "u"])
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low2.select(*by, "u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut_lineage(small)
        after = _mark(now, by)
        if after == before:
            break
        before = after
    return now.select(*by, F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(*by, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
