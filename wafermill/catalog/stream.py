"""Queries over running progress."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import view, with_views
from wafermill.session import scratch_path
from wafermill.streaming import progress

SUMS = """
, c AS (SELECT pcell, {keys} count(*) {over} AS completed, count(*) FILTER (success) {over} AS ok, CAST(sum(CAST(COALESCE(execution_time, 0) AS DECIMAL(20,6))) {over} AS DOUBLE) AS elapsed FROM results {group})
SELECT pcell, {keys} completed, ok * CAST(100 AS DOUBLE) / completed AS success_rate, elapsed, round(elapsed / completed, 6) AS avg_time, round(elapsed / completed * (1000000 - completed), 6) AS eta FROM c"""


@query("progress_stream", with_views("results") + SUMS.format(keys="", over="", group="GROUP BY pcell"))
def _(spark, sf):
    path = scratch_path(spark, "results")
    rows = view(spark, sf, "results").select("sample_id", "pcell", "success", "execution_time")
    rows.write.json(path)
    return progress.progress_stream(spark, path, ["pcell"], 1000000)


@query(
    "progress_rows",
    with_views("results") + SUMS.format(keys="sample_id,", over="OVER (PARTITION BY pcell ORDER BY sample_id)", group=""),
)
def _(spark, sf):
    return progress.progress_rows(view(spark, sf, "results"), ["pcell"], "sample_id", 1000000)


@query(
    "follow_progress",
    with_views("results") + SUMS.format(keys="sample_id,", over="OVER (PARTITION BY pcell ORDER BY sample_id)", group=""),
)
def _(spark, sf):
    """Results arrive in four lots; the stream is started again for each."""
    path, out = scratch_path(spark, "results"), scratch_path(spark, "follow")
    rows = view(spark, sf, "results").select("sample_id", "pcell", "success", "execution_time")
    ends = rows.selectExpr("max(sample_id) AS top").first()["top"] or 0
    for lot in range(4):
        own = F.greatest(F.lit(1), F.ceil(F.col("sample_id") * 4 / (ends or 1))) == lot + 1
        rows.where(own).write.mode("append").json(path)
        seen = progress.follow_progress(spark, path, ["pcell"], "sample_id", 1000000, out)
    return seen.drop("batch")
