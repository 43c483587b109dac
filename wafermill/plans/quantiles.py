"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafermill.plans.attach import attach
from wafermill.plans.ranks import running_sums


def exact_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` within ``by``, nulls left out.

    The built-in exact ``percentile`` keeps all values of a group in one task. Here equal
    values are counted before the shuffle, the distinct values are range-sorted, and the
    two neighbours of each wanted position are picked by a plain aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, by, [F.col(value).asc()], {"_upto": F.col("_n")})
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = attach(placed, totals, by)
    picks = []
    for name, p in points.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}_{name}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_w_{name}"))
    got = ranked.groupBy(*by).agg(*picks)
    return got.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in points
        ],
    )
