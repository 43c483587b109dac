"""Join a small table of statistics or rules to a big one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20


def sized_small(small: DataFrame) -> tuple[DataFrame, bool]:
    """Write ``small`` out once and say whether it is safe to broadcast.

    Both the number of rows and their text size are checked, on at most one row more than
    the limit.
    """
    kept = cut_lineage(small)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    seen = kept.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return kept, seen["n"] <= BROADCAST_ROWS and seen["b"] <= BROADCAST_BYTES


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, where null equals null. The keys are those of ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def attach(df: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join ``small`` to ``df``; broadcast only after its rows have been counted.

    With few rows the big side stays where it is, so a hot key costs nothing. A table over
    the limit is joined by a shuffle, where the adaptive skew join splits hot keys; the planner,
    which knows neither count, may not send it to the driver after all. Null keys in ``on`` (a list
    of names) match each other.
    """
    kept, few = sized_small(small)
    other = F.broadcast(kept) if few else kept.hint("merge")
    return null_safe_join(df, other, on, how) if isinstance(on, list) else df.join(other, on, how)
