"""Named queries over the test tables, each with the DuckDB text it is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = [
    "records", "scores", "reports", "sources", "rules", "netlists", "ports",
    "design", "coverage", "training", "codemetrics", "shapes", "spatial", "stream",
]


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its comparison SQL."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"wafermill.catalog.{family}")
