"""Every query the engine offers over the sample tables, with its SQL check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "timeline",
    "text",
    "stats",
    "tracks",
    "cutting",
    "matching",
    "publishing",
    "folding",
    "exchange",
    "monitoring",
)


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"cueline.catalog.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
