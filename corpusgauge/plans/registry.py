"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each plan module registers its queries with :func:`query`.  A builder takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the whole input tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None, ops: str = ""):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_str(s: str) -> str:
    """A SQL string literal (single quotes doubled; no backslash processing)."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    """A DuckDB list literal of strings."""
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def all_queries() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from corpusgauge.plans import (corpus, eda, labels_plans, stats_plans,  # noqa: F401
                                   classify_plans, service_plans, retrieval_plans, ml_plans,
                                   stream_plans, derived, source_plans)
    return dict(_REGISTRY)
