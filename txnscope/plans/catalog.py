"""Query catalogue: name -> (Spark builder(spark, sf_dir), SQL twin or None).

Every query reads the given tables (or views Spark derives from them) in
full. Queries whose results are doubles pass through ``snap_doubles`` and
the twin through ``snap_sql`` so that both engines land on the same grid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CATALOG: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        CATALOG[name] = Query(name, fn, sql, note)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from txnscope.plans import q_features, q_metrics, q_explore, q_ops, q_sources, q_detect, q_model, q_stream  # noqa: F401
    return CATALOG
