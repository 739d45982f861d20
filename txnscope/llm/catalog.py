"""The registered queries of this subpackage: name -> (builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class LlmQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def load_all() -> dict[str, LlmQuery]:
    from txnscope.llm import queries
    return {q.name: q for q in queries.QUERIES}
