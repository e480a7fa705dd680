"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[Data], DataFrame], fixtures: str = "", sql: str | None = None) -> None:
    """Registers a query; ``sql`` is what the checking engine runs, over the fixtures named."""
    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name] = lambda spark, sf_dir: query(Data(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = oracle(fixtures, sql) if fixtures else sql


from . import graph_queries, logic_queries, page_queries, score_queries  # noqa: E402, F401  (they register themselves)
