"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .facts import Facts, facts_oracle
from .projection import Graph, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, graph: bool = True):
    """Register a function of the projected graph; ``sql`` is its oracle, behind the projection's views if ``graph``."""

    def add(f: Callable[[Graph], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = oracle(sql) if graph else sql
        return f

    return add


def facts_query(name: str, sql: str | None):
    """Register a function of the fact tables; ``sql`` stands behind their views."""

    def add(f: Callable[[Facts], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = facts_oracle(sql)
        return f

    return add


def _load() -> None:
    from . import queries_facts, queries_graph, queries_knowledge, queries_recall, queries_rules, queries_source, queries_store, queries_views  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
