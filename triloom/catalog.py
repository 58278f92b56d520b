"""Registered queries of the graph engine over the driver's tables, with DuckDB equivalents.

Every query runs over whole tables.  Names say what the query shows; a query
without SQL is not deterministic, has no SQL form, or has one that is too slow on
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .session import ship
from .sources.driver_tables import ID, NS, table_graph

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the tables of a folder."""
    return Engine(ship(spark), table_graph(spark, sf_dir), prefixes={"": NS, "id": ID})


def ask(name: str, text: str, sql: str | None = None) -> None:
    """Registers a SPARQL query and its SQL."""
    _QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(text)
    if sql:
        _SQL[name] = sql


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Registers a query made in Python and its SQL."""
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


FLAGSHIP = 'SELECT ?nation (COUNT(?c) AS ?n) WHERE { ?c :c_nation ?k . ?k :n_name ?nation ; :n_region ?r . ?r :r_name "EUROPE" } GROUP BY ?nation'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation of Europe."""
    return engine(spark, sf_dir).query(FLAGSHIP)


def queries() -> dict[str, Query]:
    """Queries by name."""
    from . import catalog_graph, catalog_more, catalog_tables  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    queries()
    return dict(_SQL)
