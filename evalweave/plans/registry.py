"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_loaded: list[bool] = []


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    if not _loaded:
        from evalweave.plans import catalogue  # noqa: F401

        _loaded.append(True)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
