"""All registered queries of the court-case jobs, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL twin if it has one."""

    def dates_as_text(f: Query) -> Query:
        """Days are given as yyyy-MM-dd, which all readers compare alike."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            days = {c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"}
            return df.withColumns(days) if days else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    def put(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"registered twice: {f.__name__}")
        _QUERIES[f.__name__] = dates_as_text(f)
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from . import alert_queries, entity_queries, matching_queries, monitoring_queries, scalar_queries, streaming_queries, subscription_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
