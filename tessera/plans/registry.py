"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes, and inline rows by SQL."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def inline(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)


def query(sql: str | None = None):
    """Registers a function of Tables as the query of its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from tessera.plans import extraction, more, ranking, relational, stateful, tidy  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
