"""The reference queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under a name, with its SQL if there is any."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark, sf_dir: str, name: str):
    """A table of the driver; columns are pruned and filters pushed down by the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import concordance_queries, data_queries, design_queries, inference_queries, log_queries, skill_queries, text_queries, vector_queries  # noqa: E402, F401
