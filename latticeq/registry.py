"""Queries by name, each with the DuckDB SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its oracle if it has one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the named tables, for queries written in SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def over_tables(name: str, oracle: str | None, make: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    """A query that `make` builds from a function that reads tables by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(lambda wanted: table(spark, sf_dir, wanted))

    run.__name__ = name
    query(name, oracle)(run)


def sql_query(name: str, tables: tuple[str, ...], sql: str, oracle: str | None = None) -> None:
    """A query written in Spark SQL; without an oracle of its own, the same text runs in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(sql)

    run.__name__ = name
    run.__doc__ = f"Spark SQL over {', '.join(tables)}."
    query(name, sql if oracle is None else oracle)(run)
