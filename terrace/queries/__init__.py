"""The queries of the driver contract by area; each module has QUERIES and the DuckDB SQL in ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Book:
    """Collects a module's queries."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return put

    def sql(self, name: str, oracle: str, spark_sql: str, *tables: str) -> None:
        """A query in Spark SQL over the named tables."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

        run.__name__ = name
        self.queries[name] = run
        self.oracles[name] = oracle
