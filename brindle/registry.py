"""Named queries, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return add

    def sql(self, name: str, tables: str, text: str, oracle: str | None = None) -> None:
        """A query whose Spark SQL text is also DuckDB's, unless oracle gives another."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from brindle.catalog import views

            views(spark, sf_dir, *tables.split())
            return spark.sql(text)

        self.query(name, text if oracle is None else oracle)(run)
