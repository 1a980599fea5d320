"""How the modules of this package register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landfold.sources.views import TABLES, duck, table, view


class Source:
    """Tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name) if name in TABLES else view(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}
        self.plain: dict[str, Callable] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Registers a function of a Source; sql is its twin over tables and views."""

        def register(f: Callable[[Source], DataFrame]) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.plain[name] = f
            self.queries[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = duck(sql)
            return f

        return register
