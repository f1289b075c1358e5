"""All queries of the engine by name, with their reference SQL. A query's name starts with the ids of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a18_j18_a13_pair_hist"


class Tables:
    """The tables of a folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as a query, with the SQL that says the same."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from docloom.plans import analytics, agreement, curation, dockets, entities, files, people, records  # noqa: E402, F401
