"""Queries by name, with SQL that gives the same rows where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table loader. Integers go out as long, other numbers as double."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    kinds = {"tinyint": "long", "smallint": "long", "int": "long", "float": "double"}
    new = {c: F.col(f"`{c}`").cast(kinds[t]) for c, t in df.dtypes if t in kinds}
    return df.withColumns(new) if new else df
