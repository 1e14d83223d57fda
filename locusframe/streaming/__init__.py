"""Selections and running summaries of unbounded tables.

Rows of a stream have no order and no event time here: projection and filters are stateless, summaries run
in complete or update mode. What needs an order (ROW, sort, paste, runs) is for bounded tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators.group import aggregated, parse_aggregates
from ..operators.select import select


def select_stream(stream: DataFrame, fields: str | None = None, query: str | None = None) -> DataFrame:
    return select(stream, fields, query)


def group_stream(stream: DataFrame, by: list[str], aggregates: str = "count") -> DataFrame:
    """A running summary; aggregates that need all rows at once (median, quartiles, distinct, list, ucount,
    percents) aren't among them."""
    wanted = parse_aggregates(aggregates)
    if bad := [a.how for a in wanted if a.how not in ("count", "sum", "min", "max", "avg", "stdev", "stddev")]:
        raise ValueError(f"not on a stream: {', '.join(bad)}")
    return aggregated(stream, by, by, [], wanted)


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes to Parquet files; checkpoint has to be a folder all executors reach."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start()


__all__ = ["F", "group_stream", "model", "select_stream", "write"]
