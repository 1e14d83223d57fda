"""Equi-joins of tables, positional paste, merges of several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..natural import nat_sort_key
from .select import number_partitions


def tsvjoin(
    left: DataFrame, right: DataFrame, how: str = "full", keys: list[str] | None = None, keys2: list[str] | None = None, pre1: str = "", pre2: str = "", default: str | None = None
) -> DataFrame:
    """Keys are the columns of the same name unless given. Other columns get the prefixes; missing cells the
    default (null if none). A key that is repeated on both sides gives all combinations."""
    keys = keys or [c for c in left.columns if c in right.columns]
    keys2 = keys2 or keys
    a = left.select(*[model.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *[model.col(c).alias(pre1 + c) for c in left.columns if c not in keys])
    rest = [c for c in right.columns if c not in keys2]
    taken = [pre1 + c for c in left.columns if c not in keys] + keys
    names = {c: pre2 + c if pre2 + c not in taken else f"{pre2}{c}_2" for c in rest}
    b = right.select(*[model.col(k).alias(f"_b{i}") for i, k in enumerate(keys2)], *[model.col(c).alias(names[c]) for c in rest])
    cond = [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(keys))]
    out = a.join(b, cond, how)
    ids = [F.coalesce(F.col(f"_a{i}"), F.col(f"_b{i}")).alias(k) for i, k in enumerate(keys)]
    cells = [model.col(c) for c in a.columns[len(keys) :] + b.columns[len(keys2) :]]
    if default is not None:
        cells = [F.coalesce(c.cast("string"), F.lit(default)).alias(n) for c, n in zip(cells, a.columns[len(keys) :] + b.columns[len(keys2) :])]
    return out.select(*ids, *cells)


def paste(tables: list[DataFrame], orders: list[list[str]]) -> DataFrame:
    """Row by row side by side, as many rows as the shortest has. Each table's order is given by columns."""
    numbered = [number_partitions(t.orderBy(*[model.col(c) for c in o]), "_at") for t, o in zip(tables, orders)]
    return reduce(lambda a, b: a.join(b, "_at"), numbered).orderBy("_at").drop("_at")


def merge_keys(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The different keys of all tables."""
    return reduce(DataFrame.unionByName, [t.select(*[model.col(k) for k in keys]) for t in tables]).distinct()


def multicount(tables: dict[str, DataFrame], ids: list[str], values: list[str], empty: int = 0) -> DataFrame:
    """Count tables side by side: value-sample, empty where a table lacks the id. Gene versions (.N) are cut.

    One union and one aggregation, however many tables."""
    parts = [
        t.select(*[F.regexp_replace(model.col(i).cast("string"), r"^(ENS[A-Z]*\d+)\.\d+$", "$1").alias(i) for i in ids], F.lit(s).alias("_s"), *[model.col(v) for v in values]) for s, t in tables.items()
    ]
    long = reduce(DataFrame.unionByName, parts)
    aggs = [F.coalesce(F.first(F.when(F.col("_s") == s, model.col(v)), ignorenulls=True), F.lit(empty)).alias(f"{v}-{s}") for s in tables for v in values]
    return long.groupBy(*[model.col(i) for i in ids]).agg(*aggs)


def lookup(df: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of a side table by key; unmatched rows stay with nulls. Spark broadcasts the table if its
    size allows."""
    return df.join(table.select(model.col(key), *[model.col(c) for c in columns]), key, "left")


def join_many(tables: dict[str, DataFrame], keys: list[str], missing: str = "?") -> DataFrame:
    """Full outer join of several tables into a wide one: field-name for each table's own fields."""
    fields = {s: [c for c in t.columns if c not in keys] for s, t in tables.items()}
    every = sorted({f for fs in fields.values() for f in fs}, key=nat_sort_key)
    parts = [
        t.select(*[model.col(k) for k in keys], F.lit(s).alias("_s"), *[(model.col(f).cast("string") if f in fields[s] else F.lit(None).cast("string")).alias(f) for f in every]) for s, t in tables.items()
    ]
    long = reduce(DataFrame.unionByName, parts)
    aggs = [F.coalesce(F.first(F.when(F.col("_s") == s, model.col(f)), ignorenulls=True), F.lit(missing)).alias(f"{f}-{s}") for s in tables for f in fields[s]]
    return long.groupBy(*[model.col(k) for k in keys]).agg(*aggs)
