"""Helpers shared by the operators: scratch tables, row keys, connected components."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Words are runs of anything but these characters.
ASCII_SPACE = "\x20\x09-\x0d"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it was put on the driver's path only, and bound what a batch
    of texts takes in a worker, unless the session says otherwise."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "4000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever the others are called (of equal names the first)."""
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def guarded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the columns of docs: others than those of documents can have any names."""

    @wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names, safe = docs.columns, []
        for i, n in enumerate(names):
            safe.append(n if n in ("doc_id", "text", "source", "n_chars") and n not in safe else f"_c{i}")
        return f(docs.toDF(*safe), *args, **kwargs).toDF(*names)

    return run


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/locusframe/{uuid.uuid4().hex}"


#: Scratch tables that are there, with their sessions.
_scratch: dict[str, SparkSession] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. The
    table is deleted by discard, at the latest when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark)
    if not _scratch:
        atexit.register(_clear)
    _scratch[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(path: str) -> None:
    spark = _scratch.pop(path, None)
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for path in list(_scratch):
        try:
            _delete(path)
        except Exception:  # the session is gone, and with it the way to its files
            return


def discard(*dfs: DataFrame) -> None:
    """Delete scratch tables that no returned DataFrame reads."""
    for df in dfs:
        if path := getattr(df, "_scratch", None):
            _delete(path)


def with_key(df: DataFrame, key: str = "_k") -> DataFrame:
    """A row number that is unique whatever the ids are. It follows the partitions of the input, so the
    input has to be a table or a plan without a shuffle of unordered rows."""
    return df.withColumn(key, F.monotonically_increasing_id())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node
    that can be reached. Nodes without an edge are not listed.

    Each round maps every node to its smallest neighbour (or itself) and keeps the edges between the images.
    The smallest node of a component always maps to itself, the edges that remain still connect what they
    connected, and their number falls fast. The maps are then composed from the last to the first. A hot
    node costs no more than others: its edges are pre-aggregated before the shuffle and joined with AQE's
    skew handling.
    """
    maps, scratch = [], []
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.append(e)
    while e.limit(1).count():
        both = e.union(e.select("b", "a"))
        m = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")))
        maps.append(m)
        nxt = (
            e.join(m.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(m.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        nxt = materialise(nxt)
        discard(e)
        e = nxt
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    final = maps[-1].select("node", F.col("to").alias("component"))
    for m in reversed(maps[:-1]):
        nxt = final.select(F.col("node").alias("to"), "component")
        final = m.join(nxt, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    if len(maps) == 1:
        return final
    out = materialise(final)
    discard(*maps, e)
    return out


#: Keys that may be broadcast: at 8 bytes each, with the hash table, some tens of MB.
BROADCAST_KEYS = 500_000


def drop_keys(df: DataFrame, keys: DataFrame, key: str = "_k") -> DataFrame:
    """df without the rows whose key is in keys (a written table). Up to BROADCAST_KEYS keys are broadcast
    after they were counted; more are joined by a shuffle, with the same result."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_anti")


def join_classes(rows: DataFrame, classes: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """rows with the columns of classes (a written table, a row for each key, with the number of rows that have
    it); rows without a class stay, with nulls. Keys that more than a thousandth of all rows have, a thousand at
    most, are broadcast, so that the shuffle of the others meets no hot one."""
    total = classes.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * 1000 > F.lit(total)
    few, rest = classes.where(hot).drop(weight), classes.where(~hot).drop(weight)
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, "left")
    return rows.join(F.broadcast(few), key).unionByName(cold)
