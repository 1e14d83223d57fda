"""Concatenation, difference and splitting of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model


def cat(tables: list[DataFrame], merge: bool = False, force: bool = False, names: list[str] | None = None, name_column: str = "file", fields: list[str] | None = None) -> DataFrame:
    """All rows of all tables. Headers have to be equal unless merge (by name, empty where missing) or force
    (by position)."""
    if names:
        tables = [t.withColumn(name_column, F.lit(n)) for t, n in zip(tables, names)]
    if fields:
        tables = [t.select(*[model.col(f) for f in fields if f in t.columns]) for t in tables]
    if not merge and not force and any(t.columns != tables[0].columns for t in tables):
        raise ValueError("headers differ")
    if force:
        return reduce(DataFrame.union, [t.toDF(*tables[0].columns) for t in tables])
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    texts = [c for c, t in out.dtypes if t == "string"]
    return out.fillna("", texts) if merge else out


def multiselect(tables: dict[str, DataFrame], run, combine: str = "cat") -> DataFrame | dict[str, DataFrame]:
    """run on each table; the results as one table (cat), wide by name (multicompar) or as they are (files)."""
    done = {n: run(t) for n, t in tables.items()}
    if combine == "files":
        return done
    if combine == "cat":
        return cat(list(done.values()), merge=True)
    from .joins import join_many

    keys = [c for c in ("chromosome", "begin", "end", "type", "ref", "alt") if all(c in t.columns for t in done.values())]
    return join_many(done, keys)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two tables of the same columns, marked - (of a) and + (of b); repeats count."""
    return a.exceptAll(b).withColumn("diff", F.lit("-")).union(b.select(a.columns).exceptAll(a).withColumn("diff", F.lit("+")))


def cell_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, left, right of cells that differ; a row of one table only differs in all of its cells."""
    fields = [c for c in a.columns if c in b.columns and c not in keys]
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in keys], "full")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.`{f}`").cast("string").alias("left"), F.col(f"b.`{f}`").cast("string").alias("right")) for f in fields])
    return both.select(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys], F.inline(cells)).where(~F.col("left").eqNullSafe(F.col("right")))


def split_by(df: DataFrame, field: str, path: str, how: str = "parquet") -> None:
    """A folder of files for each value of a field."""
    df.write.partitionBy(field).format(how).mode("overwrite").save(path)


def merge_sorted(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of tables of the same columns in the natural order of these columns."""
    from .select import sort

    out = reduce(DataFrame.unionByName, tables)
    return sort(out, order)


def distribute(df: DataFrame, parts: int | None = None, column: str = "_region", size: int = 50_000_000) -> DataFrame:
    """df with the stretch of the genome each row begins in (chromosome:begin-end, of size positions), partitioned by
    it: what goes on works region by region."""
    from ..natural import chr_clip

    roles = model.resolve_roles(df.columns, ("chromosome", "begin"))
    c, b = chr_clip(model.col(roles["chromosome"])), F.floor(model.col(roles["begin"]).cast("long") / size)
    out = df.withColumn(column, F.concat(c, F.lit(":"), (b * size).cast("string"), F.lit("-"), ((b + 1) * size).cast("string")))
    return out.repartition(parts, column) if parts else out.repartition(column)


def split_by_chromosome(df: DataFrame, path: str) -> None:
    """A folder of files for each chromosome."""
    from ..natural import chr_clip

    roles = model.resolve_roles(df.columns, ("chromosome",))
    df.withColumn("_chr", chr_clip(model.col(roles["chromosome"]))).write.partitionBy("_chr").mode("overwrite").parquet(path)
