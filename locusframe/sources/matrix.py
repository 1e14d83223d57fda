"""Sparse matrices (MatrixMarket, 10x folders) as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import number_partitions


def mm2tsv(spark: SparkSession, folder: str, matrix: str = "matrix.mtx", genes: str = "features.tsv", cells: str = "barcodes.tsv") -> DataFrame:
    """gene, cell, count of a folder with the triplets and the names of rows and columns."""
    names = lambda f, c, n: number_partitions(spark.read.text(f"{folder}/{f}").select(F.get(F.split("value", "\t"), F.lit(0)).alias(c)), n).withColumn(n, F.col(n) + 1)
    p = F.split("value", r"\s+")
    body = spark.read.text(f"{folder}/{matrix}").where(~F.col("value").startswith("%"))
    x = body.select(F.get(p, F.lit(0)).try_cast("long").alias("r"), F.get(p, F.lit(1)).try_cast("long").alias("c"), F.get(p, F.lit(2)).try_cast("double").alias("count"))
    rows, cols = names(genes, "gene", "r"), names(cells, "cell", "c")
    # the line of sizes says how many rows, columns and other lines there are; an entry may happen to say the same
    sizes = F.struct("r", "c", "count") == F.struct(F.lit(rows.count()).alias("r"), F.lit(cols.count()).alias("c"), F.lit(float(x.count() - 1)).alias("count"))
    both = x.where(sizes).limit(2)
    entries = x.where(~sizes).union(both.limit(both.count() - 1))
    return entries.join(rows, "r").join(cols, "c").select("gene", "cell", "count")


def write_10x(df: DataFrame, folder: str, gene: str = "gene", cell: str = "cell", value: str = "count") -> None:
    """A folder with matrix.mtx, features.tsv and barcodes.tsv; names are in one part each, as their order counts."""
    x, rows, cols = tsv2mm(df, gene, cell, value)
    one = lambda t, c, n, name: t.repartition(1).sortWithinPartitions(n).select(F.col(c).cast("string").alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    one(rows, gene, "r", "features.tsv")
    one(cols, cell, "c", "barcodes.tsv")
    spark = df.sparkSession
    top = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{rows.count()} {cols.count()} {x.count()}",)], "value string")
    top.coalesce(1).write.mode("overwrite").text(f"{folder}/matrix.mtx")
    x.select(F.concat_ws(" ", F.col("r").cast("string"), F.col("c").cast("string"), F.col("count").cast("string")).alias("value")).write.mode("append").text(f"{folder}/matrix.mtx")


def tsv2mm(df: DataFrame, gene: str = "gene", cell: str = "cell", value: str = "count") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triplets (r, c, value) with numbers from 1, and the names of rows and columns with their numbers."""
    number = lambda c, n: number_partitions(df.select(F.col(c)).distinct().orderBy(c), n).withColumn(n, F.col(n) + 1)
    rows, cols = number(gene, "r"), number(cell, "c")
    x = df.join(rows, gene).join(cols, cell).select("r", "c", F.col(value).alias("count"))
    return x, rows, cols
