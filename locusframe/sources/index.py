"""Layouts for reading a part of a table: columns, distinct values, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip, nat_key
from ..operators.intervals import BIN, KEYS


def write_index(df: DataFrame, path: str, bin_size: int = BIN) -> None:
    """Parquet by chromosome and bin, where the table has places: a read of few columns or of a stretch opens no
    more than it needs. Rows are sorted by place in each file, so that row groups have narrow bounds."""
    roles = model.resolve_roles(df.columns)
    if not all(r in roles for r in KEYS):
        df.write.mode("overwrite").parquet(path)
        return
    begin = model.col(roles["begin"]).cast("long")
    x = df.withColumn("_chr", chr_clip(model.col(roles["chromosome"]))).withColumn("_group", F.floor(begin / (bin_size * 64)))
    x.repartitionByRange("_chr", "_group").sortWithinPartitions("_chr", "_group", begin).write.mode("overwrite").partitionBy("_chr", "_group").parquet(path)


def read_range(spark: SparkSession, path: str, chromosome: str, begin: int, end: int) -> DataFrame:
    """Rows of write_index's table that overlap [begin, end) of a chromosome. Others of the chromosome are passed
    over by the statistics of the files."""
    x = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    roles = model.resolve_roles(x.columns)
    b, e = (model.col(roles[k]).cast("long") for k in ("begin", "end"))
    return x.where((F.col("_chr").cast("string") == chr_clip(F.lit(chromosome))) & (b < end) & ((e > begin) | ((b == e) & (b == begin)))).drop("_chr", "_group")


def column_info(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, value, count: the different values of each column."""
    fields = fields or df.columns
    each = F.array(*[F.struct(F.lit(f).alias("field"), model.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.inline(each)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def index_column(df: DataFrame, fields: list[str]) -> DataFrame:
    """value: the different elements of the lists in these columns, in natural order."""
    lists = F.flatten(F.array(*[F.split(model.col(f).cast("string"), "[;,]") for f in fields]))
    return df.select(F.explode(lists).alias("value")).distinct().orderBy(nat_key("value"))


def export_view(df: DataFrame, name: str) -> DataFrame:
    """df under a name for spark.sql, with columns that SQL can name without quotes."""
    clean = df.toDF(*[c.replace("-", "_").replace(".", "_") for c in df.columns])
    clean.createOrReplaceTempView(name)
    return clean
