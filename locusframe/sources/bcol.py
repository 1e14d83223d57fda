"""A value for each position, kept as runs of equal values (chromosome, begin, end, value) in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip
from ..operators.intervals import BIN, overlap_join, regions, regjoin_fields

TYPES = {"c": "tinyint", "s": "smallint", "i": "int", "w": "bigint", "f": "float", "d": "double", "cu": "smallint", "su": "int", "iu": "bigint", "wu": "decimal(20,0)"}


def make(df: DataFrame, value: str, position: str = "pos", end: str | None = None, chromosome: str | None = "chromosome", kind: str = "d") -> DataFrame:
    """Runs of a table of positions or regions: neighbours of equal value are one."""
    c = chr_clip(model.col(chromosome)) if chromosome else F.lit("")
    b = model.col(position).cast("long")
    x = df.select(c.alias("chromosome"), b.alias("begin"), (model.col(end).cast("long") if end else b + 1).alias("end"), model.col(value).cast(TYPES[kind]).alias("value"))
    return regjoin_fields(x, ["value"])


def get(runs: DataFrame, chromosome: str, begin: int, end: int, default: float = 0) -> DataFrame:
    """pos, value of [begin, end), the default where there is no run."""
    x = runs.where((chr_clip("chromosome") == chr_clip(F.lit(chromosome))) & (F.col("begin") < end) & (F.col("end") > begin))
    each = x.select(F.explode(F.sequence(F.greatest("begin", F.lit(begin)), F.least("end", F.lit(end)) - 1)).alias("pos"), "value")
    every = runs.sparkSession.range(begin, end).withColumnRenamed("id", "pos")
    return every.join(each, "pos", "left").select("pos", F.coalesce("value", F.lit(default)).alias("value"))


def table(runs: DataFrame) -> DataFrame:
    """chromosome, pos, value of every position."""
    return runs.where("begin < end").select("chromosome", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"), "value")


def size(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("size"))


def regions_of(runs: DataFrame, low: float | None = None, high: float | None = None, size: int = BIN) -> DataFrame:
    """Stretches whose values are from low to high, from the runs themselves."""
    from ..operators.intervals import regjoin

    v = F.col("value")
    cond = v.isNotNull()
    cond = cond & (v >= low) if low is not None else cond
    cond = cond & (v <= high) if high is not None else cond
    return regjoin(runs.where(cond).select("chromosome", "begin", "end"), size=size)


def make_multi(df: DataFrame, value: str, allele: str = "alt", position: str = "pos", chromosome: str = "chromosome", kind: str = "d") -> DataFrame:
    """A value for each position and allele: (chromosome, pos, values), a map of allele to value. Lists of alleles
    with lists of values are taken apart; of several values of an allele the largest counts."""
    alleles, values = (F.split(model.col(c).cast("string"), ",") for c in (allele, value))
    each = df.select(chr_clip(model.col(chromosome)).alias("chromosome"), model.col(position).cast("long").alias("pos"), F.explode(F.arrays_zip(alleles.alias("a"), values.alias("v"))).alias("x"))
    one = each.groupBy("chromosome", "pos", F.col("x.a").alias("a")).agg(F.max(F.col("x.v").cast(TYPES[kind])).alias("v"))
    return one.groupBy("chromosome", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "v")))).alias("values"))


def at_multi(df: DataFrame, multi: DataFrame, default: float = 0, name: str = "value") -> DataFrame:
    """df with a value for each of a row's alleles, joined by commas; the default where there is none and for rows
    that aren't one base long."""
    m = multi.select(F.col("chromosome").alias("_c"), F.col("pos").alias("_p"), F.col("values").alias("_v"))
    x = df.join(m, (chr_clip("chromosome") == F.col("_c")) & (F.col("begin").cast("long") == F.col("_p")) & (F.col("end").cast("long") == F.col("begin").cast("long") + 1), "left")
    each = F.transform(F.split("alt", ","), lambda a: F.coalesce(F.get(F.map_values(F.map_filter("_v", lambda k, v: k == a)), F.lit(0)), F.lit(default).cast(multi.schema["values"].dataType.valueType)).cast("string"))
    return x.select(*[model.col(c) for c in df.columns], F.array_join(each, ",").alias(name))


def at(df: DataFrame, runs: DataFrame, default: float = 0, bin_size: int = BIN) -> DataFrame:
    """df with the value at the begin of each region."""
    from ..operators.variants import annotate_positions

    return annotate_positions(df, runs, "value", default, bin_size)


__all__ = ["at", "at_multi", "get", "make", "make_multi", "overlap_join", "regions", "regions_of", "size", "table"]
