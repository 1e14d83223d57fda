"""Count tables of genes and transcripts of several samples, merged; gene lists as regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip

NOVEL = "^(novel|transcript_|gene_)"


def _long(tables: dict[str, DataFrame], columns: list[str], values: list[str]) -> DataFrame:
    parts = [t.select(*[model.col(c) for c in columns], *[model.col(v) for v in values]).withColumn("_s", F.lit(s)) for s, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("chromosome", chr_clip("chromosome")).withColumn("begin", F.col("begin").cast("long")).withColumn("end", F.col("end").cast("long"))


def _clustered(df: DataFrame, by: list[str]) -> DataFrame:
    """df with _first and _last: the extent of the chain of overlapping rows that a row belongs to. Rows of a
    chromosome and strand are in one window, which spills; novel genes are few beside reads."""
    w = Window.partitionBy(*by).orderBy("begin", "end")
    new = F.coalesce(F.col("begin") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    run = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*by, "_run")
    return run.withColumn("_first", F.min("begin").over(whole)).withColumn("_last", F.max("end").over(whole)).drop("_new", "_run")


def _cells(tables: dict[str, DataFrame], values: list[str], empty: int) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("_s") == s, model.col(v))), F.lit(empty)).alias(f"{v}-{s}") for s in tables for v in values]


def multigene(tables: dict[str, DataFrame], values: list[str], ident: str = "geneid", novel: str = NOVEL, empty: int = 0) -> DataFrame:
    """chromosome, begin, end, strand, the id and value-sample for each gene of any table. Known genes meet by their
    id; novel ones (whose id matches) where they overlap on the same strand, under an id made of their extent."""
    x = _long(tables, ["chromosome", "begin", "end", "strand", ident], values)
    known = x.where(~F.coalesce(model.col(ident).rlike(novel), F.lit(True))).select("*", F.col("begin").alias("_first"), F.col("end").alias("_last"))
    found = _clustered(x.where(F.coalesce(model.col(ident).rlike(novel), F.lit(True))), ["chromosome", "strand"])
    found = found.withColumn(ident, F.concat_ws("_", F.lit("novelg"), "chromosome", "strand", F.col("_first").cast("string"), F.col("_last").cast("string")))
    rows = known.unionByName(found)
    return rows.groupBy("chromosome", "strand", model.col(ident)).agg(F.min("_first").alias("begin"), F.max("_last").alias("end"), *_cells(tables, values, empty)).select("chromosome", "begin", "end", "strand", ident, *[model.col(f"{v}-{s}") for s in tables for v in values])


def multitranscript(tables: dict[str, DataFrame], values: list[str], ident: str = "transcript", novel: str = NOVEL, empty: int = 0) -> DataFrame:
    """Transcripts of all tables with value-sample. Known ones meet by id, novel ones by strand and junctions (the
    ends of exons but the last, the starts but the first): the extent is that of all; those of one exon meet where
    they overlap."""
    x = _long(tables, ["chromosome", "begin", "end", "strand", ident, "exonStarts", "exonEnds"], values)
    numbers = lambda c: F.filter(F.split(F.col(c).cast("string"), ","), lambda v: v != "")
    s, e = numbers("exonStarts"), numbers("exonEnds")
    x = x.withColumn("_n", F.size(s)).withColumn("_starts", F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))).withColumn("_ends", F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))))
    fresh = F.coalesce(model.col(ident).rlike(novel), F.lit(True))
    single = _clustered(x.where(fresh & (F.col("_n") <= 1)), ["chromosome", "strand"]).withColumn("_key", F.concat_ws("_", F.lit("1"), F.col("_first").cast("string")))
    spliced = x.where(fresh & (F.col("_n") > 1)).withColumn("_key", F.concat_ws("_", F.array_join("_ends", ","), F.array_join("_starts", ",")))
    known = x.where(~fresh).withColumn("_key", model.col(ident))
    rows = reduce(DataFrame.unionByName, [known, spliced, single.drop("_first", "_last")])
    joins = F.min(F.struct(F.array_join("_starts", ",").alias("s"), F.array_join("_ends", ",").alias("e"))).alias("_j")
    g = rows.withColumn("_fresh", fresh).groupBy("chromosome", "strand", "_fresh", "_key").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("_n").alias("exonCount"), joins, *_cells(tables, values, empty))
    name = F.when(F.col("_fresh"), F.concat_ws("_", F.lit("novelt"), "chromosome", "strand", F.col("begin").cast("string"), F.col("end").cast("string"), F.substring(F.md5("_key"), 1, 8))).otherwise(F.col("_key"))
    full = lambda a, b: F.concat(F.concat_ws(",", F.when(a != "", a), F.when(b != "", b)), F.lit(","))
    return g.select("chromosome", "begin", "end", "strand", name.alias(ident), "exonCount", full(F.col("begin").cast("string"), F.col("_j.s")).alias("exonStarts"), full(F.col("_j.e"), F.col("end").cast("string")).alias("exonEnds"), *[model.col(f"{v}-{t}") for t in tables for v in values])


def gene_annotations_to_regions(annotations: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """chromosome, begin, end and the annotation's fields for each gene of a list: the extent of its transcripts on
    each chromosome and strand."""
    extent = genes.groupBy(model.col(gene), "chromosome", "strand").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    rest = [c for c in annotations.columns if c != gene]
    return annotations.join(extent, gene).select("chromosome", "begin", "end", "strand", gene, *[model.col(c) for c in rest])
