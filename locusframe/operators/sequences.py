"""Sequences of regions from a genome in chunks (chromosome, start, seq; each of chunk bases)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip


def reverse_complement(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGTacgtUu", "TGCAtgcaAa"))


def extract(a: DataFrame, genome: DataFrame, chunk: int = 10_000, name: str = "sequence") -> DataFrame:
    """a with the bases of each row; null where the genome lacks the place. Rows meet the chunks they touch. Joins are
    merges, as the guessed size of a genome in chunks may be a small part of what it takes."""
    x = a.withColumn("_id", F.monotonically_increasing_id())
    b, e = F.col("begin").cast("long"), F.col("end").cast("long")
    places = x.select("_id", chr_clip("chromosome").alias("_chr"), b.alias("_b"), e.alias("_e"), F.explode(F.sequence(F.floor(b / chunk), F.floor(F.greatest(e - 1, b) / chunk))).alias("_c"))
    g = genome.select(chr_clip("chromosome").alias("_chr"), F.floor(F.col("start") / chunk).alias("_c"), F.col("start").alias("_st"), F.col("seq").alias("_seq"))
    lo, hi = F.greatest("_b", "_st"), F.least(F.col("_e"), F.col("_st") + chunk)
    piece = F.struct("_c", F.substring(F.col("_seq"), (lo - F.col("_st") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("s"))
    got = places.join(g.hint("merge"), ["_chr", "_c"]).groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "").alias(name))
    return x.join(got.hint("merge"), "_id", "left").select(*[model.col(c) for c in a.columns], name)
