"""Reads and counts of single cells: barcodes, filters, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def barcodes(reads: DataFrame, known: DataFrame, seq: str = "seq", start: int = 0, size: int = 16, umi: int = 12) -> DataFrame:
    """reads with barcode, umi and the number of mismatches (0 or 1): the known barcode (a column barcode) at a place of
    the read, or else the only one that differs in one base. Reads without one are left out. Each known barcode
    is listed under itself and under size patterns with one base left open, so candidates meet by equality."""
    raw = F.substring(model.col(seq), start + 1, size)
    x = reads.withColumn("_id", F.monotonically_increasing_id()).withColumn("_raw", raw).where(F.length("_raw") == size)
    patterns = lambda c: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("."), F.substring(c, i + 1, F.lit(size))))
    k = known.select("barcode").distinct()
    exact = x.join(k, x["_raw"] == k["barcode"])
    rest = x.join(k.select(F.col("barcode").alias("_raw")), "_raw", "left_anti")
    near = rest.select("_id", F.explode(patterns(F.col("_raw"))).alias("_p")).join(k.select("barcode", F.explode(patterns(F.col("barcode"))).alias("_p")), "_p")
    one = near.groupBy("_id").agg(F.count_distinct("barcode").alias("_n"), F.min("barcode").alias("barcode")).where("_n = 1").drop("_n")
    keep = [model.col(c) for c in reads.columns]
    tail = F.substring(model.col(seq), start + size + 1, umi).alias("umi")
    return exact.select(*keep, "barcode", tail, F.lit(0).alias("mismatches")).union(rest.join(one, "_id").select(*keep, "barcode", tail, F.lit(1).alias("mismatches")))


def demultiplex(reads: DataFrame, cells: DataFrame, path: str, barcode: str = "barcode", sample: str = "sample") -> None:
    """A folder of files for each sample, by the cell that a read's barcode belongs to; reads of no cell go to none."""
    x = reads.join(cells.select(F.col(barcode), F.col(sample).alias("_sample")), barcode, "left").fillna("none", ["_sample"])
    x.write.mode("overwrite").partitionBy("_sample").parquet(path)


def filter_cells(counts: DataFrame, cell: str = "cell", value: str = "count", least: int = 1) -> DataFrame:
    """Counts of the cells above the knee of the rank curve: the point of log rank and log total that lies farthest
    above the line between its ends. The curve has a point for each total, so its window is over a small table."""
    from .analytics import knee

    totals = counts.groupBy(model.col(cell)).agg(F.sum(model.col(value)).alias("total")).where(F.col("total") >= least)
    points = knee(totals, cell, "total").select("total", F.log10("rank").alias("x"), F.log10("total").alias("y"))
    ends = points.agg(F.min_by("x", F.struct("x", -F.col("y"))).alias("x0"), F.max("y").alias("y0"), F.max("x").alias("x1"), F.min("y").alias("y1"))
    above = (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) - (F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cut = points.join(F.broadcast(ends)).agg(F.max_by("total", F.struct(above, F.col("total"))).alias("_cut"))  # one row each
    kept = totals.join(F.broadcast(cut)).where(F.col("total") >= F.col("_cut")).select(cell)
    return counts.join(kept, cell, "left_semi")


def cell_report(counts: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "count") -> DataFrame:
    """cell, total, genes: counts and genes with any of each cell."""
    v = model.col(value)
    return counts.groupBy(model.col(cell)).agg(F.sum(v).alias("total"), F.count(F.when(v > 0, 1)).alias("genes"))


def first_hits(mappings: DataFrame, group: list[str], order: list[str], mate: str) -> DataFrame:
    """For each group of mappings the middle of the first hit and of its mate's: place1 and place2. order: columns
    that give the order in a group; mate: the number of the mate's hit in that order (from 0), null without one."""
    w = Window.partitionBy(*[model.col(g) for g in group]).orderBy(*[model.col(o) for o in order])
    x = mappings.withColumn("_n", F.row_number().over(w) - 1).withColumn("_middle", F.floor((F.col("begin") + F.col("end")) / 2))
    first = x.where("_n = 0").select(*[model.col(g) for g in group], F.col("chromosome").alias("chromosome1"), F.col("_middle").alias("place1"), model.col(mate).cast("int").alias("_m"))
    other = x.select(*[model.col(g) for g in group], F.col("_n").alias("_m"), F.col("chromosome").alias("chromosome2"), F.col("_middle").alias("place2"))
    return first.join(other, [*group, "_m"], "left").drop("_m")
