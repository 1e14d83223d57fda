"""Reports and domain analyses composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.values import fixed
from ..natural import chr_clip
from .intervals import BIN, best_match, overlap_join, regions


def compound(df: DataFrame, transcripts: str, criteria: str | None = None, per: str = "sample", least: int = 2) -> DataFrame:
    """Rows of a long table with the number of variants of the same sample in the same transcript, where there
    are least or more: count is the largest over the transcripts of the row."""
    from .select import filter_rows

    x = (filter_rows(df, criteria) if criteria else df).withColumn("_id", F.monotonically_increasing_id()).withColumn("_t", F.explode(F.array_distinct(F.split(model.col(transcripts), "[;,]")))).where(F.col("_t") != "")
    counts = x.groupBy(model.col(per), "_t").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    hits = x.join(counts, [per, "_t"])
    keep = [model.col(c) for c in df.columns]
    return hits.groupBy("_id", *keep).agg(F.max("_n").alias("count"), F.array_join(F.array_sort(F.collect_set("_t")), ",").alias("compound")).drop("_id")


def report_variants(df: DataFrame) -> DataFrame:
    """Numbers of variants by type and zyg, and transitions against transversions of the snps, by sample."""
    pair = F.concat_ws("", F.upper("ref"), F.upper("alt"))
    ti = (F.col("type") == "snp") & pair.isin("AG", "GA", "CT", "TC")
    tv = (F.col("type") == "snp") & ~pair.isin("AG", "GA", "CT", "TC")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy("sample").agg(
        F.count(F.lit(1)).alias("vars"), n(F.col("type") == "snp").alias("snps"), n(F.col("type").isin("ins", "del", "sub")).alias("indels"), n(F.col("zyg") == "m").alias("homozygous"), n(F.col("zyg") == "t").alias("heterozygous"), n(ti).alias("ti"), n(tv).alias("tv"), (n(ti) / F.when(n(tv) > 0, n(tv))).alias("titv")
    )


def benchmark(calls: DataFrame, truth: DataFrame, keys: list[str], score: str, cutoffs: list[float]) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 at each cutoff of the score."""
    t = truth.select(*[model.col(k) for k in keys], F.lit(True).alias("_t")).distinct()
    c = calls.select(*[model.col(k) for k in keys], model.col(score).cast("double").alias("_s")).groupBy(*[model.col(k) for k in keys]).agg(F.max("_s").alias("_s"))
    both = c.join(t, keys, "full")
    n = lambda x: F.sum(F.when(x, 1).otherwise(0))
    one = []
    for x in cutoffs:
        called, true = F.coalesce(F.col("_s") >= x, F.lit(False)), F.col("_t").isNotNull()
        one += [n(called & true).alias(f"tp{x}"), n(called & ~true).alias(f"fp{x}"), n(~called & true).alias(f"fn{x}")]
    row = both.agg(*one)
    parts = F.array(*[F.struct(F.lit(float(x)).alias("cutoff"), model.col(f"tp{x}").alias("tp"), model.col(f"fp{x}").alias("fp"), model.col(f"fn{x}").alias("fn")) for x in cutoffs])
    r = row.select(F.inline(parts))
    p, q = F.col("tp") / F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fp")), F.col("tp") / F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") + F.col("fn"))
    return r.select("*", p.alias("precision"), q.alias("recall"), (2 * p * q / F.when(p + q > 0, p + q)).alias("f1"))


def predict_gender(xcov: float, ycov: float, autosomal: float, hetfraction: float | None = None) -> str:
    """m, f or ? from coverage of X and Y against the autosomes, and the share of heterozygous calls on X."""
    x, y = xcov / autosomal if autosomal else 0.0, ycov / autosomal if autosomal else 0.0
    if y > 0.2 and x < 0.75:
        return "m"
    if y < 0.05 and x > 0.75:
        return "f"
    if hetfraction is not None:
        return "f" if hetfraction > 0.3 else "m" if hetfraction < 0.1 else "?"
    return "?"


def genders(coverage: DataFrame) -> DataFrame:
    """sample, gender from (sample, chromosome, depth): the same rules as columns."""
    mean = lambda c: F.avg(F.when(c, F.col("depth")))
    name = F.regexp_replace("chromosome", "^[Cc][Hh][Rr]", "")
    g = coverage.groupBy("sample").agg(mean(name == "X").alias("x"), mean(name == "Y").alias("y"), mean(~name.isin("X", "Y", "M", "MT")).alias("a"))
    x, y = F.coalesce(F.col("x") / F.col("a"), F.lit(0.0)), F.coalesce(F.col("y") / F.col("a"), F.lit(0.0))
    return g.select("sample", F.when((y > 0.2) & (x < 0.75), "m").when((y < 0.05) & (x > 0.75), "f").otherwise("?").alias("gender"))


def pseudobulk(counts: DataFrame, cells: DataFrame, groups: list[str] | None = None, gene: str = "gene", cell: str = "cell", group: str = "group", value: str = "count") -> DataFrame:
    """Sums of counts by gene and group of cells, a column for each group."""
    if groups is None:
        groups = sorted(r[0] for r in cells.select(group).distinct().limit(10_001).collect())
        if len(groups) > 10_000:
            raise ValueError("more than 10000 groups")
    x = counts.join(cells.select(cell, group), cell)
    return x.groupBy(gene).agg(*[F.coalesce(F.sum(F.when(F.col(group) == g, F.col(value))), F.lit(0)).alias(f"{value}-{g}") for g in groups])


def knee(counts: DataFrame, cell: str = "cell", value: str = "count") -> DataFrame:
    """Cells by falling total, with their rank: the barcode rank curve, a point for each total. Ranks come from
    the number of cells of each total, a small table."""
    totals = counts.groupBy(cell).agg(F.sum(value).alias("total"))
    points = totals.groupBy("total").agg(F.count(F.lit(1)).alias("cells"))
    w = Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    return points.select("total", "cells", F.sum("cells").over(w).alias("rank"))


def methylation(calls: DataFrame, least: float = 2.5) -> DataFrame:
    """Called motifs, methylated ones and their share at each place; calls of a small log ratio are left out."""
    llr, m = F.col("log_lik_ratio"), F.col("num_motifs")
    g = calls.where(F.abs(llr) >= least).groupBy("chromosome", "start", "end").agg(F.sum(m).alias("called"), F.sum(F.when(llr > 0, m).otherwise(0)).alias("methylated"))
    return g.withColumn("frequency", fixed(F.col("methylated") / F.col("called"), 3))


def amplicon_counts(reads: DataFrame, amplicons: DataFrame, name: str = "name", bin_size: int = BIN) -> DataFrame:
    """Reads by the amplicon they share most positions with; amplicons without reads too."""
    x = regions(reads, []).withColumn("_id", F.monotonically_increasing_id())
    p = overlap_join(x, regions(amplicons, [name]), bin_size=bin_size)
    shared = F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")
    best = p.groupBy("a__id").agg(F.max_by(f"b_{name}", F.struct(shared, -F.col("b_begin"), F.col(f"b_{name}"))).alias(name))
    n = best.groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    return amplicons.join(n, name, "left").fillna(0, ["count"])


def coverage_report(segments: DataFrame, targets: DataFrame, cutoffs: list[int], name: str = "name", bin_size: int = BIN) -> DataFrame:
    """For each target: size, positions covered at each cutoff, mean depth. segments: regions with depth."""
    p = overlap_join(regions(segments, ["depth"]), regions(targets, [name]), bin_size=bin_size)
    shared = F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")
    got = p.groupBy(F.col(f"b_{name}").alias(name)).agg(F.sum(shared * F.col("a_depth")).alias("_sum"), *[F.sum(F.when(F.col("a_depth") >= c, shared).otherwise(0)).alias(f"ge{c}") for c in cutoffs])
    t = regions(targets, [name]).groupBy(name).agg(F.sum(F.col("end") - F.col("begin")).alias("size"))
    out = t.join(got, name, "left").fillna(0)
    return out.select(name, "size", (F.col("_sum") / F.when(F.col("size") > 0, F.col("size"))).alias("mean"), *[f"ge{c}" for c in cutoffs])


def value_histogram(segments: DataFrame, targets: DataFrame, value: str, limits: list[float], name: str = "name", bin_size: int = BIN) -> DataFrame:
    """For each target: positions by interval of the value (below the first limit, between limits, from the
    last), size, mean, least and largest; then a row Total, and Totalpercent with the positions of each interval in
    percent of all."""
    v = F.col(f"a_{value}")
    p = overlap_join(regions(segments, [value]), regions(targets, [name]), bin_size=bin_size).withColumn("_n", F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin"))
    edges = [None, *limits, None]
    cells = []
    for lo, hi in zip(edges, edges[1:]):
        cond = F.lit(True)
        cond = cond & (v >= lo) if lo is not None else cond
        cond = cond & (v < hi) if hi is not None else cond
        cells.append(F.sum(F.when(cond, F.col("_n")).otherwise(0)).alias(f"r{'' if lo is None else lo}<{'' if hi is None else hi}"))
    rest = [F.sum("_n").alias("size"), fixed(F.sum(v * F.col("_n")) / F.sum("_n"), 2).cast("double").alias("avg"), F.min(v).alias("min"), F.max(v).alias("max")]
    by, total = p.groupBy(F.col(f"b_{name}").alias(name)).agg(*cells, *rest), p.agg(F.lit("Total").alias(name), *cells, *rest)
    intervals = by.columns[1 : len(cells) + 1]
    share = [fixed(F.lit(100.0) * model.col(c) / F.when(F.col("size") > 0, F.col("size")), 2).cast("double").alias(c) for c in intervals]
    wide = lambda t: t.select(F.col(name).cast("string").alias(name), *[model.col(c).cast("double").alias(c) for c in intervals], F.col("size").cast("double").alias("size"), *["avg", "min", "max"])
    percent = total.select(F.lit("Totalpercent"), *share, F.lit(100.0), *[F.lit(None).cast(t) for _, t in total.dtypes[-3:]])
    return wide(by).union(wide(total)).union(percent)


def combine_reports(reports: DataFrame) -> DataFrame:
    """Long reports (sample, source, parameter, value) as a table of samples: a column source_parameter each."""
    names = sorted(r[0] for r in reports.select(F.concat_ws("_", "source", "parameter")).distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("more than 10000 parameters")
    key = F.concat_ws("_", "source", "parameter")
    return reports.groupBy("sample").agg(*[F.max(F.when(key == n, F.col("value"))).alias(n) for n in names])


def homopolymers(sequences: DataFrame, name: str = "chromosome", seq: str = "seq", least: int = 6) -> DataFrame:
    """Runs of least or more equal bases: name, begin, end, base, size. Positions come from the lengths of
    the runs a sequence splits into, without a UDF."""
    runs = F.regexp_extract_all(F.upper(model.col(seq)), F.lit(r"((.)\2*)"), F.lit(1))
    x = sequences.select(model.col(name).alias(name), runs.alias("_r"))
    ends = F.aggregate("_r", F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)) + F.length(r))))
    each = F.filter(F.zip_with("_r", ends, lambda r, e: F.struct((e - F.length(r)).cast("long").alias("begin"), e.cast("long").alias("end"), F.substring(r, 1, 1).alias("base"), F.length(r).cast("long").alias("size"))), lambda s: s["size"] >= least)
    return x.select(name, F.inline(each))


def homozygous_runs(calls: DataFrame, least: int = 25, length: int = 0, gap: int = 1_000_000, by: str = "sample") -> DataFrame:
    """Runs of homozygous calls (zyg m) of a sample that follow each other without a heterozygous one (t or c) or a
    gap between: least or more calls over length or more positions. Other calls are passed over."""
    x = calls.where(F.col("zyg").isin("m", "t", "c")).select(model.col(by), chr_clip("chromosome").alias("chromosome"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), (F.col("zyg") == "m").alias("_hom"))
    w = Window.partitionBy(by, "chromosome").orderBy("begin", "end")
    new = ~F.col("_hom") | ~F.lag("_hom", 1, False).over(w) | (F.col("begin") - F.lag("end").over(w) > gap)
    runs = x.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_hom").groupBy(by, "chromosome", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("calls"))
    return runs.where((F.col("calls") >= least) & (F.col("end") - F.col("begin") >= length)).drop("_run")


def noise(pileup: DataFrame, depth: int = 20, bins: int = 100) -> DataFrame:
    """Positions by the share of reads that disagree with the reference, in bins of the share: bin (its lower end in
    percent of bins), positions. pileup: a row for each position and base (chromosome, pos, ref, base, count);
    positions of less depth are left out."""
    p = pileup.groupBy("chromosome", "pos").agg(F.sum("count").alias("_n"), F.sum(F.when(F.upper("base") != F.upper("ref"), F.col("count")).otherwise(0)).alias("_e")).where(F.col("_n") >= depth)
    return p.groupBy(F.least(F.floor(F.col("_e") * bins / F.col("_n")), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("positions"))


def error_rate(pileup: DataFrame) -> DataFrame:
    """bases, errors and their share over all positions of such a table."""
    wrong = F.when(F.upper("base") != F.upper("ref"), F.col("count")).otherwise(0)
    return pileup.agg(F.sum("count").alias("bases"), F.sum(wrong).alias("errors")).withColumn("rate", F.col("errors") / F.when(F.col("bases") > 0, F.col("bases")))


def clip_to_amplicons(reads: DataFrame, amplicons: DataFrame, bin_size: int = BIN) -> DataFrame:
    """reads cut to the amplicon they share most positions with (its outer parts, the primers, left out: from
    outerbegin+primers to the end before them if the table has begin and end of the inner part); reads of no
    amplicon as they are."""
    best = best_match(reads.withColumn("_o", F.lit(1)), amplicons.withColumn("_ab", F.col("begin")).withColumn("_ae", F.col("end")), ["_ab", "_ae"], [-(F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")), F.col("b_begin"), F.col("b_end")], {}, False, 0, bin_size)
    b, e = F.greatest("begin", F.coalesce("_ab", "begin")), F.least("end", F.coalesce("_ae", "end"))
    cells = {"begin": b, "end": e}
    return best.select(*[cells.get(c, model.col(c)).alias(c) for c in reads.columns])
