"""VCF, SAM, BED, GTF, FASTA and FASTQ as tables and back. All parsing is by native column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip, nat_sort_key
from ..operators.select import ordered
from .tsv import find_header, head_lines, lines

_RENAME = {"DP": "coverage", "GQ": "genoqual", "AD": "alleledepth", "PS": "phaseset"}


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, number, type, description of a VCF's header; other lines have their value as description."""
    x = lines(spark, path).where(F.col("value").startswith("##")).distinct()  # parts repeat it
    part = lambda k: F.regexp_extract("value", rf"[<,]{k}=([^,>]*)", 1)
    kind, rest = F.regexp_extract("value", "^##([^=]*)=", 1), F.regexp_extract("value", "^##[^=]*=(.*)$", 1)
    structured = rest.startswith("<")
    return x.select(kind.alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"), F.when(structured, F.regexp_extract("value", r'Description="((?:[^"\\\\]|\\\\.)*)"', 1)).otherwise(rest).alias("description"))


def vcf_cat(spark: SparkSession, paths: list[str], sort: bool = False) -> DataFrame:
    """Lines (value) of several VCFs of the same samples as of one: the header of the first, then the rows of all, in
    natural order of place with sort. _row tells them apart: 0 and 1."""
    from functools import reduce

    heads = [[x for x in head_lines(spark, p) if x.startswith("#CHROM")] for p in paths]
    if any(h != heads[0] for h in heads):
        raise ValueError("samples differ")
    body = reduce(DataFrame.union, [lines(spark, p) for p in paths]).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    top = [x for x in head_lines(spark, paths[0]) if x.startswith("#")]
    top = top[: next(i for i, x in enumerate(top) if x.startswith("#CHROM")) + 1]  # parts repeat it
    both = spark.createDataFrame([(0, x) for x in top], "_row int, value string").coalesce(1).union(body.select(F.lit(1), "value"))
    return sort_vcf(both) if sort else both


def sort_vcf(rows: DataFrame) -> DataFrame:
    """Lines (_row, value) with the rows in natural order of chromosome and position; the header as it is."""
    p = F.split("value", "\t")
    row = F.col("_row") == 1
    place = (chr_clip(F.get(p, F.lit(0))), True), (F.get(p, F.lit(1)).cast("long"), False), (F.col("value"), False)
    return ordered(rows, [(F.col("_row"), False, False), *[(F.when(row, c), natural, False) for c, natural in place]])


_GENEPRED = ["name", "chromosome", "strand", "begin", "end", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"]


def genepred2tsv(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a genePred file, with a bin at the begin of its rows or without."""
    first = next((x for x in head_lines(spark, path) if not x.startswith("#")), "")
    binned = bool(re.match(r"\d+\t[^\t]*\t[^\t]*\t[+-]\t", first))
    x = _columns(lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")), ([*["bin"] * binned, *_GENEPRED]))
    kinds = {c: "long" for c in ("begin", "end", "cdsStart", "cdsEnd")} | {"exonCount": "int"}
    order = ["chromosome", "begin", "end", "name", "name2", "strand", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds"]
    return x.select(*[F.col(c).cast(kinds.get(c, "string")).alias({"name2": "gene", "name": "transcript"}.get(c, c)) for c in order])


def genepred2fasta(genes: DataFrame, genome: DataFrame, chunk: int = 10_000) -> DataFrame:
    """transcript, sequence: exons joined, in the direction of the strand. genome: chromosome, start, seq, in chunks."""
    from ..operators.sequences import extract, reverse_complement

    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    exons = F.zip_with(numbers("exonStarts"), numbers("exonEnds"), lambda b, e: F.struct(b.alias("begin"), e.alias("end")))
    each = genes.select("chromosome", "transcript", "strand", F.inline(exons))
    parts = extract(each, genome, chunk).groupBy("chromosome", "transcript", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "sequence"))), lambda s: s["sequence"]), "").alias("_s"))
    return parts.select("transcript", F.when(F.col("strand") == "-", reverse_complement(F.col("_s"))).otherwise(F.col("_s")).alias("sequence"))


def gb2fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence of GenBank records, which end at //."""
    x = spark.read.option("lineSep", "\n//").text(path)
    name = F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s\d]", ""))
    return x.where(name != "").select(name.alias("id"), seq.alias("sequence"))


def _columns(path_df: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return path_df.select(parts.alias("_p")).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def vcf2tsv(spark: SparkSession, path: str, info: list[str] | None = None, split: bool = True) -> DataFrame:
    """Variants with 0-based half-open places: bases that ref and alt share at the begin (and end) are cut.
    A row for each allele (split); for each sample alleleSeq1, alleleSeq2, sequenced, zyg and FORMAT fields."""
    _, names, _ = find_header(head_lines(spark, path))
    samples = names[9:]
    rows = _columns(lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")), names)
    x = rows.withColumn("_alts", F.split("ALT", ","))
    x = x.select("*", F.posexplode("_alts").alias("_i", "_alt")) if split else x.withColumn("_i", F.lit(0)).withColumn("_alt", F.get("_alts", F.lit(0)))
    ref, alt, pos = F.upper("REF"), F.upper("_alt"), F.col("POS").cast("long") - 1
    # what is shared: the begin first, then the end of the rest
    n = F.least(F.length("REF"), F.length("_alt"))
    lead = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= n) & (F.substring(ref, F.lit(1), i) == F.substring(alt, F.lit(1), i)), i).otherwise(s))
    x = x.withColumn("_lead", F.when(F.col("REF") == F.col("_alt"), 0).otherwise(lead))
    r1, a1 = F.expr("substring(REF, _lead + 1)"), F.expr("substring(_alt, _lead + 1)")
    x = x.withColumn("_r", r1).withColumn("_a", a1)
    m = F.least(F.length("_r"), F.length("_a"))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= m) & (F.substring(F.reverse("_r"), F.lit(1), i) == F.substring(F.reverse("_a"), F.lit(1), i)), i).otherwise(s))
    x = x.withColumn("_tail", F.when((F.length("_r") > 1) & (F.length("_a") > 1), F.least(tail, m - 1)).otherwise(0))
    r2, a2 = F.expr("left(_r, length(_r) - _tail)"), F.expr("left(_a, length(_a) - _tail)")
    begin = pos + F.col("_lead")
    kind = F.when((F.length(r2) == 1) & (F.length(a2) == 1), "snp").when(F.length(r2) == 0, "ins").when(F.length(a2) == 0, "del").otherwise("sub")
    cols: list[Column] = [F.col("CHROM").alias("chromosome"), begin.alias("begin"), (begin + F.length(r2)).alias("end"), kind.alias("type"), r2.alias("ref"), a2.alias("alt"), F.when(F.col("ID") == ".", "").otherwise(F.col("ID")).alias("name"), F.when(F.col("QUAL") != ".", F.col("QUAL").cast("double")).alias("quality"), F.col("FILTER").alias("filter")]
    for s in samples:
        suffix = f"-{s}" if len(samples) > 1 else ""
        keys, values = F.split("FORMAT", ":"), F.split(model.col(s), ":")
        value = lambda k, keys=keys, values=values: F.get(values, (F.array_position(keys, k) - 1).cast("int"))
        gt = F.split(value("GT"), "[|/]")

        def allele(k: int, gt=gt) -> Column:
            g = F.coalesce(F.get(gt, F.lit(k)), F.get(gt, F.lit(0)))
            code = F.when(g.rlike(r"^\d+$"), g.cast("int"))
            other = F.get(F.col("_alts"), code - 1)
            return F.when(code.isNull(), "?").when(code == 0, r2).when(code == F.col("_i") + 1, a2).otherwise(other)

        a, b = allele(0), allele(1)
        from ..functions.library import zyg
        from ..functions.values import Value

        seq = F.when((a == "?") | (b == "?"), "u").when((a == a2) | (b == a2), "v").otherwise("r")
        called = F.when(seq == "u", "u").otherwise("v")
        z = zyg([Value(c, "text") for c in (called, a, b, r2, a2)]).col
        cols += [a.alias("alleleSeq1" + suffix), b.alias("alleleSeq2" + suffix), F.when(value("GT").contains("|"), "1").otherwise("0").alias("phased" + suffix), seq.alias("sequenced" + suffix), z.alias("zyg" + suffix)]
        cols += [value(k).alias(n + suffix) for k, n in _RENAME.items()]
    tags = F.expr("str_to_map(INFO, ';', '=')")
    cols += [F.coalesce(tags[k], F.when(F.map_contains_key(tags, k), "1")).alias(k) for k in info or []]
    return x.select(*cols)


def tsv2vcf(df: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Lines of a VCF (value), its header not among them. Alleles of one place are one line. Insertions and
    deletions are written from a column refbase, the base before them (N without)."""
    samples = samples or sorted({c.split("-", 1)[1] for c in df.columns if c.startswith("alleleSeq1-")}, key=nat_sort_key) or [""]
    base = F.col("refbase") if "refbase" in df.columns else F.lit("N")
    indel = (F.length("ref") == 0) | (F.length("alt") == 0)
    pos = F.col("begin").cast("long") + F.when(indel, 0).otherwise(1)
    r, a = F.when(indel, F.concat(base, "ref")).otherwise(F.col("ref")), F.when(indel, F.concat(base, "alt")).otherwise(F.col("alt"))
    names = {s: (f"-{s}" if s else "") for s in samples}
    cells = [F.struct(model.col(f"alleleSeq1{n}").alias("a"), model.col(f"alleleSeq2{n}").alias("b")).alias(f"_s{i}") for i, n in enumerate(names.values()) if f"alleleSeq1{n}" in df.columns]
    q = F.coalesce(F.col("quality").cast("string"), F.lit(".")) if "quality" in df.columns else F.lit(".")
    x = df.select("chromosome", pos.alias("pos"), r.alias("r"), a.alias("a"), F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), q.alias("q"), *cells)
    entry = F.struct("a", "_alt", "_ref", "q", *[f"_s{i}" for i in range(len(cells))])
    g = x.groupBy("chromosome", "pos", "r").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    alts = F.transform("e", lambda s: s["_alt"])
    first = F.get("e", F.lit(0))

    def code(i: int, k: str) -> Column:
        v = first[f"_s{i}"][k]
        at = F.array_position(alts, v)
        return F.when(v == "?", ".").when(at > 0, at.cast("string")).when(v == first["_ref"], "0").otherwise(".")

    gts = [F.concat(code(i, "a"), F.lit("/"), code(i, "b")) for i in range(len(cells))]
    return g.select(F.concat_ws("\t", "chromosome", F.col("pos").cast("string"), F.lit("."), "r", F.array_join(F.transform("e", lambda s: s["a"]), ","), first["q"], F.lit("."), F.lit("."), *([F.lit("GT"), *gts] if gts else [])).alias("value"))


SAM = ["qname", "flag", "rname", "pos", "mapquality", "cigar", "rnext", "pnext", "tlen", "seq", "quality"]
_FLAGS = {"paired": 1, "properpair": 2, "unmapped": 4, "mateunmapped": 8, "reverse": 16, "matereverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}


def sam2tsv(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Alignments with 0-based half-open places: the end and clipped lengths from the CIGAR, flags as 0 and 1."""
    x = _columns(lines(spark, path).where(~F.col("value").rlike("^@[A-Z][A-Z](\t|$)") & (F.col("value") != "")).withColumn("_all", F.split("value", "\t", -1)).select("value"), [*SAM, *[f"_t{i}" for i in range(60)]])
    flag = F.col("flag").cast("int")
    total = lambda ops: F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    begin = F.col("pos").cast("long") - 1
    left = F.coalesce(F.nullif(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("long"), F.lit(0))
    length = total("MIS=X")
    right = F.coalesce(F.nullif(F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1), F.lit("")).cast("long"), F.lit(0))
    others = F.array_compact(F.array(*[F.col(f"_t{i}") for i in range(60)]))
    tag = lambda t: F.regexp_extract(F.coalesce(F.get(F.filter(others, lambda o: o.startswith(t + ":")), F.lit(0)), F.lit("")), r"^..:.:(.*)$", 1)
    return x.select(
        F.col("rname").alias("chromosome"), begin.alias("begin"), (begin + total("MDN=X")).alias("end"), F.when(flag.bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), "qname", left.alias("qstart"), (length - right).alias("qend"),
        F.col("mapquality").cast("int").alias("mapquality"), "cigar", "seq", "quality", flag.alias("flag"), *[(flag.bitwiseAND(v) > 0).cast("int").alias(k) for k, v in _FLAGS.items()],
        F.col("rnext").alias("ref2"), (F.col("pnext").cast("long") - 1).alias("begin2"), F.col("tlen").cast("long").alias("tlen"), *[tag(t).alias(t) for t in tags or []], F.array_join(others, " ").alias("other"),
    )


def tsv2sam(df: DataFrame) -> DataFrame:
    """Lines of a SAM file (value) of a table as sam2tsv makes it."""
    s = lambda c: c.cast("string")
    tags = F.when(F.col("other") == "", F.lit(None)).otherwise(F.translate("other", " ", "\t"))
    return df.select(F.concat_ws("\t", "qname", s(F.col("flag")), "chromosome", s(F.col("begin") + 1), s(F.col("mapquality")), "cigar", "ref2", s(F.col("begin2") + 1), s(F.col("tlen")), "seq", "quality", tags).alias("value"))


BED = ["chromosome", "begin", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]


def bed2tsv(spark: SparkSession, path: str) -> DataFrame:
    """As many columns as the first row has."""
    first = next((x for x in head_lines(spark, path) if not re.match(r"(#|track|browser)", x) and x), "")
    n = len(re.split(r"[\t ]+", first.rstrip())) if first else 3
    parts = F.split(F.rtrim("value"), "[\t ]+", -1)
    body = lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)") & (F.col("value") != "")).select(parts.alias("_p"))
    kinds = {"begin": "long", "end": "long", "thickStart": "long", "thickEnd": "long", "blockCount": "int"}
    return body.select(*[F.get("_p", F.lit(i)).cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(BED[:n])])


def bed2genes(bed: DataFrame) -> DataFrame:
    """Transcripts from rows of 12 columns."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    starts = F.transform(numbers("blockStarts"), lambda x: x + F.col("begin"))
    ends = F.zip_with(starts, numbers("blockSizes"), lambda s, n: s + n)
    text = lambda a: F.concat(F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit(","))
    return bed.select("chromosome", "begin", "end", "name", "strand", F.col("thickStart").alias("cdsStart"), F.col("thickEnd").alias("cdsEnd"), F.size(starts).alias("exonCount"), text(starts).alias("exonStarts"), text(ends).alias("exonEnds"))


def tsv2bed(df: DataFrame) -> DataFrame:
    """Lines of a BED file (value): the columns of the format that the table has, without gaps."""
    roles = model.resolve_roles(df.columns, ("chromosome", "begin", "end"))
    cols = [model.col(roles[r]).cast("string") for r in ("chromosome", "begin", "end")]
    for c in BED[3:]:
        if c not in df.columns:
            break
        cols.append(F.coalesce(model.col(c).cast("string"), F.lit("")))
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def _attribute(name: str) -> Column:
    gtf = F.regexp_extract("attributes", rf'(?:^|;\s*){name}\s+"?([^";]*)"?', 1)
    gff = F.regexp_extract("attributes", rf"(?:^|;\s*){name}=([^;]*)", 1)
    return F.when(gtf != "", gtf).otherwise(gff)


def gtf2tsv(spark: SparkSession, path: str, attributes: list[str] | None = None) -> DataFrame:
    """A row for each transcript: exons in order as comma lists, the coding part, genes."""
    names = ["chromosome", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]
    x = _columns(lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")), names).where(F.col("feature").isin("exon", "CDS"))
    transcript = F.coalesce(F.nullif(_attribute("transcript_id"), F.lit("")), _attribute("Parent"))
    x = x.select("chromosome", "feature", (F.col("start").cast("long") - 1).alias("b"), F.col("end").cast("long").alias("e"), "strand", "source", transcript.alias("transcript"), _attribute("gene_id").alias("geneid"), _attribute("gene_name").alias("gene"), *[_attribute(a).alias(a) for a in attributes or []])
    exons = F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("feature") == "exon", F.struct("b", "e")))))
    cds, exon = F.col("feature") == "CDS", F.col("feature") == "exon"
    g = x.groupBy("chromosome", "strand", "transcript").agg(F.min(F.when(exon, F.col("b"))).alias("begin"), F.max(F.when(exon, F.col("e"))).alias("end"), F.min(F.when(cds, F.col("b"))).alias("_cs"), F.max(F.when(cds, F.col("e"))).alias("_ce"), exons.alias("_x"), *[F.max(c).alias(c) for c in ("geneid", "gene", "source", *(attributes or []))])
    text = lambda k: F.concat(F.array_join(F.transform("_x", lambda s: s[k].cast("string")), ","), F.lit(","))
    return g.select("chromosome", "begin", "end", "transcript", "gene", "geneid", "strand", F.coalesce("_cs", "end").alias("cdsStart"), F.coalesce("_ce", "end").alias("cdsEnd"), F.size("_x").alias("exonCount"), text("b").alias("exonStarts"), text("e").alias("exonEnds"), "source", *(attributes or []))


def tsv2gtf(df: DataFrame, source: str = "locusframe") -> DataFrame:
    """Lines of a GTF file (value): transcript, exon and CDS rows."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    exons = F.arrays_zip(numbers("exonStarts").alias("b"), numbers("exonEnds").alias("e"))
    exons = F.zip_with(numbers("exonStarts"), numbers("exonEnds"), lambda b, e: F.struct(b.alias("b"), e.alias("e")))
    cs, ce = F.col("cdsStart").cast("long"), F.col("cdsEnd").cast("long")
    row = lambda kind, b, e: F.struct(F.lit(kind).alias("f"), b.alias("b"), e.alias("e"))
    coding = F.filter(F.transform(exons, lambda x: row("CDS", F.greatest(x["b"], cs), F.least(x["e"], ce))), lambda x: x["b"] < x["e"])
    rows = F.concat(F.array(row("transcript", F.col("begin").cast("long"), F.col("end").cast("long"))), F.transform(exons, lambda x: row("exon", x["b"], x["e"])), coding)
    gene = F.col("gene") if "gene" in df.columns else F.col("transcript")
    tags = F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), F.col("transcript"), F.lit('";'))
    return df.select("chromosome", "strand", tags.alias("tags"), F.inline(rows)).select(F.concat_ws("\t", "chromosome", F.lit(source), "f", (F.col("b") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), "strand", F.lit("."), "tags").alias("value"))


def fasta2tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence: records are read whole, however long their lines."""
    x = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(body, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*(\n|$)", ""), r"\s", "")
    return x.where(F.trim("value") != "").select(F.rtrim(name).alias("id"), seq.alias("sequence"))


def tsv2fasta(df: DataFrame, name: str = "id", sequence: str = "sequence", width: int = 0) -> DataFrame:
    seq = F.regexp_replace(model.col(sequence), f"(.{{{width}}})(?=.)", "$1\n") if width else model.col(sequence)
    return df.select(F.concat(F.lit(">"), model.col(name), F.lit("\n"), seq).alias("value"))


def fastq2tsv(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, quality. A record begins at a line with @ that a line with + follows two lines later;
    a quality line may begin with @ too, so records aren't cut at @ alone."""
    x = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("k"))
    # a piece at the begin of a split belongs to the last one of the split before in its file, wherever that is read:
    # a row for each split. Only the first piece of a file still has its @
    ends = x.groupBy("_file", "_start").agg(F.min("k").alias("_first"), F.max("k").alias("_last"))
    before = ends.select(F.col("_first").alias("k"), F.lag("_last").over(Window.partitionBy("_file").orderBy("_start")).alias("_before"), (F.col("_start") == 0).alias("_top"))
    at = x.join(F.broadcast(before), "k", "left")
    lines = F.split(F.when(F.col("_top"), F.regexp_replace("value", "^@", "")).otherwise(F.col("value")), "\n")
    # what looks like a begin inside a record: a quality line that begins with @ leaves a piece without +
    whole = (F.size(lines) >= 4) & F.get(lines, F.lit(2)).startswith("+") & (F.length(F.get(lines, F.lit(1))) == F.length(F.get(lines, F.lit(3))))
    cut = (F.size(lines) == 3) & F.get(lines, F.lit(2)).startswith("+")
    num = at.select(lines.alias("l"), whole.alias("whole"), cut.alias("cut"), "k", "_before")
    nxt = num.where("not whole and not cut").select(F.coalesce("_before", F.col("k") - 1).alias("k"), F.get("l", F.lit(0)).alias("q"))
    pieces = num.where("whole or cut").join(nxt, "k", "left")
    quality = F.when(F.col("whole"), F.get("l", F.lit(3))).otherwise(F.concat(F.lit("@"), F.coalesce("q", F.lit(""))))
    return pieces.select(F.get("l", F.lit(0)).alias("name"), F.get("l", F.lit(1)).alias("sequence"), quality.alias("quality"))


def tsv2fastq(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a chain file; a chain is a record, so chains are read side by side."""
    import pandas as pd

    def parse(parts):
        for t in parts:
            rows = [b for v in t["value"] for b in chain2tsv(("chain" + v.removeprefix("chain")).split("\n"))]
            yield pd.DataFrame(rows, columns=["chromosome", "begin", "end", "destchromosome", "destbegin", "destend", "strand"])

    return spark.read.option("lineSep", "\nchain").text(path).where(~F.col("value").startswith("#")).mapInPandas(parse, "chromosome string, begin long, end long, destchromosome string, destbegin long, destend long, strand string")


def chain2tsv(lines: list[str]) -> list[tuple]:
    """Blocks (chromosome, begin, end, destchromosome, destbegin, destend, strand) of the lines of chains."""
    out, head = [], None
    at = dest = 0
    for line in lines:
        p = line.split()
        if not p:
            continue
        if p[0] == "chain":
            head, at, dest = p, int(p[5]), int(p[10])
            continue
        n = int(p[0])
        if head[9] == "+":
            out.append((head[2], at, at + n, head[7], dest, dest + n, "+"))
        else:
            size = int(head[8])
            out.append((head[2], at, at + n, head[7], size - dest - n, size - dest, "-"))
        if len(p) > 2:
            at, dest = at + n + int(p[1]), dest + n + int(p[2])
    return out


def write_lines(rows: DataFrame, path: str, header: list[str] | None = None) -> None:
    """value as text; the header, if there is one, at the top of each part, as the readers here expect it."""

    def with_top(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    (rows.mapInArrow(with_top, "value string") if header else rows).write.mode("overwrite").text(path)
