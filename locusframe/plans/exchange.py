"""Formats by round trip, layouts for reading in part, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import sequences
from ..operators.intervals import covered_at_least, regions
from ..shared import shared_dir
from ..sources import bcol, formats, index, matrix, tsv
from .registry import query
from .tables import VARIANTS, A, B, regions_a, regions_b
from .tables import variants as variant_table


def _path(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/locusframe/{uuid.uuid4().hex}"


def _written(lines: DataFrame, header: list[str] | None = None, name: str = "") -> str:
    path = _path(lines) + name
    formats.write_lines(lines, path, header)
    return path


_CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


def _customers(t) -> DataFrame:
    return t("customer").select("c_custkey", "c_name", "c_mktsegment")


@query(_CUSTOMERS)
def scan_tsv(t):
    x = _customers(t)
    tsv.write_tsv(x, path := _path(x), ["#made\tby a query", "#fields\ttable"])
    return tsv.read_tsv(x.sparkSession, path, types={"c_custkey": "Integer"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_headeropts(t):
    x = _customers(t)
    tsv.write_tsv(x, path := _path(x), header=False)
    return tsv.read_tsv(x.sparkSession, path, header=["id", "name", "segment"])


@query(_CUSTOMERS)
def scan_compressed(t):
    x = _customers(t)
    tsv.write_tsv(x, path := _path(x), compression="bzip2")
    return tsv.read_tsv(x.sparkSession, path, types={"c_custkey": "Integer"})


@query("SELECT value, count(*) AS n FROM (SELECT c_custkey || chr(9) || c_name || chr(9) || c_mktsegment AS value FROM customer) GROUP BY value")
def sink_tsv(t):
    x = _customers(t)
    tsv.write_tsv(x, path := _path(x), ["#comment"], compression="gzip")
    return x.sparkSession.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "\t".join(x.columns))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS key, c_name AS label FROM customer")
def sink_newheader(t):
    from ..operators.select import select

    return select(t("customer"), "c_custkey c_name", new_header=["key", "label"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS quoted FROM customer")
def csv2tsv(t):
    x = t("customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("quoted"))
    tsv.write_csv(x, path := _path(x))
    return tsv.read_csv(x.sparkSession, path)


@query("SELECT value, count(*) AS n FROM (SELECT c_custkey || ',\"' || c_name || ', \"\"' || c_mktsegment || '\"\"\"' AS value FROM customer) GROUP BY value")
def tsv2csv(t):
    x = t("customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("quoted"))
    tsv.write_csv(x, path := _path(x))
    return x.sparkSession.read.text(path).where("value <> 'c_custkey,quoted'").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS fields, c_name AS value FROM customer WHERE c_custkey % 7 = 0")
def checktsv(t):
    x = t("customer").select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name")).alias("value"))
    return tsv.check_tsv(x.sparkSession, _written(x, ["key\tname"]))


@query("SELECT CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS key, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name FROM customer")
def fixtsv(t):
    x = t("customer").select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.lit("spare"), F.lit("more"))).alias("value"))
    return tsv.fix_tsv(x.sparkSession, _written(x, ["key\tname\tkey"]))


@query("SELECT c_custkey, c_name, '' AS note FROM customer")
def addcols(t):
    return tsv.add_columns(t("customer").select("c_custkey", "c_name"), ["c_name", "note"])


_ALLELES = f"SELECT DISTINCT chromosome, begin, \"end\", type, ref, alt FROM ({VARIANTS})"


def _alleles(t) -> DataFrame:
    return variant_table(t).select("chromosome", "begin", "end", "type", "ref", "alt").distinct()


_VCF = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, of all reads">', "##source=query", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


@query(_ALLELES)
def vcf2tsv(t):
    x = _alleles(t)
    return formats.vcf2tsv(x.sparkSession, _written(formats.tsv2vcf(x), _VCF)).select("chromosome", "begin", "end", "type", "ref", "alt")


@query(f"SELECT chromosome || chr(9) || (begin + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || string_agg(alt, ',' ORDER BY alt) || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' AS value FROM ({_ALLELES}) GROUP BY chromosome, begin, ref")
def tsv2vcf(t):
    return formats.tsv2vcf(_alleles(t))


@query("SELECT * FROM (VALUES ('fileformat', '', '', '', 'VCFv4.2'), ('INFO', 'DP', '1', 'Integer', 'Depth, of all reads'), ('source', '', '', '', 'query')) x(kind, id, number, type, description)")
def vcfheader2tsv(t):
    x = _alleles(t)
    return formats.vcf_header(x.sparkSession, _written(formats.tsv2vcf(x), _VCF))


_LINE = "chromosome || chr(9) || (begin + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || string_agg(alt, ',' ORDER BY alt) || chr(9) || '.' || chr(9) || '.' || chr(9) || '.'"


@query(f"SELECT value, count(*) AS n FROM (SELECT {_LINE} AS value FROM (SELECT DISTINCT chromosome, begin, ref, alt, sample FROM ({VARIANTS}) WHERE sample IN ('A', 'R')) GROUP BY chromosome, begin, ref, sample) GROUP BY value")
def vcfcat(t):
    v = variant_table(t)
    paths = [_written(formats.tsv2vcf(v.where(F.col("sample") == s).select("chromosome", "begin", "end", "ref", "alt")), _VCF) for s in "AR"]
    return formats.vcf_cat(v.sparkSession, paths).where("_row = 1").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT value, row_number() OVER (ORDER BY c, begin, value) + 3 AS r FROM (SELECT chromosome AS c, begin, {_LINE} AS value FROM ({_ALLELES}) GROUP BY chromosome, begin, ref)")
def sortvcf(t):
    from ..operators.select import number_partitions

    x = _alleles(t)
    out = number_partitions(formats.vcf_cat(x.sparkSession, [_written(formats.tsv2vcf(x), _VCF)], sort=True), "r")
    return out.where("_row = 1").select("value", "r")


_SAM = "SELECT 'r' || l_orderkey || '_' || l_linenumber AS qname, (l_linenumber % 2) * 16 AS flag, 'chr' || (l_suppkey % 22 + 1) AS c, l_partkey AS begin, l_partkey + 13 AS e FROM lineitem"


@query(f"SELECT qname, c AS chromosome, begin, e AS \"end\", CASE WHEN flag = 16 THEN '-' ELSE '+' END AS strand, CAST(2 AS BIGINT) AS qstart, CAST(16 AS BIGINT) AS qend, CAST(flag / 16 AS BIGINT) AS reverse FROM ({_SAM})")
def sam2tsv(t):
    f = ["'r' || l_orderkey || '_' || l_linenumber", "cast((l_linenumber % 2) * 16 as string)", "'chr' || (l_suppkey % 22 + 1)", "cast(l_partkey + 1 as string)", "'60'", "'2S10M3I2D1M'", "'*'", "'0'", "'0'", "'ACGTACGTACGTACGT'", "'FFFFFFFFFFFFFFFF'"]
    x = t("lineitem").select(F.expr("concat_ws('\\t', " + ", ".join(f) + ")").alias("value"))
    return formats.sam2tsv(x.sparkSession, _written(x, ["@HD\tVN:1.6"])).select("qname", "chromosome", "begin", "end", "strand", "qstart", "qend", "reverse")


@query(f"SELECT concat_ws(chr(9), qname, flag, c, begin + 1, 60, '5M', '*', 0, 0, 'ACGTA', 'FFFFF', 'NM:i:1') AS value FROM ({_SAM})")
def tsv2sam(t):
    x = t("lineitem").selectExpr("'r' || l_orderkey || '_' || l_linenumber as qname", "(l_linenumber % 2) * 16 as flag", "'chr' || (l_suppkey % 22 + 1) as chromosome", "l_partkey as begin", "60 as mapquality", "'5M' as cigar", "'*' as ref2", "-1L as begin2", "0L as tlen", "'ACGTA' as seq", "'FFFFF' as quality", "'NM:i:1' as other")
    return formats.tsv2sam(x)


@query(f'SELECT chromosome, begin, "end", brand AS name FROM ({B})')
def bed2tsv(t):
    x = regions_b(t)
    return formats.bed2tsv(x.sparkSession, _written(formats.tsv2bed(x.select("chromosome", "begin", "end", F.col("brand").alias("name"))), ["track name=x"])).select("chromosome", "begin", "end", "name")


@query(f"SELECT concat_ws(chr(9), chromosome, begin, \"end\", brand) AS value FROM ({B})")
def tsv2bed(t):
    return formats.tsv2bed(regions_b(t).select("brand", F.col("brand").alias("name"), "chromosome", "end", "begin"))


_GENES = """SELECT CAST(p_size % 22 + 1 AS VARCHAR) AS chromosome, p_partkey * 1000 AS begin, p_partkey * 1000 + 600 AS "end", 't' || p_partkey AS transcript, 'g' || (p_partkey // 2) AS gene, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey * 1000 + 50 AS "cdsStart", p_partkey * 1000 + 500 AS "cdsEnd",
(p_partkey * 1000) || ',' || (p_partkey * 1000 + 400) || ',' AS "exonStarts", (p_partkey * 1000 + 100 + p_size) || ',' || (p_partkey * 1000 + 600) || ',' AS "exonEnds" FROM part"""


def genes(t) -> DataFrame:
    """Two exons, 0 to 100 and some and 400 to 600, coding from 50 to 500, every thousand positions."""
    p = "p_partkey * 1000"
    return t("part").selectExpr("cast(p_size % 22 + 1 as string) as chromosome", f"{p} as begin", f"{p} + 600 as end", "'t' || p_partkey as transcript", "'g' || (p_partkey div 2) as gene", "case when p_size % 2 = 0 then '+' else '-' end as strand", f"{p} + 50 as cdsStart", f"{p} + 500 as cdsEnd", f"({p}) || ',' || ({p} + 400) || ',' as exonStarts", f"({p} + 100 + p_size) || ',' || ({p} + 600) || ',' as exonEnds")


@query(f'SELECT chromosome, begin, "end", transcript AS name, strand, "cdsStart", "cdsEnd", CAST(2 AS BIGINT) AS "exonCount", "exonStarts", "exonEnds" FROM ({_GENES})')
def bed2genetsv(t):
    g = genes(t)
    size = lambda i: (F.split("exonEnds", ",")[i].cast("long") - F.split("exonStarts", ",")[i].cast("long")).cast("string")
    x = g.select("chromosome", "begin", "end", F.col("transcript").alias("name"), F.lit("0").alias("score"), "strand", F.col("cdsStart").alias("thickStart"), F.col("cdsEnd").alias("thickEnd"), F.lit("0").alias("itemRgb"), F.lit(2).alias("blockCount"), F.concat(size(0), F.lit(","), size(1)).alias("blockSizes"), F.lit("0,400").alias("blockStarts"))
    return formats.bed2genes(formats.bed2tsv(x.sparkSession, _written(formats.tsv2bed(x))))


@query(f'SELECT chromosome, begin, "end", transcript, gene AS geneid, strand, "cdsStart", "cdsEnd", CAST(2 AS BIGINT) AS "exonCount", "exonStarts", "exonEnds" FROM ({_GENES})')
def gtf2tsv(t):
    g = genes(t)
    return formats.gtf2tsv(g.sparkSession, _written(formats.tsv2gtf(g))).select("chromosome", "begin", "end", "transcript", "geneid", "strand", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds")


@query(f"""WITH g AS ({_GENES}), x AS (SELECT *, CAST(string_split("exonEnds", ',')[1] AS BIGINT) AS e1, begin + 400 AS b2 FROM g), r AS (SELECT *, unnest([{{f: 'transcript', b: begin, e: "end"}}, {{f: 'exon', b: begin, e: e1}}, {{f: 'exon', b: b2, e: "end"}}, {{f: 'CDS', b: "cdsStart", e: e1}}, {{f: 'CDS', b: b2, e: "cdsEnd"}}]) AS u FROM x)
SELECT concat_ws(chr(9), chromosome, 'locusframe', u.f, u.b + 1, u.e, '.', strand, '.', 'gene_id "' || gene || '"; transcript_id "' || transcript || '";') AS value FROM r""")
def tsv2gtf(t):
    return formats.tsv2gtf(genes(t))


@query(f'SELECT chromosome, begin, "end", transcript, gene, strand, "cdsStart", "cdsEnd", CAST(2 AS BIGINT) AS "exonCount", "exonStarts", "exonEnds" FROM ({_GENES})')
def genepred2tsv(t):
    g = genes(t)
    x = g.select(F.concat_ws("\t", F.lit("585"), "transcript", "chromosome", "strand", *[F.col(c).cast("string") for c in ("begin", "end", "cdsStart", "cdsEnd")], F.lit("2"), "exonStarts", "exonEnds", F.lit("0"), "gene").alias("value"))
    return formats.genepred2tsv(x.sparkSession, _written(x))


_BASES = "translate(lpad(CAST(p_retailprice * 100 AS BIGINT)::VARCHAR || p_partkey, 20, '0'), '0123456789', 'ACGTACGTAC')"
#: A genome of 20 bases for each part.
GENOME = f"SELECT '1' AS chromosome, p_partkey * 20 AS start, {_BASES} AS seq FROM part"


def genome(t) -> DataFrame:
    return t("part").select(F.lit("1").alias("chromosome"), (F.col("p_partkey") * 20).alias("start"), F.translate(F.lpad(F.concat((F.col("p_retailprice") * 100).cast("long").cast("string"), F.col("p_partkey").cast("string")), 20, "0"), "0123456789", "ACGTACGTAC").alias("seq"))


@query(f"WITH g AS ({GENOME}), n AS (SELECT a.start, a.seq || b.seq AS s FROM g a JOIN g b ON b.start = a.start + 20) SELECT 't' || (start // 20) AS transcript, CASE WHEN start % 40 = 0 THEN substr(s, 3, 5) || substr(s, 16, 9) ELSE reverse(translate(substr(s, 3, 5) || substr(s, 16, 9), 'ACGT', 'TGCA')) END AS sequence FROM n")
def genepredtsv2fasta(t):
    g, s = genome(t), F.col("start")
    last = g.agg(F.max("start")).first()[0] or 0
    x = g.where(s < last).select("chromosome", F.concat(F.lit("t"), (s / 20).cast("long").cast("string")).alias("transcript"), F.when(s % 40 == 0, "+").otherwise("-").alias("strand"), F.concat_ws(",", (s + 2).cast("string"), (s + 15).cast("string")).alias("exonStarts"), F.concat_ws(",", (s + 7).cast("string"), (s + 24).cast("string")).alias("exonEnds"))
    return formats.genepred2fasta(x, g, 20)


@query(f"WITH g AS ({GENOME}), n AS (SELECT a.start, a.seq || coalesce(b.seq, '') AS s, b.seq IS NULL AS last FROM g a LEFT JOIN g b ON b.start = a.start + 20) SELECT start + 5 AS begin, start + 25 AS \"end\", substr(s, 6, 20) AS sequence FROM n")
def genome_seq(t):
    x = genome(t).select("chromosome", (F.col("start") + 5).alias("begin"), (F.col("start") + 25).alias("end"))
    return sequences.extract(x, genome(t), 20).select("begin", "end", "sequence")


@query(f"SELECT 'p' || (start // 20) AS id, seq AS sequence FROM ({GENOME})")
def fasta2tsv(t):
    x = genome(t).select(F.concat(F.lit("p"), (F.col("start") / 20).cast("long").cast("string")).alias("id"), F.col("seq").alias("sequence"))
    return formats.fasta2tsv(x.sparkSession, _written(formats.tsv2fasta(x, width=7)))


@query(f"SELECT 'p' || (start // 20) AS name, seq AS sequence, '@' || substr(translate(seq, 'ACGT', 'FI#5'), 2) AS quality FROM ({GENOME})")
def fastq2tsv(t):
    x = genome(t).select(F.concat(F.lit("p"), (F.col("start") / 20).cast("long").cast("string")).alias("name"), F.col("seq").alias("sequence"), F.concat(F.lit("@"), F.substring(F.translate("seq", "ACGT", "FI#5"), 2, 99)).alias("quality"))
    return formats.fastq2tsv(x.sparkSession, _written(formats.tsv2fastq(x)))


@query(f"SELECT 'p' || (start // 20) AS id, seq AS sequence FROM ({GENOME})")
def gb2fasta(t):
    s = F.lower("seq")
    body = F.concat(F.lit("LOCUS       p"), (F.col("start") / 20).cast("long").cast("string"), F.lit(" 20 bp DNA\nDEFINITION  x.\nORIGIN\n        1 "), F.substring(s, 1, 10), F.lit(" "), F.substring(s, 11, 10), F.lit("\n//"))
    x = genome(t).select(body.alias("value"))
    return formats.gb2fasta(x.sparkSession, _written(x))


_COUNTS = "SELECT 'g' || l_partkey AS gene, 'c' || l_suppkey AS cell, CAST(sum(l_linenumber) AS DOUBLE) AS count FROM lineitem GROUP BY ALL"


def counts(t) -> DataFrame:
    return t("lineitem").groupBy(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("cell")).agg(F.sum("l_linenumber").alias("count"))


@query(_COUNTS)
def mm2tsv(t):
    x = counts(t)
    matrix.write_10x(x, path := _path(x))
    return matrix.mm2tsv(x.sparkSession, path)


@query(f"WITH x AS ({_COUNTS}) SELECT r, c, CAST(count AS BIGINT) AS count FROM x JOIN (SELECT gene, row_number() OVER (ORDER BY gene) AS r FROM (SELECT DISTINCT gene FROM x)) USING (gene) JOIN (SELECT cell, row_number() OVER (ORDER BY cell) AS c FROM (SELECT DISTINCT cell FROM x)) USING (cell)")
def tsv2mm(t):
    return matrix.tsv2mm(counts(t))[0]


_CHAIN = "SELECT '1' AS chromosome, s_suppkey * 100 AS b, 'd' || (s_suppkey % 3) AS d, s_suppkey * 200 AS db, s_suppkey % 2 = 0 AS plus FROM supplier"


def chain_lines(t) -> DataFrame:
    """For each supplier two blocks of 30 and 20 with a gap of 5 and 10; every second one on the minus strand of 1e6."""
    s = F.col("s_suppkey")
    plus = s % 2 == 0
    start = F.when(plus, s * 200).otherwise(1_000_000 - s * 200 - 60)
    head = F.concat_ws(" ", F.lit("chain 1 1 1000000 +"), s * 100, s * 100 + 55, F.concat(F.lit("d"), s % 3), F.lit("1000000"), F.when(plus, "+").otherwise("-"), start, start + 60, s)
    return t("supplier").select(F.concat(head, F.lit("\n30 5 10\n20\n")).alias("value"))


_BLOCKS = f"""SELECT chromosome, b AS begin, b + 30 AS "end", d AS destchromosome, CASE WHEN plus THEN db ELSE db + 30 END AS destbegin, CASE WHEN plus THEN db + 30 ELSE db + 60 END AS destend, CASE WHEN plus THEN '+' ELSE '-' END AS strand FROM ({_CHAIN})
UNION ALL SELECT chromosome, b + 35, b + 55, d, CASE WHEN plus THEN db + 40 ELSE db END, CASE WHEN plus THEN db + 60 ELSE db + 20 END, CASE WHEN plus THEN '+' ELSE '-' END FROM ({_CHAIN})"""


@query(_BLOCKS)
def liftchain2tsv(t):
    x = chain_lines(t)
    return formats.read_chain(x.sparkSession, _written(x))


_VALUES = "SELECT '1' AS chromosome, event_id AS pos, floor(value / 20) AS value FROM events"


def _runs(t) -> DataFrame:
    return bcol.make(t("events").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), F.floor(F.col("value") / 20).alias("v")), "v")


@query(_VALUES)
def bcol_table(t):
    return bcol.table(_runs(t))


@query("SELECT count(*) AS size FROM events")
def bcol_size(t):
    return bcol.size(_runs(t))


@query(f"SELECT chromosome, min(pos) AS begin, max(pos) + 1 AS \"end\" FROM (SELECT *, pos - row_number() OVER (ORDER BY pos) AS run FROM ({_VALUES}) WHERE value BETWEEN 1 AND 3) GROUP BY chromosome, run")
def getregionsbcol(t):
    return bcol.regions_of(_runs(t), 1, 3)


_MULTI = f"SELECT chromosome, begin, alt, CAST(max(quality) AS DOUBLE) AS v FROM ({VARIANTS}) WHERE sample = 'R' GROUP BY ALL"


@query(f"WITH m AS ({_MULTI}) SELECT a.chromosome, a.begin, a.\"end\", a.alt, coalesce(m.v, -1.0)::VARCHAR AS value FROM (SELECT DISTINCT chromosome, begin, \"end\", alt FROM ({VARIANTS}) WHERE sample = 'A') a LEFT JOIN m USING (chromosome, begin, alt)")
def bcol_make_multi(t):
    v = variant_table(t)
    multi = bcol.make_multi(v.where("sample = 'R'").select("chromosome", F.col("begin").alias("pos"), "alt", "quality"), "quality")
    return bcol.at_multi(v.where("sample = 'A'").select("chromosome", "begin", "end", "alt").distinct(), multi, -1.0)


@query(f"SELECT id, begin, \"end\" FROM ({A}) WHERE chromosome = '5' AND begin < 9000 AND \"end\" > 2000")
def tabix(t):
    x = regions_a(t)
    index.write_index(x, path := _path(x))
    return index.read_range(x.sparkSession, path, "chr5", 2000, 9000).select("id", "begin", "end")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def scan_indexed(t):
    x = t("part")
    index.write_index(x, path := _path(x))
    return x.sparkSession.read.parquet(path).where("p_size > 25").select("p_partkey", "p_brand")


@query("SELECT 'p_brand' AS field, p_brand AS value, count(*) AS count FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size")
def index_colinfo(t):
    return index.column_info(t("part"), ["p_brand", "p_size"])


@query("SELECT DISTINCT unnest(string_split(p_brand || ',' || p_type, ',')) AS value FROM part")
def indexcol(t):
    return index.index_column(t("part").select(F.concat_ws(",", "p_brand", "p_type").alias("list")), ["list"])


@query("SELECT quality_s1, count(*) AS n FROM (SELECT l_quantity AS quality_s1 FROM lineitem) GROUP BY quality_s1")
def export_sql(t):
    x = index.export_view(t("lineitem").select(F.col("l_quantity").alias("quality-s1")), "locusframe_exported")
    return x.sparkSession.sql("SELECT quality_s1, count(*) AS n FROM locusframe_exported GROUP BY quality_s1")


# streams


def _streamed(df: DataFrame, run, mode: str) -> DataFrame:
    spark = df.sparkSession
    df.write.parquet(path := _path(df))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = run(stream)
    name = "s" + uuid.uuid4().hex
    if mode == "append":
        q = out.writeStream.outputMode(mode).option("checkpointLocation", _path(df)).format("parquet").option("path", done := _path(df)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(out.schema).parquet(done)
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_returnflag = 'A'")
def stream_select(t):
    x = t("lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return _streamed(x, lambda s: streaming.select_stream(s, "l_orderkey twice=$l_quantity*2", '$l_returnflag == "A"'), "append")


@query("SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY l_returnflag")
def stream_group(t):
    x = t("lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    return _streamed(x, lambda s: streaming.group_stream(s, ["l_returnflag"], "count,sum(l_linenumber),max(l_quantity)"), "complete")


__all__ = ["covered_at_least", "genes", "genome", "regions"]
