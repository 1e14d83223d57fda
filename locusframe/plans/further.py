"""More of projection, expressions, summaries, variants, genes and single cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import library
from ..functions.aligned import alignedseq
from ..functions.values import Value, number
from ..operators import analytics, cells, intervals, reshape, setops, transcripts, variants
from ..operators import group as g
from ..operators.joins import join_many
from ..operators.select import add_sampleinfo, number_partitions, ordered, project_samples, select, sort
from ..shared import shared_dir
from ..sources import bcol
from .exchange import _BLOCKS, _COUNTS, _GENES, GENOME, chain_lines, counts, genes, genome
from .genomic import SIZE, _segments
from .registry import query
from .relational import _LISTS, PAD, _lists
from .tables import VARIANTS, A, B, G, genotypes, regions_a, regions_b
from .tables import variants as variant_table


def _path(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/locusframe/{uuid.uuid4().hex}"


# projection


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_fieldorder(t):
    return select(t("customer"), "c_mktsegment c_name c_custkey", keep_order=True)


@query(f'SELECT id, line, ref, alt, "sequenced-s2", "alleleSeq1-s2", "alleleSeq2-s2", "quality-s2" FROM ({G})')
def project_sample(t):
    return project_samples(genotypes(t), "*2")


@query(f'SELECT id, line, "quality-s1" / 2 AS "half-s1", "quality-s2" / 2 AS "half-s2" FROM ({G})')
def calc_wildcard(t):
    return select(genotypes(t), "id line half-*=$quality-*/2")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS z, CASE WHEN l_linenumber > 3 THEN ln(l_linenumber - 3) END AS l FROM lineitem")
def calc_errors(t):
    return select(t("lineitem"), "l_orderkey l_linenumber z=$l_quantity/($l_linenumber-1) l=log($l_linenumber-3)")


@query("SELECT * FROM (VALUES ('field', 'id'), ('field', 'line'), ('field', 'ref'), ('field', 'alt'), ('sample', 's1'), ('sample', 's2'), ('analysis', 's1'), ('analysis', 's2')) x(kind, name)")
def header_names(t):
    x = genotypes(t)
    rows = [("field", c) for c in x.columns if "-" not in c] + [("sample", s) for s in model.samples(x.columns)] + [("analysis", s) for s in model.analyses(x.columns)]
    return x.sparkSession.createDataFrame(rows, "kind string, name string")


@query(f'SELECT chromosome, begin, "end", id FROM ({A})')
def makeregular(t):
    return model.make_regular(regions_a(t).select("id", F.col("end").alias("chromEnd"), F.col("begin").alias("chromStart"), F.col("chromosome").alias("chrom")))


# expressions


@query(f"SELECT p_partkey, CAST({PAD.format('lower(p_brand)')} < {PAD.format(chr(39) + 'brand#30' + chr(39))} AS BIGINT) AS lower, CAST({PAD.format('lower(p_brand)')} >= {PAD.format(chr(39) + 'brand#4' + chr(39))} AS BIGINT) AS upper FROM part")
def op_natural(t):
    return select(t("part"), 'p_partkey lower=($p_brand lt "Brand#30") upper=($p_brand ge "Brand#4")')


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity / (l_linenumber - 2) END, -1.0) AS c FROM lineitem")
def catch(t):
    return select(t("lineitem"), "l_orderkey l_linenumber c=catch($l_quantity/($l_linenumber-2),-1)")


_PAIR = f"SELECT id, string_split(v, ',') AS v, list_filter(string_split(q, ','), lambda e: e <> '-') AS q FROM ({_LISTS})"


@query(f"SELECT id, 2 * CAST(len(list_filter(v, lambda e: CAST(e AS DOUBLE) > 3)) > 0 AS BIGINT) AS one FROM ({_PAIR})")
def counthasone(t):
    return select(_lists(t), "id one=counthasone($v,$v,>3)")


@query(f"SELECT id, CAST(len(list_filter(v, lambda e: CAST(e AS DOUBLE) <= 3)) = 0 AS BIGINT) AS every FROM ({_PAIR})")
def counthasall(t):
    return select(_lists(t), "id every=counthasall($v,>3)")


@query(f"SELECT id, line, CAST((\"sequenced-s1\" <> 'u')::INT + (\"sequenced-s2\" <> 'u')::INT AS BIGINT) AS n, least(\"quality-s1\", \"quality-s2\") AS low, \"quality-s1\" + \"quality-s2\" AS total FROM ({G})")
def analysis_aggregates(t):
    return select(genotypes(t), 'id line n=acount($sequenced!="u") low=amin($quality) total=asum($quality)')


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 22 + 1 < 5 THEN -1 WHEN s_suppkey % 22 + 1 > 5 THEN 1 ELSE 0 END::BIGINT AS place FROM supplier")
def loc_compare(t):
    x = t("supplier").select("s_suppkey", F.concat(F.lit("chr"), (F.col("s_suppkey") % 22 + 1).cast("string")).alias("c"))
    return select(x, 's_suppkey place=loc_compare($c,"5")')


_EFFECTS = "SELECT l_orderkey, l_linenumber, 'g' || l_partkey || ';g' || l_suppkey AS genes, CASE WHEN l_linenumber % 2 = 0 THEN 'CDSMIS;intron' ELSE 'UTR3;CDSSTOP' END AS impacts, '+t' || l_partkey || ':exon1;-t' || l_suppkey || ':exon2' AS descr FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'CDSMIS' ELSE 'CDSSTOP' END AS worst, CASE WHEN l_linenumber % 2 = 0 THEN regexp_extract(descr, '^[+]([^:]*)', 1) ELSE regexp_extract(descr, ';-([^:]*)', 1) END AS hit, CAST('C' AS VARCHAR) AS coding FROM ({_EFFECTS})")
def bio_functions(t):
    x = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "'g' || l_partkey || ';g' || l_suppkey as genes", "case when l_linenumber % 2 = 0 then 'CDSMIS;intron' else 'UTR3;CDSSTOP' end as impacts", "'+t' || l_partkey || ':exon1;-t' || l_suppkey || ':exon2' as descr")
    return select(x, 'l_orderkey l_linenumber worst=maximpact($impacts) hit=transcripts($genes,$impacts,$descr,">=CDSMIS","t") coding=codingcat($impacts)')


@query(f"SELECT transcript, string_split(\"exonStarts\", ',')[1] || '-' || string_split(\"exonEnds\", ',')[1] || ',' || string_split(\"exonStarts\", ',')[2] || '-' || string_split(\"exonEnds\", ',')[2] AS exons FROM ({_GENES})")
def exonlist(t):
    return select(genes(t), "transcript exons=exonlist($exonStarts,$exonEnds)")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN substr('ACGTACGTAC', 3, 4) WHEN 1 THEN substr('ACGTACGTAC', 3, 2) || substr('ACGTACGTAC', 5, 1) ELSE '-' END AS bases FROM lineitem")
def alignedseq_column(t):
    x = t("lineitem")
    cigar = F.when(F.col("l_linenumber") % 3 == 0, "10M").when(F.col("l_linenumber") % 3 == 1, "4M1D6M").otherwise("2M4D8M")
    begin = F.lit(100).cast("long")
    return x.select("l_orderkey", "l_linenumber", alignedseq(begin, cigar, F.lit("ACGTACGTAC"), 102, 106).alias("bases"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 3 + l_linenumber AS scaled, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END AS infix FROM lineitem")
def udf_registration(t):
    library.register("triple_plus", lambda a: Value(number(a[0]) * 3 + number(a[1]), "num"))
    library.register("ifeven", lambda a: Value(F.when(number(a[1]) % 2 == 0, number(a[0])).otherwise(F.lit(0.0)), "num"))
    return select(t("lineitem"), "l_orderkey l_linenumber scaled=triple_plus($l_quantity,$l_linenumber) infix=($l_quantity ifeven $l_linenumber)")


# order


@query(f'SELECT id, begin, row_number() OVER (ORDER BY CAST(chromosome AS INT), begin, "end", id) - 1 AS r FROM ({A})')
def sort_default(t):
    x = regions_a(t).select("chromosome", "begin", "end", "id")
    return number_partitions(sort(x, "=chromosome begin end id"), "r").select("id", "begin", "r")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r FROM orders")
def sort_reverse(t):
    return number_partitions(sort(t("orders").select("o_orderkey", "o_totalprice"), "-o_totalprice o_orderkey"), "r").select("o_orderkey", "r")


@query(f"SELECT p_brand, string_agg(x, ',' ORDER BY {PAD.format('x')}) AS sizes FROM (SELECT DISTINCT p_brand, 's' || p_size AS x FROM part) GROUP BY p_brand")
def bsort(t):
    from ..natural import nat_sort

    x = t("part").groupBy("p_brand").agg(F.collect_set(F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("v"))
    return x.select("p_brand", F.array_join(nat_sort(F.col("v")), ",").alias("sizes"))


@query("SELECT qname, row_number() OVER (ORDER BY c, b, qname) - 1 AS r FROM (SELECT 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(l_quantity AS BIGINT) AS qname, l_suppkey % 22 + 1 AS c, l_partkey AS b FROM lineitem)")
def bam_sort(t):
    x = t("lineitem").selectExpr("'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || cast(l_quantity as bigint) as qname", "'chr' || (l_suppkey % 22 + 1) as chromosome", "l_partkey as begin").withColumn("_q", F.col("qname"))
    from ..natural import chr_clip

    return number_partitions(ordered(x, [(chr_clip("chromosome"), True, False), (F.col("begin"), False, False), (F.col("_q"), False, False)]), "r").select("qname", "r")


@query(f"SELECT name, row_number() OVER (ORDER BY {PAD.format('name')}) - 1 AS r FROM (SELECT 'p' || (start // 20) AS name FROM ({GENOME}))")
def sortfastq(t):
    x = genome(t).select(F.concat(F.lit("p"), (F.col("start") / 20).cast("long").cast("string")).alias("name"))
    return number_partitions(sort(x, "name"), "r")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders WHERE o_orderstatus IN ('F', 'O')")
def mergesorted(t):
    x = t("orders").select("o_orderkey", "o_orderstatus")
    return number_partitions(setops.merge_sorted([x.where("o_orderstatus = 'F'"), x.where("o_orderstatus = 'O'")], ["o_orderkey"]), "r").select("o_orderkey", "r")


@query("SELECT l_returnflag, count(*) AS count, row_number() OVER (ORDER BY count(*)) - 1 AS r FROM lineitem GROUP BY l_returnflag")
def group_sort(t):
    return number_partitions(g.group(t("lineitem"), "l_returnflag", "count", sort_by="count"), "r")


# summaries


@query(f'SELECT ref, round(avg(q), 4) AS avg_quality FROM (SELECT ref, "quality-s1" AS q FROM ({G}) UNION ALL SELECT ref, "quality-s2" FROM ({G})) GROUP BY ref')
def group_hidden_sample(t):
    return g.group(genotypes(t), "ref", "avg(quality)").withColumn("avg_quality", F.round("avg_quality", 4))


@query("SELECT CAST(l_quantity > 25 AS BIGINT) AS big, l_returnflag, count(*) AS count FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def group_calc(t):
    return g.group(t("lineitem"), "big=$l_quantity>25 * l_returnflag {A R}", "count")


@query("WITH c AS (SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, printf('%.2f', 100.0 * n / sum(n) OVER (PARTITION BY l_linestatus)) AS p, printf('%.2f', 100.0 * n / sum(n) OVER (PARTITION BY l_returnflag)) AS g FROM c) SELECT l_returnflag, max(p) FILTER (l_linestatus='F') AS \"percentsum_l_linenumber-F\", max(g) FILTER (l_linestatus='F') AS \"gpercentsum_l_linenumber-F\", max(p) FILTER (l_linestatus='O') AS \"percentsum_l_linenumber-O\", max(g) FILTER (l_linestatus='O') AS \"gpercentsum_l_linenumber-O\" FROM p GROUP BY l_returnflag")
def group_percentsum(t):
    return g.group(t("lineitem"), "l_returnflag", "l_linestatus * percentsum(l_linenumber),gpercentsum(l_linenumber)")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS list_event_type FROM events GROUP BY user_id")
def group_list(t):
    return g.group(t("events").select("event_id", "user_id", "event_type"), "user_id", "list(event_type)")


@query("SELECT 'all' AS \"all\", l_returnflag, count(*) AS count FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_returnflag")
def group_all_values(t):
    return g.group(t("lineitem"), "all * l_returnflag {A N}", "count")


@query("SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_id, count(*) AS n, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM events WHERE event_id < 100000000 GROUP BY event_type")
def groupby_unsorted(t):
    x = g.runs(t("events").select("event_id", "event_type", "value"), ["event_type"], ["event_id"], ["n"], ["value"], sorted_input=False)
    return x.select("event_type", "event_id", "n", F.round("value_min", 6).alias("value_min"), F.round("value_max", 6).alias("value_max"))


_BINS = f"""SELECT b.pid, s.na AS v, least(s."end", b."end") - greatest(s.begin, b.begin) AS n FROM (SELECT * FROM ({_segments(A)}) WHERE na > 0) s JOIN ({B}) b ON s.chromosome = b.chromosome AND s.begin < b."end" AND b.begin < s."end\""""
_CELLS = """CAST(coalesce(sum(n) FILTER (v < 2), 0) AS DOUBLE) AS "r<2", CAST(coalesce(sum(n) FILTER (v >= 2 AND v < 4), 0) AS DOUBLE) AS "r2<4", CAST(coalesce(sum(n) FILTER (v >= 4), 0) AS DOUBLE) AS "r4<", CAST(sum(n) AS DOUBLE) AS size, CAST(printf('%.2f', CAST(sum(v * n) AS DOUBLE) / sum(n)) AS DOUBLE) AS avg, min(v) AS min, max(v) AS max"""


@query(f'WITH p AS ({_BINS}), total AS (SELECT \'Total\' AS pid, {_CELLS} FROM p) SELECT CAST(pid AS VARCHAR) AS pid, {_CELLS} FROM p GROUP BY pid UNION ALL SELECT * FROM total UNION ALL SELECT \'Totalpercent\', CAST(printf(\'%.2f\', 100.0 * "r<2" / size) AS DOUBLE), CAST(printf(\'%.2f\', 100.0 * "r2<4" / size) AS DOUBLE), CAST(printf(\'%.2f\', 100.0 * "r4<" / size) AS DOUBLE), 100.0, NULL, NULL, NULL FROM total')
def bcol_histo(t):
    return analytics.value_histogram(intervals.depth(regions_a(t), SIZE), regions_b(t), "depth", [2, 4], "pid", SIZE)


# joins and sets


@query("SELECT CAST(l_partkey AS BIGINT) AS l_partkey, coalesce(max(n) FILTER (f = 'A'), '?') AS \"n-A\", coalesce(max(n) FILTER (f = 'R'), '?') AS \"n-R\" FROM (SELECT l_partkey, l_returnflag AS f, CAST(count(*) AS VARCHAR) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) GROUP BY l_partkey")
def multi_join(t):
    one = lambda s: t("lineitem").where(F.col("l_returnflag") == s).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return join_many({"A": one("A"), "R": one("R")}, ["l_partkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 40")
def multiselect(t):
    x = t("lineitem")
    return setops.multiselect({s: x.where(F.col("l_returnflag") == s) for s in "AR"}, lambda d: select(d, "l_orderkey l_linenumber", "$l_quantity > 40"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
def split(t):
    x = t("lineitem").select("l_returnflag", "l_quantity")
    setops.split_by(x, "l_returnflag", path := _path(x))
    return x.sparkSession.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(f"SELECT chromosome, count(*) AS n FROM ({A}) GROUP BY chromosome")
def distr2chr(t):
    x = regions_a(t)
    setops.split_by_chromosome(x.withColumn("chromosome", F.concat(F.lit("chr"), "chromosome")), path := _path(x))
    y = x.sparkSession.read.parquet(path)
    return y.groupBy(F.col("_chr").cast("string").alias("chromosome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT chromosome || ':' || (begin // 5000 * 5000) || '-' || (begin // 5000 * 5000 + 5000) AS region, count(*) AS n FROM ({A}) GROUP BY 1")
def distrreg(t):
    return setops.distribute(regions_a(t), column="region", size=5000).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, name FROM supplier LEFT JOIN (SELECT n_nationkey AS s_nationkey, n_name AS name FROM nation) USING (s_nationkey) WHERE s_acctbal > 1000")
def sampleinfo_filter(t):
    info = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return select(add_sampleinfo(t("supplier"), info, "s_nationkey"), "s_suppkey name", "$s_acctbal > 1000")


# variants


_SVA = "SELECT CAST(s_suppkey % 5 + 1 AS VARCHAR) AS chromosome, s_suppkey * 10000 AS begin, s_suppkey * 10000 + 1000 AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN 'del' ELSE 'dup' END AS type, s_suppkey AS id FROM supplier"


def _sv(t, shift: int) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select((k % 5 + 1).cast("string").alias("chromosome"), (k * 10000 + shift).alias("begin"), (k * 10000 + 1000 + shift).alias("end"), F.when(k % 2 == 0, "del").otherwise("dup").alias("type"), k.alias("id"))


@query(f'SELECT id, begin, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(2 * (20 + 10 * (id % 3)) AS BIGINT) END AS distance FROM ({_SVA})')
def annotate_sv(t):
    k = F.col("id")
    db = _sv(t, 0).select("chromosome", (F.col("begin") + 20 + 10 * (k % 3)).alias("begin"), (F.col("end") + 20 + 10 * (k % 3)).alias("end"), F.when(k % 3 == 0, "inv").otherwise(F.col("type")).alias("type"), k.alias("name"))
    return variants.annotate_sv(_sv(t, 0), db, ["name"]).select("id", "begin", "name", "distance")


@query(f"SELECT id AS a_id, id AS b_id, CAST(60 AS BIGINT) AS distance FROM ({_SVA})")
def sv_match(t):
    a, b = _sv(t, 0), _sv(t, 30)
    far = b.withColumns({"begin": F.col("begin") + 60, "end": F.col("end") + 60, "id": F.col("id") + 1_000_000})  # loses to the nearer one
    return variants.sv_pairs(a, b.union(far))


@query(f"""SELECT chromosome, CASE WHEN id % 4 = 0 THEN begin + 2000 ELSE begin END AS begin, CASE WHEN id % 4 = 0 THEN "end" + 2000 ELSE "end" END AS "end", type, CASE WHEN id % 4 = 0 THEN '?' ELSE 'x' || id END AS "name-a", 'y' || id AS "name-b" FROM ({_SVA}) UNION ALL SELECT chromosome, begin, "end", type, 'x' || id, '?' FROM ({_SVA}) WHERE id % 4 = 0""")
def svmulticompar(t):
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string")).alias("name")
    a = _sv(t, 0).select("chromosome", "begin", "end", "type", name("x"))
    far = F.when(F.col("id") % 4 == 0, 2000).otherwise(40)
    b = _sv(t, 0).select("chromosome", (F.col("begin") + far).alias("begin"), (F.col("end") + far).alias("end"), "type", name("y"))
    return variants.svmulticompar({"a": a, "b": b}, ["name"])


@query(f"WITH g AS ({_GENES}), e AS (SELECT *, CAST(string_split(\"exonEnds\", ',')[1] AS BIGINT) AS e1, begin + 400 AS b2, CASE WHEN strand = '+' THEN 1 ELSE 2 END AS first FROM g) SELECT chromosome, e.begin, e.\"end\", e.type, CAST(e.element AS BIGINT) AS element, name, strand FROM (SELECT chromosome, transcript AS name, strand, unnest([{{type: CASE WHEN strand = '+' THEN 'UTR5' ELSE 'UTR3' END, begin: begin, \"end\": \"cdsStart\", element: first}}, {{type: 'CDS', begin: \"cdsStart\", \"end\": e1, element: first}}, {{type: 'CDS', begin: b2, \"end\": \"cdsEnd\", element: 3 - first}}, {{type: CASE WHEN strand = '+' THEN 'UTR3' ELSE 'UTR5' END, begin: \"cdsEnd\", \"end\": \"end\", element: 3 - first}}, {{type: 'intron', begin: e1, \"end\": b2, element: 1}}]) AS e FROM e)")
def gene2reg(t):
    return variants.gene_elements(genes(t).withColumnRenamed("transcript", "name"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey * 1000 AS g, p_size, CASE p_partkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 20 WHEN 2 THEN 250 WHEN 3 THEN 399 ELSE 700 END AS d FROM part) SELECT id, g + d AS begin, CASE d WHEN 60 THEN 'CDS' WHEN 20 THEN CASE WHEN p_size % 2 = 0 THEN 'UTR5' ELSE 'UTR3' END WHEN 250 THEN 'intron' WHEN 399 THEN 'ESPLICE' ELSE '' END AS gene_impact, CASE WHEN d = 700 THEN '' ELSE 't' || id END AS gene_gene FROM p""")
def annotate_genes(t):
    k = F.col("p_partkey")
    d = F.element_at(F.array(*map(F.lit, (60, 20, 250, 399, 700))), (k % 5 + 1).cast("int"))
    a = t("part").select((F.col("p_size") % 22 + 1).cast("string").alias("chromosome"), (k * 1000 + d).alias("begin"), (k * 1000 + d + 1).alias("end"), k.alias("id"))
    return variants.annotate_genes(a, genes(t).withColumnRenamed("transcript", "name"), upstream=0).select("id", "begin", "gene_impact", "gene_gene")


_CODING = "(substr(seq, 51, 50 + p_size) || substr(seq, 401, 100))"
_LONG = "repeat(translate(lpad(CAST(p_retailprice * 100 AS BIGINT)::VARCHAR || p_partkey, 20, '0'), '0123456789', 'ACGTGCATCA'), 50)"
_INDEX = "(position({0}[1] IN 'TCAG') - 1) * 16 + (position({0}[2] IN 'TCAG') - 1) * 4 + position({0}[3] IN 'TCAG')"
_AMINOS = "'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'"


def long_genome(t) -> DataFrame:
    """A thousand bases for each part, where its gene lies."""
    seq = F.translate(F.lpad(F.concat((F.col("p_retailprice") * 100).cast("long").cast("string"), F.col("p_partkey").cast("string")), 20, "0"), "0123456789", "ACGTGCATCA")
    return t("part").select((F.col("p_size") % 22 + 1).cast("string").alias("chromosome"), (F.col("p_partkey") * 1000).alias("start"), F.repeat(seq, 50).alias("seq"))


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size, {_LONG} AS seq, p_size % 2 = 0 AS plus FROM part), c AS (SELECT id, plus, seq[62] AS ref, CASE seq[62] WHEN 'A' THEN 'C' ELSE 'A' END AS alt, CASE WHEN plus THEN {_CODING} ELSE reverse(translate({_CODING}, 'ACGT', 'TGCA')) END AS s, CASE WHEN plus THEN 11 ELSE 150 + p_size - 12 END AS o FROM p),
k AS (SELECT *, o // 3 AS n, s[3 * (o // 3) + 1:3 * (o // 3) + 3] AS old, CASE WHEN plus THEN alt ELSE translate(alt, 'ACGT', 'TGCA') END AS new FROM c), m AS (SELECT *, old[1:o % 3] || new || old[o % 3 + 2:] AS became FROM k),
x AS (SELECT id, s[o + 1] AS old_base, new, o, n, length(old) AS width, {_AMINOS}[{_INDEX.format('old')}] AS a, {_AMINOS}[{_INDEX.format('became')}] AS b FROM m)
SELECT id, CASE WHEN width < 3 OR a = b THEN 'CDSsilent' WHEN a = '*' THEN 'CDSSTOP' WHEN b = '*' THEN 'CDSNONSENSE' ELSE 'CDSMIS' END AS gene_impact, 'c.' || (o + 1) || old_base || '>' || new || ':p.' || CASE WHEN width < 3 THEN 'X' ELSE a END || (n + 1) || CASE WHEN width < 3 OR a = b THEN '=' ELSE b END AS change FROM x""")
def annotate_effects(t):
    from ..operators.effects import annotate_effects

    base = F.substring("seq", 62, 1)
    a = long_genome(t).select("chromosome", (F.col("start") + 61).alias("begin"), (F.col("start") + 62).alias("end"), (F.col("start") / 1000).cast("long").alias("id"), base.alias("ref"), F.when(base == "A", "C").otherwise("A").alias("alt"))
    out = annotate_effects(a, genes(t).withColumnRenamed("transcript", "name"), long_genome(t), upstream=0, chunk=1000)
    return out.select("id", "gene_impact", F.regexp_extract("gene_descr", "c[.].*$", 0).alias("change"))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'seed' WHEN 1 THEN 'mature' WHEN 2 THEN 'loop' WHEN 3 THEN 'arm' WHEN 4 THEN 'flank' ELSE CASE WHEN p_size % 2 = 0 THEN 'upstream' ELSE 'downstream' END END AS mir_impact, 'm' || p_partkey AS mir_mir FROM part")
def annotate_mir(t):
    from ..operators.effects import annotate_mir

    k, b = F.col("p_partkey"), F.col("p_partkey") * 10000
    plus = F.col("p_size") % 2 == 0
    mirs = t("part").select(F.lit("1").alias("chromosome"), b.alias("begin"), (b + 90).alias("end"), F.when(plus, "+").otherwise("-").alias("strand"), F.concat(F.lit("m"), k.cast("string")).alias("name"), (b + 10).alias("mature1start"), (b + 30).alias("mature1end"), (b + 35).alias("loopstart"), (b + 50).alias("loopend"), (b + 55).alias("mature2start"), (b + 75).alias("mature2end"))
    # within the seed on either strand: bases 2 to 7 from the begin or from the end of the mature sequence
    at = F.when(k % 6 == 0, F.when(plus, 13).otherwise(26)).when(k % 6 == 1, 20).when(k % 6 == 2, 40).when(k % 6 == 3, 85).when(k % 6 == 4, -50).otherwise(-500)
    a = t("part").select(F.lit("chr1").alias("chromosome"), (b + at).alias("begin"), (b + at + 1).alias("end"), k.alias("id"))
    return annotate_mir(a, mirs).select("id", "mir_impact", "mir_mir")


@query(f"""SELECT a.id, a.begin, arg_min(b.brand, struct_pack(x := b.begin, y := b."end", z := b.brand)) AS mark FROM (SELECT row_number() OVER () AS k, * FROM ({A})) a LEFT JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end" GROUP BY a.k, a.id, a.begin""")
def annotate_databases(t):
    from ..operators.annotate import annotate, describe

    db = describe("/data/reg_hg_brands.tsv", regions_b(t), ["name\tmark", "fields\tbrand"])
    return annotate(regions_a(t).select("id", "chromosome", "begin", "end"), [db], bin_size=SIZE).select("id", "begin", "mark")


_LIFT = "SELECT '1' AS chromosome, s_suppkey * 100 + s_suppkey * 7 % 60 AS begin, s_suppkey * 100 + s_suppkey * 7 % 60 + 4 AS \"end\", s_suppkey AS id FROM supplier"


def _lifted(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(F.lit("chr1").alias("chromosome"), (k * 100 + k * 7 % 60).alias("begin"), (k * 100 + k * 7 % 60 + 4).alias("end"), k.alias("id"), F.lit("AC").alias("ref"), F.when(k % 3 == 0, "AT,G").otherwise("T").alias("alt"))


@query(f"WITH b AS ({_BLOCKS}), a AS ({_LIFT}) SELECT id, destchromosome AS chromosome, CASE WHEN strand = '+' THEN destbegin + a.begin - b.begin ELSE destend - (a.\"end\" - b.begin) END AS begin, CASE WHEN strand = '+' THEN destbegin + a.\"end\" - b.begin ELSE destend - (a.begin - b.begin) END AS \"end\", a.begin AS beforebegin, CASE WHEN strand = '+' THEN 'AC' ELSE 'GT' END AS ref, CASE WHEN id % 3 = 0 THEN CASE WHEN strand = '+' THEN 'AT,G' ELSE 'AT,C' END ELSE CASE WHEN strand = '+' THEN 'T' ELSE 'A' END END AS alt FROM a JOIN b ON b.begin <= a.begin AND a.\"end\" <= b.\"end\"")
def liftover(t):
    from ..sources import formats

    chain = formats.read_chain(t("supplier").sparkSession, _chain(t))
    return variants.liftover(_lifted(t), chain)[0].select("id", "chromosome", "begin", "end", "beforebegin", "ref", "alt")


def _chain(t) -> str:
    from ..sources import formats

    x = chain_lines(t)
    formats.write_lines(x, path := _path(x))
    return path


@query(f"WITH b AS ({_BLOCKS}), a AS ({_LIFT}) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.begin <= a.begin AND a.\"end\" <= b.\"end\")")
def liftover_unmapped(t):
    from ..sources import formats

    return variants.liftover(_lifted(t), formats.read_chain(t("supplier").sparkSession, _chain(t)))[1].select("id")


@query(f"WITH b AS ({_BLOCKS}) SELECT destchromosome AS chromosome, destbegin AS begin, destend AS \"end\" FROM b")
def liftregion(t):
    from ..sources import formats

    k = F.col("s_suppkey")
    return variants.lift_regions(t("supplier").select(F.lit("1").alias("chromosome"), (k * 100).alias("begin"), (k * 100 + 80).alias("end")), formats.read_chain(t("supplier").sparkSession, _chain(t)))


@query(f"WITH g AS ({GENOME}) SELECT start + 3 AS begin, substr(seq, 4, 2) AS ref, CAST(substr(seq, 4, 2) = 'AC' AS BIGINT) AS refok FROM g")
def correctvariants(t):
    x = genome(t).select("chromosome", (F.col("start") + 3).alias("begin"), (F.col("start") + 5).alias("end"), F.lit("AC").alias("ref"))
    return variants.correct_variants(x, genome(t), 20).select("begin", "ref", "refok")


@query(f"""WITH c AS (SELECT id, line, unnest(string_split(alt, ',')) AS alt, "sequenced-s1" AS q1, "sequenced-s2" AS q2, "alleleSeq1-s1" AS a1, "alleleSeq2-s1" AS b1, "alleleSeq1-s2" AS a2, "alleleSeq2-s2" AS b2 FROM ({G}))
SELECT '1 1-' || id || '-' || (id + 1) || '-snp-' || alt || ' 0 ' || id || ' ' || CASE WHEN q1 = 'u' THEN '0 0' ELSE a1 || ' ' || b1 END || ' ' || CASE WHEN q2 = 'u' THEN '0 0' ELSE a2 || ' ' || b2 END AS line FROM c""")
def exportplink(t):
    x = genotypes(t).select(F.lit("chr1").alias("chromosome"), F.col("id").alias("begin"), (F.col("id") + 1).alias("end"), F.lit("snp").alias("type"), "ref", "alt", *[model.col(f"{f}-{s}") for s in ("s1", "s2") for f in ("sequenced", "alleleSeq1", "alleleSeq2")])
    return variants.exportplink(x)


@query(f"SELECT 'p' || (start // 20) AS chromosome, x.begin, x.\"end\", x.base, x.size FROM (SELECT start, unnest(list_filter(list_transform(range(1, len(r) + 1), lambda i: {{begin: CAST(coalesce(list_sum(list_transform(r[1:i-1], lambda v: length(v))), 0) AS BIGINT), \"end\": CAST(list_sum(list_transform(r[1:i], lambda v: length(v))) AS BIGINT), base: r[i][1:1], size: CAST(length(r[i]) AS BIGINT)}}), lambda e: e.size >= 3)) AS x FROM (SELECT start, regexp_extract_all(seq, 'A+|C+|G+|T+') AS r FROM ({GENOME})))")
def extracthomopolymers(t):
    x = genome(t).select(F.concat(F.lit("p"), (F.col("start") / 20).cast("long").cast("string")).alias("chromosome"), "seq")
    return analytics.homopolymers(x, least=3)


@query(f'SELECT count(*) AS n FROM (SELECT CAST(chromosome AS INT) AS c, begin, "end", id, lag(CAST(chromosome AS INT)) OVER w AS c0, lag(begin) OVER w AS b0, lag("end") OVER w AS e0 FROM ({A}) WINDOW w AS (ORDER BY id, begin, "end", CAST(chromosome AS INT))) WHERE c0 IS NOT NULL AND (c, begin, "end") < (c0, b0, e0)')
def checksort(t):
    x = regions_a(t).select("id", "begin", "end", "chromosome", F.col("chromosome").cast("int").alias("c"))
    return intervals.check_sort(x, ["id", "begin", "end", "c"]).agg(F.count(F.lit(1)).alias("n"))


@query()
def clusterregions(t):
    return variants.cluster_regions(regions_a(t), distance=20, least=5, stop=200)


# samples, genes and cells


@query("""WITH m AS (SELECT o_custkey AS sample, avg(o_totalprice) FILTER (o_orderkey % 4 = 0) AS x, avg(o_totalprice) FILTER (o_orderkey % 4 = 1) AS y, avg(o_totalprice) FILTER (o_orderkey % 4 > 1) AS a FROM orders GROUP BY o_custkey), r AS (SELECT sample, coalesce(x / a, 0) AS x, coalesce(y / a, 0) AS y FROM m) SELECT sample, CASE WHEN y > 0.2 AND x < 0.75 THEN 'm' WHEN y < 0.05 AND x > 0.75 THEN 'f' ELSE '?' END AS gender FROM r""")
def predictgender(t):
    k = F.col("o_orderkey") % 4
    return analytics.genders(t("orders").select(F.col("o_custkey").alias("sample"), F.when(k == 0, "chrX").when(k == 1, "chrY").otherwise("chr1").alias("chromosome"), F.col("o_totalprice").alias("depth")))


@query("SELECT s AS sample, max(v) FILTER (p = 'F') AS \"l_F\", max(v) FILTER (p = 'O') AS \"l_O\" FROM (SELECT l_returnflag AS s, l_linestatus AS p, CAST(count(*) AS VARCHAR) AS v FROM lineitem GROUP BY ALL) GROUP BY s")
def process_reports(t):
    x = t("lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("parameter")).agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("source", F.lit("l"))
    return analytics.combine_reports(x)


_TWO = f"""SELECT 'A' AS s, chromosome, begin, "end", strand, CASE WHEN begin // 1000 % 3 = 0 THEN 'novel' || begin ELSE gene END AS geneid, 1 AS n FROM ({_GENES}) UNION ALL SELECT 'B', chromosome, begin + 100, "end" + 100, strand, CASE WHEN begin // 1000 % 3 = 0 THEN 'novel_b' || begin ELSE gene END, 10 FROM ({_GENES}) WHERE begin // 1000 % 2 = 0"""


@query(f"""WITH x AS ({_TWO}), k AS (SELECT chromosome, strand, geneid, min(begin) AS begin, max("end") AS "end", CAST(coalesce(sum(n) FILTER (s = 'A'), 0) AS BIGINT) AS "n-A", CAST(coalesce(sum(n) FILTER (s = 'B'), 0) AS BIGINT) AS "n-B" FROM x WHERE geneid NOT LIKE 'novel%' GROUP BY ALL),
v AS (SELECT chromosome, strand, begin // 1000 AS part, min(begin) AS begin, max("end") AS "end", CAST(coalesce(sum(n) FILTER (s = 'A'), 0) AS BIGINT) AS "n-A", CAST(coalesce(sum(n) FILTER (s = 'B'), 0) AS BIGINT) AS "n-B" FROM x WHERE geneid LIKE 'novel%' GROUP BY ALL)
SELECT chromosome, begin, "end", strand, geneid, "n-A", "n-B" FROM k UNION ALL SELECT chromosome, begin, "end", strand, concat_ws('_', 'novelg', chromosome, strand, begin, "end"), "n-A", "n-B" FROM v""")
def multigene(t):
    x, k = genes(t), F.col("begin") / 1000
    odd = (k.cast("long") % 3) == 0
    a = x.select("chromosome", "begin", "end", "strand", F.when(odd, F.concat(F.lit("novel"), F.col("begin").cast("string"))).otherwise(F.col("gene")).alias("geneid"), F.lit(1).alias("n"))
    b = x.where(k.cast("long") % 2 == 0).select("chromosome", (F.col("begin") + 100).alias("begin"), (F.col("end") + 100).alias("end"), "strand", F.when(odd, F.concat(F.lit("novel_b"), F.col("begin").cast("string"))).otherwise(F.col("gene")).alias("geneid"), F.lit(10).alias("n"))
    return transcripts.multigene({"A": a, "B": b}, ["n"])


@query(f"""SELECT chromosome, begin - CASE WHEN begin // 1000 % 2 = 0 THEN 20 ELSE 0 END AS begin, "end", strand, CAST(2 AS BIGINT) AS "exonCount", CAST(1 AS BIGINT) AS "n-A", CASE WHEN begin // 1000 % 2 = 0 THEN 10 ELSE 0 END::BIGINT AS "n-B", (begin - CASE WHEN begin // 1000 % 2 = 0 THEN 20 ELSE 0 END) || ',' || (begin + 400) || ',' AS "exonStarts" FROM ({_GENES})""")
def multitranscript(t):
    x = genes(t).withColumn("transcript", F.concat(F.lit("novelt"), "transcript"))
    b = x.where((F.col("begin") / 1000).cast("long") % 2 == 0).withColumn("transcript", F.concat("transcript", F.lit("b"))).withColumn("exonStarts", F.concat((F.col("begin") - 20).cast("string"), F.lit(","), F.split("exonStarts", ",")[1], F.lit(","))).withColumn("begin", F.col("begin") - 20)
    out = transcripts.multitranscript({"A": x.withColumn("n", F.lit(1)), "B": b.withColumn("n", F.lit(10))}, ["n"])
    return out.select("chromosome", "begin", "end", "strand", "exonCount", "n-A", "n-B", "exonStarts")


@query(f"SELECT min(begin) AS begin, max(\"end\") AS \"end\", gene, chromosome, strand, 'd' || substr(gene, 2) AS disease FROM ({_GENES}) GROUP BY gene, chromosome, strand")
def geneannot2reg(t):
    x = genes(t)
    notes = x.select("gene").distinct().select("gene", F.concat(F.lit("d"), F.substring("gene", 2, 99)).alias("disease"))
    return transcripts.gene_annotations_to_regions(notes, x)


@query(f"SELECT sample, chromosome, min(begin) AS begin, max(\"end\") AS \"end\", count(*) AS calls FROM (SELECT *, sum(CASE WHEN z <> 'm' OR p IS DISTINCT FROM 'm' OR begin - e0 > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chromosome ORDER BY begin) AS run FROM (SELECT *, lag(z) OVER w AS p, lag(\"end\") OVER w AS e0 FROM (SELECT sample, chromosome, begin, \"end\", min(zyg) AS z FROM ({VARIANTS}) GROUP BY ALL) WINDOW w AS (PARTITION BY sample, chromosome ORDER BY begin))) WHERE z = 'm' GROUP BY sample, chromosome, run HAVING count(*) >= 2")
def homwes(t):
    v = variant_table(t).groupBy("sample", "chromosome", "begin", "end").agg(F.min("zyg").alias("zyg"))
    return analytics.homozygous_runs(v, least=2, gap=20)


_PILE = "SELECT '1' AS chromosome, l_partkey AS pos, 'A' AS ref, CASE l_linenumber % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'a' ELSE 'A' END AS base, l_linenumber AS count FROM lineitem"


def _pile(t) -> DataFrame:
    m = F.col("l_linenumber") % 4
    return t("lineitem").select(F.lit("1").alias("chromosome"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), F.when(m == 0, "C").when(m == 1, "a").otherwise("A").alias("base"), F.col("l_linenumber").alias("count"))


@query(f"WITH p AS (SELECT sum(count) AS n, coalesce(sum(count) FILTER (upper(base) <> ref), 0) AS e FROM ({_PILE}) GROUP BY pos HAVING sum(count) >= 20) SELECT CAST(least(e * 10 // n, 9) AS BIGINT) AS bin, count(*) AS positions FROM p GROUP BY 1")
def noise(t):
    return analytics.noise(_pile(t), 20, 10)


@query(f"SELECT CAST(sum(count) AS BIGINT) AS bases, CAST(sum(count) FILTER (upper(base) <> ref) AS BIGINT) AS errors, round(sum(count) FILTER (upper(base) <> ref) / sum(count), 9) AS rate FROM ({_PILE})")
def estimate_error_rate(t):
    return analytics.error_rate(_pile(t)).withColumn("rate", F.round("rate", 9))


@query("SELECT o_orderkey, printf('%04d', o_custkey % 10000)[-4:] AS barcode, CAST(0 AS BIGINT) AS mismatches, 'TT' AS umi FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, printf('%04d', o_custkey % 10000), CAST(1 AS BIGINT), 'TT' FROM orders WHERE o_custkey % 2 = 1")
def sc_barcodes(t):
    code = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    # one base of a doubled code is wrong in every second read, so no other code is as near
    spelled = lambda c: F.concat(c, F.translate(c, "0123456789", "9876543210"), c)
    wrong = F.when(F.col("o_custkey") % 2 == 1, F.concat(F.lit("N"), F.substring(spelled(code), 2, 99))).otherwise(spelled(code))
    reads = t("orders").select("o_orderkey", F.concat(wrong, F.lit("TT")).alias("seq"))
    known = t("orders").select(spelled(code).alias("barcode")).distinct()
    return cells.barcodes(reads, known, size=12, umi=2).select("o_orderkey", F.substring("barcode", 1, 4).alias("barcode"), "mismatches", "umi")


@query("SELECT n_name AS sample, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 10 GROUP BY n_name UNION ALL SELECT 'none', count(*) FROM supplier WHERE s_nationkey >= 10 HAVING count(*) > 0")
def sc_demultiplex(t):
    x = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("barcode"))
    cells.demultiplex(x, t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("barcode"), F.col("n_name").alias("sample")), path := _path(x))
    return x.sparkSession.read.parquet(path).groupBy(F.col("_sample").alias("sample")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS cell, sum(l_linenumber) AS total FROM lineitem GROUP BY l_orderkey), p AS (SELECT total, log10(sum(count(*)) OVER (ORDER BY total DESC)) AS x, log10(total) AS y FROM c GROUP BY total), e AS (SELECT arg_min(x, x) AS x0, max(y) AS y0, max(x) AS x1, min(y) AS y1 FROM p),
k AS (SELECT arg_max(total, struct_pack(a := (y - y0) * (x1 - x0) - (x - x0) * (y1 - y0), b := total)) AS cut FROM p, e) SELECT cell, CAST(total AS BIGINT) AS total FROM c, k WHERE total >= cut""")
def sc_filter(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("count"))
    return cells.filter_cells(x).groupBy("cell").agg(F.sum("count").alias("total"))


@query(f"SELECT cell, CAST(sum(count) AS BIGINT) AS total, count(*) AS genes FROM ({_COUNTS}) GROUP BY cell")
def sc_cell_report(t):
    return cells.cell_report(counts(t))


@query(f"WITH x AS (SELECT id, begin, (begin + \"end\") // 2 AS m, chromosome, row_number() OVER (PARTITION BY id ORDER BY begin, \"end\", chromosome, score) - 1 AS n FROM ({A})) SELECT a.id, a.chromosome AS chromosome1, CAST(a.m AS BIGINT) AS place1, b.chromosome AS chromosome2, CAST(b.m AS BIGINT) AS place2 FROM x a LEFT JOIN x b ON a.id = b.id AND b.n = 1 WHERE a.n = 0")
def map2besthit(t):
    return cells.first_hits(regions_a(t).withColumn("mate", F.lit(1)), ["id"], ["begin", "end", "chromosome", "score"], "mate")


@query(f"""WITH p AS (SELECT a.k, b.begin AS bb, b."end" AS be, least(a."end", b."end") - greatest(a.begin, b.begin) AS s FROM (SELECT row_number() OVER () AS k, * FROM ({A})) a JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end"), m AS (SELECT k, arg_min({{b: bb, e: be}}, struct_pack(x := -s, y := bb, z := be, u := CAST(bb AS VARCHAR), v := CAST(be AS VARCHAR))) AS q FROM p GROUP BY k)
SELECT id, greatest(begin, coalesce(q.b, begin)) AS begin, least("end", coalesce(q.e, "end")) AS "end" FROM (SELECT row_number() OVER () AS k, * FROM ({A})) LEFT JOIN m USING (k)""")
def sam_clipamplicons(t):
    return analytics.clip_to_amplicons(regions_a(t).select("id", "chromosome", "begin", "end"), regions_b(t), SIZE).select("id", "begin", "end")


@query(f"SELECT id, line, 's1' AS sample, \"quality-s1\" AS quality FROM ({G}) WHERE \"sequenced-s1\" = 'v' UNION ALL SELECT id, line, 's2', \"quality-s2\" FROM ({G}) WHERE \"sequenced-s2\" = 'v'")
def long_filtered(t):
    x = genotypes(t).select("id", "line", *[model.col(f"{f}-{s}") for f in ("sequenced", "quality") for s in ("s1", "s2")])
    return select(reshape.long(x, "sample"), "id line sample quality", '$sequenced == "v"')


__all__ = ["bcol"]
