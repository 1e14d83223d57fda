"""Interval algebra, annotation, variants and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, intervals, variants
from ..sources import bcol
from .registry import query
from .tables import VARIANTS, A, B, regions_a, regions_b
from .tables import variants as variant_table

#: Bins for regions of some tens of positions within some tens of thousands.
SIZE = 2048


def _segments(a: str, b: str | None = None) -> str:
    """Segments between all begins and ends, with the number of regions of each side."""
    sets = [("a", a)] + ([("b", b)] if b else [])
    events = " UNION ALL ".join(
        f'SELECT chromosome, begin AS pos, {1 if n == "a" else 0} AS da, {1 if n == "b" else 0} AS db FROM ({s}) WHERE begin < "end" UNION ALL SELECT chromosome, "end", {-1 if n == "a" else 0}, {-1 if n == "b" else 0} FROM ({s}) WHERE begin < "end"' for n, s in sets
    )
    return f"""SELECT * FROM (SELECT chromosome, pos AS begin, lead(pos) OVER w AS "end", CAST(sum(da) OVER w AS BIGINT) AS na, CAST(sum(db) OVER w AS BIGINT) AS nb FROM (SELECT chromosome, pos, sum(da) AS da, sum(db) AS db FROM ({events}) GROUP BY ALL) WINDOW w AS (PARTITION BY chromosome ORDER BY pos)) WHERE "end" IS NOT NULL"""


def _islands(source: str, values: str = "") -> str:
    v = f", {values}" if values else ""
    return f"""SELECT chromosome, min(begin) AS begin, max("end") AS "end"{v} FROM (SELECT *, sum(new) OVER (PARTITION BY chromosome{v} ORDER BY begin, "end" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN begin <= max("end") OVER (PARTITION BY chromosome{v} ORDER BY begin, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({source}))) GROUP BY chromosome, run{v}"""


@query(f'SELECT a.id AS a_id, a.begin AS a_begin, b.pid AS b_pid FROM ({A}) a JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end"')
def overlap_join(t):
    return intervals.overlap_join(intervals.regions(regions_a(t)), intervals.regions(regions_b(t)), bin_size=SIZE).select("a_id", "a_begin", "b_pid")


@query(f"""SELECT id, a.chromosome, a.begin, a."end", flag, score FROM ({A}) a WHERE EXISTS (SELECT 1 FROM ({B}) b WHERE a.chromosome = b.chromosome AND a.begin < b."end" AND (b.begin < a."end" OR a.begin = b.begin))""")
def regselect(t):
    return intervals.regselect(regions_a(t), regions_b(t), bin_size=SIZE)


@query(f"""SELECT a.id, a.chromosome, a.begin, a."end", count(b.pid) AS count, CAST(coalesce(sum(CASE WHEN b.pid IS NOT NULL THEN least(a."end", b."end") - greatest(a.begin, b.begin) END), 0) AS BIGINT) AS shared FROM (SELECT row_number() OVER () AS k, * FROM ({A})) a LEFT JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end" GROUP BY a.k, a.id, a.chromosome, a.begin, a."end\"""")
def overlap_counts(t):
    return intervals.overlap_counts(regions_a(t).select("id", "chromosome", "begin", "end"), regions_b(t), SIZE)


@query(f"""SELECT a.id, a.chromosome, a.begin, a."end", arg_min(b.brand, struct_pack(x := b.begin, y := b."end", z := b.brand)) AS brand FROM (SELECT row_number() OVER () AS k, * FROM ({A})) a LEFT JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end" GROUP BY a.k, a.id, a.chromosome, a.begin, a."end\"""")
def annotate_reg(t):
    return intervals.annotate_regions(regions_a(t).select("id", "chromosome", "begin", "end"), regions_b(t), ["brand"], SIZE)


_DIST = 'CASE WHEN b.begin >= a."end" THEN b.begin - a."end" WHEN a.begin >= b."end" THEN a.begin - b."end" ELSE greatest(least(a."end" - b."end", -1), least(b.begin - a.begin - 1, -1)) END'


@query(f"""WITH p AS (SELECT a.k, a.id, a.chromosome, a.begin, a."end", b.begin AS bb, b."end" AS be, b.pid, {_DIST} AS d FROM (SELECT row_number() OVER () AS k, * FROM ({B.replace('p_partkey as pid', 'p_partkey as id')})) a JOIN (SELECT *, id AS pid FROM ({A})) b ON a.chromosome = b.chromosome AND b.begin - 200 <= a."end" AND b."end" + 200 >= a.begin),
q AS (SELECT k, arg_min(d, struct_pack(x := abs(d), y := bb, z := be, w := CAST(pid AS VARCHAR))) AS dist FROM p WHERE d < 200 GROUP BY k) SELECT id, chromosome, begin, "end", dist FROM (SELECT row_number() OVER () AS k, * FROM ({B.replace('p_partkey as pid', 'p_partkey as id')})) LEFT JOIN q USING (k)""")
def annotate_near(t):
    a = regions_b(t).select(F.col("pid").alias("id"), "chromosome", "begin", "end")
    return intervals.nearest(a, regions_a(t).withColumnRenamed("id", "pid"), 200, ["pid"], SIZE).select("id", "chromosome", "begin", "end", "dist")


@query(_islands(A))
def regjoin(t):
    return intervals.regjoin(regions_a(t), size=SIZE)


@query(_islands(f"SELECT chromosome, begin, \"end\" FROM ({A}) UNION ALL SELECT chromosome, begin, \"end\" FROM ({B})"))
def regjoin_two(t):
    return intervals.regjoin(regions_a(t), regions_b(t), SIZE)


@query(_islands(A, "flag"))
def regjoin_fields(t):
    return intervals.regjoin_fields(regions_a(t), ["flag"], SIZE)


@query(f'SELECT chromosome, begin, "end" FROM ({_segments(B, A)}) WHERE na > 0 AND nb = 0')
def regsubtract(t):
    return intervals.regsubtract(regions_b(t), regions_a(t), SIZE)


@query(_islands(f'SELECT chromosome, begin, "end" FROM ({_segments(A, B)}) WHERE na > 0 AND nb > 0'))
def regcommon(t):
    return intervals.regcommon(regions_a(t), regions_b(t), SIZE)


@query(f'SELECT chromosome, begin, "end", CAST(na > 0 AS BIGINT) AS a, CAST(nb > 0 AS BIGINT) AS b FROM ({_segments(A, B)}) WHERE na > 0 OR nb > 0')
def multireg(t):
    return intervals.multireg({"a": regions_a(t), "b": regions_b(t)}, SIZE)


_MULTI = f'SELECT "end" - begin AS n, na > 0 AS a, nb > 0 AS b FROM ({_segments(A, B)})'


@query(f"""SELECT 'b' AS name, CAST(sum(n) FILTER (a AND b) AS BIGINT) AS common, round(sum(n) FILTER (a AND b) / sum(n) FILTER (a), 9) AS sensitivity, round(sum(n) FILTER (a AND b) / sum(n) FILTER (b), 9) AS specificity, CAST(sum(n) FILTER (b) - sum(n) FILTER (a AND b) AS BIGINT) AS fp, CAST(sum(n) FILTER (a) - sum(n) FILTER (a AND b) AS BIGINT) AS fn FROM ({_MULTI})""")
def homwes_compare(t):
    x = intervals.compare_coverage({"a": regions_a(t), "b": regions_b(t)}, SIZE)
    return x.withColumn("sensitivity", F.round("sensitivity", 9)).withColumn("specificity", F.round("specificity", 9))


@query(_islands(f"""SELECT s.chromosome, s.begin, s."end", string_agg(DISTINCT a.flag, ',' ORDER BY a.flag) AS flag, CAST(sum(a.score) AS BIGINT) AS score FROM (SELECT chromosome, begin, "end" FROM ({_segments(A)}) WHERE na > 0) s JOIN ({A}) a ON a.chromosome = s.chromosome AND a.begin < s."end" AND s.begin < a."end" GROUP BY s.chromosome, s.begin, s."end\"""", "flag, score"))
def regcollapse(t):
    return intervals.regcollapse(regions_a(t), ["flag"], numbers=["score"], size=SIZE)


@query(f'SELECT chromosome, CAST(sum("end" - begin) AS BIGINT) AS bases FROM ({A}) GROUP BY chromosome UNION ALL SELECT \'total\', CAST(sum("end" - begin) AS BIGINT) FROM ({A})')
def covered(t):
    return intervals.covered(regions_a(t))


@query(f'SELECT "end" - begin AS size, count(*) AS count FROM ({B}) GROUP BY 1')
def reghisto(t):
    return intervals.reghisto(regions_b(t))


@query(f"""SELECT chromosome, min(begin) AS begin, max("end") AS "end", depth FROM (SELECT *, sum(new) OVER (PARTITION BY chromosome ORDER BY begin ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT chromosome, begin, "end", na AS depth, CASE WHEN lag("end") OVER w = begin AND lag(na) OVER w = na THEN 0 ELSE 1 END AS new FROM ({_segments(A)}) WHERE na > 0 WINDOW w AS (PARTITION BY chromosome ORDER BY begin))) GROUP BY chromosome, run, depth""")
def depth(t):
    return intervals.depth(regions_a(t), SIZE)


@query(f"""SELECT least(na, 6) AS depth, CAST(sum(CASE WHEN nb > 0 THEN "end" - begin ELSE 0 END) AS BIGINT) AS ontarget, CAST(sum(CASE WHEN nb = 0 THEN "end" - begin ELSE 0 END) AS BIGINT) AS offtarget FROM ({_segments(A, B)}) WHERE na > 0 GROUP BY 1""")
def depth_histo(t):
    return intervals.depth_histogram(regions_a(t), regions_b(t), 6, SIZE)


@query(_islands(f'SELECT chromosome, begin, "end" FROM ({_segments(A)}) WHERE na >= 3'))
def bam2reg(t):
    return intervals.covered_at_least(regions_a(t), 3, SIZE)


@query(_islands("SELECT '1' AS chromosome, event_id AS begin, event_id + 1 AS \"end\" FROM events WHERE value BETWEEN 5 AND 60"))
def regextract(t):
    x = t("events").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), "value")
    return intervals.regions_where(x, "value", 5, 60, size=SIZE)


_DAYS = "SELECT '1' AS chromosome, event_id AS begin, event_id + 1 AS \"end\", floor(value / 20) AS value FROM events"


@query(_islands(_DAYS, "value"))
def bcol_make(t):
    x = t("events").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), F.floor(F.col("value") / 20).alias("v"))
    return bcol.make(x, "v")


@query(f"""SELECT pos, coalesce(value, -1) AS value FROM (SELECT unnest(range(0, 20000)) AS pos) LEFT JOIN (SELECT begin, value FROM ({_DAYS}) WHERE begin % 3 = 0) ON pos = begin""")
def bcol_get(t):
    x = t("events").where("event_id % 3 = 0").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), F.floor(F.col("value") / 20).alias("v"))
    return bcol.get(bcol.make(x, "v"), "1", 0, 20000, -1.0)


@query(f"""SELECT pos, coalesce(value, -1) AS value FROM (SELECT unnest(range(0, (SELECT coalesce(max(event_id) + 1, 0) FROM events))) AS pos) LEFT JOIN (SELECT begin, value FROM ({_DAYS}) WHERE value >= 1) ON pos = begin""")
def bcol_get_all(t):
    x = t("events").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), F.floor(F.col("value") / 20).alias("v"))
    end = t("events").agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).first()[0]
    return bcol.get(bcol.make(x.where("v >= 1"), "v"), "1", 0, end, -1.0)


@query(f"SELECT p_partkey AS id, '1' AS chromosome, p_partkey AS begin, p_partkey + 1 AS \"end\", coalesce(value, 0) AS value FROM part LEFT JOIN ({_DAYS}) ON p_partkey = begin")
def annotate_bcol(t):
    x = t("events").select(F.lit("chr1").alias("chromosome"), F.col("event_id").alias("pos"), F.floor(F.col("value") / 20).alias("v"))
    a = t("part").select(F.col("p_partkey").alias("id"), F.lit("chr1").alias("chromosome"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + 1).alias("end"))
    return bcol.at(a, bcol.make(x, "v"), 0.0, SIZE)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) AS vars FROM lineitem GROUP BY 1")
def count_by_name(t):
    return t("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("vars"))


# variants


@query(f"""SELECT chromosome, begin, "end", type, ref, string_agg(alt, ',' ORDER BY alt) AS alt, CASE WHEN count(DISTINCT z) = 1 THEN min(z) ELSE string_agg(z, ',' ORDER BY alt) END AS zyg FROM (SELECT chromosome, begin, "end", type, ref, alt, min(zyg) AS z FROM ({VARIANTS}) GROUP BY ALL) GROUP BY chromosome, begin, "end", type, ref""")
def collapsealleles(t):
    v = variant_table(t).drop("sample", "quality")
    return variants.collapse_alleles(v, duplicates="min").select("chromosome", "begin", "end", "type", "ref", "alt", "zyg")


_COLLAPSED = f"""SELECT chromosome, begin, "end", type, ref, list_sort(list(DISTINCT alt)) AS alts FROM ({VARIANTS}) GROUP BY chromosome, begin, "end", type, ref"""


@query(f"""SELECT chromosome, begin, "end", type, ref, unnest(alts) AS alt, unnest(list_transform(alts, lambda e: 'f' || e)) AS freq FROM ({_COLLAPSED})""")
def splitalleles(t):
    v = variant_table(t).groupBy("chromosome", "begin", "end", "type", "ref").agg(F.array_sort(F.collect_set("alt")).alias("a"))
    x = v.select("chromosome", "begin", "end", "type", "ref", F.array_join("a", ",").alias("alt"), F.array_join(F.transform("a", lambda e: F.concat(F.lit("f"), e)), ",").alias("freq"))
    return variants.split_alleles(x)


@query(f"""WITH v AS ({VARIANTS}), k AS (SELECT DISTINCT chromosome, begin, "end", type, ref, alt FROM v), n AS (SELECT DISTINCT chromosome, begin, sample FROM v)
SELECT k.*, """ + ", ".join(f"""coalesce({s}.zyg, CASE WHEN n{s}.sample IS NOT NULL THEN 'o' ELSE '?' END) AS "zyg-{s}", coalesce(CAST({s}.quality AS VARCHAR), '?') AS "quality-{s}\"""" for s in "AR") + " FROM k " + " ".join(f"LEFT JOIN (SELECT * FROM v WHERE sample = '{s}') {s} ON k.chromosome = {s}.chromosome AND k.begin = {s}.begin AND k.alt = {s}.alt LEFT JOIN (SELECT * FROM n WHERE sample = '{s}') n{s} ON n{s}.chromosome = k.chromosome AND n{s}.begin = k.begin" for s in "AR") + " WHERE A.alt IS NOT NULL OR R.alt IS NOT NULL")
def pmulticompar(t):
    v = variant_table(t)
    return variants.multicompar({s: v.where(F.col("sample") == s).drop("sample") for s in "AR"}, fields=["zyg", "quality"])


@query(f"""WITH v AS ({VARIANTS}), d AS (SELECT chromosome, begin, string_agg(alt, ',' ORDER BY alt) AS alt, list_sort(list(alt)) AS alts, string_agg('f' || alt, ',' ORDER BY alt) AS freq FROM (SELECT DISTINCT chromosome, begin, alt FROM v WHERE sample = 'R') GROUP BY ALL)
SELECT v.chromosome, v.begin, v."end", type, ref, v.alt, sample, quality, zyg, CASE WHEN list_contains(d.alts, v.alt) THEN 'f' || v.alt ELSE '' END AS freq FROM v LEFT JOIN d ON v.chromosome = d.chromosome AND v.begin = d.begin WHERE sample = 'A'""")
def annotate_var(t):
    v = variant_table(t)
    db = v.where("sample = 'R'").select("chromosome", "begin", "end", "type", "alt").distinct().groupBy("chromosome", "begin", "end", "type").agg(F.array_sort(F.collect_list("alt")).alias("a"))
    db = db.select("chromosome", "begin", "end", "type", F.array_join("a", ",").alias("alt"), F.array_join(F.transform("a", lambda e: F.concat(F.lit("f"), e)), ",").alias("freq"))
    return variants.annotate_variants(v.where("sample = 'A'"), db, ["freq"])


@query(f"""WITH v AS (SELECT *, 't' || CAST(begin // 50 AS VARCHAR) AS tr FROM ({VARIANTS}) WHERE quality >= 20), c AS (SELECT sample, tr, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 2) SELECT v.chromosome, v.begin, v.alt, v.sample, c.n AS count, v.tr AS compound FROM v JOIN c USING (sample, tr)""")
def compound(t):
    v = variant_table(t).select("chromosome", "begin", "alt", "sample", "quality", F.concat(F.lit("t"), F.floor(F.col("begin") / 50).cast("string")).alias("tr"))
    return analytics.compound(v, "tr", "$quality >= 20").select("chromosome", "begin", "alt", "sample", "count", "compound")


@query(f"""SELECT sample, count(*) AS vars, count(*) AS snps, CAST(0 AS BIGINT) AS indels, count(*) FILTER (zyg='m') AS homozygous, count(*) FILTER (zyg='t') AS heterozygous, count(*) FILTER (alt='G') AS ti, count(*) FILTER (alt<>'G') AS tv, round(count(*) FILTER (alt='G') / count(*) FILTER (alt<>'G'), 9) AS titv FROM ({VARIANTS}) GROUP BY sample""")
def report_vars(t):
    return analytics.report_variants(variant_table(t)).withColumn("titv", F.round("titv", 9))


@query(f"""WITH v AS ({VARIANTS}), c AS (SELECT chromosome, begin, alt, quality AS s FROM v WHERE sample = 'A'), t AS (SELECT DISTINCT chromosome, begin, alt, true AS t FROM v WHERE sample = 'N'), b AS (SELECT s, t FROM c FULL JOIN t USING (chromosome, begin, alt)), x AS (SELECT unnest([10.0, 30.0]) AS cutoff),
r AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) FILTER (s >= cutoff AND t) AS tp, count(*) FILTER (s >= cutoff AND t IS NULL) AS fp, count(*) FILTER ((s < cutoff OR s IS NULL) AND t) AS fn FROM b, x GROUP BY cutoff)
SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM r""")
def benchmarkvars(t):
    v = variant_table(t)
    x = analytics.benchmark(v.where("sample = 'A'"), v.where("sample = 'N'"), ["chromosome", "begin", "alt"], "quality", [10.0, 30.0])
    return x.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""SELECT l_partkey AS gene, coalesce(sum(l_linenumber) FILTER (c_mktsegment = 'BUILDING'), 0)::BIGINT AS "count-BUILDING", coalesce(sum(l_linenumber) FILTER (c_mktsegment = 'MACHINERY'), 0)::BIGINT AS "count-MACHINERY" FROM lineitem JOIN (SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def sc_pseudobulk(t):
    cells = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell"), F.col("c_mktsegment").alias("group"))
    counts = t("lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("count"))
    return analytics.pseudobulk(counts, cells, ["BUILDING", "MACHINERY"])


@query("""WITH s AS (SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey), p AS (SELECT total, count(*) AS cells FROM s GROUP BY total) SELECT total, cells, CAST(sum(cells) OVER (ORDER BY total DESC) AS BIGINT) AS rank FROM p""")
def knee(t):
    return analytics.knee(t("lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT l_partkey AS start, CAST(sum(l_linenumber) AS BIGINT) AS called, CAST(sum(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END) AS BIGINT) AS methylated, printf('%.3f', sum(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END) / sum(l_linenumber)) AS frequency FROM lineitem WHERE abs(l_quantity - 25) >= 2.5 GROUP BY l_partkey""")
def meth_freqs(t):
    x = t("lineitem").select(F.lit("1").alias("chromosome"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), (F.col("l_quantity") - 25).alias("log_lik_ratio"), F.col("l_linenumber").alias("num_motifs"))
    return analytics.methylation(x).select("start", "called", "methylated", "frequency")


@query(f"""WITH p AS (SELECT a.k, b.pid, least(a."end", b."end") - greatest(a.begin, b.begin) AS s, b.begin FROM (SELECT row_number() OVER () AS k, * FROM ({A})) a JOIN ({B}) b ON a.chromosome = b.chromosome AND a.begin < b."end" AND b.begin < a."end"), m AS (SELECT k, arg_max(pid, struct_pack(x := s, y := -begin, z := pid)) AS pid FROM p GROUP BY k)
SELECT pid, chromosome, begin, "end", coalesce(n, 0) AS count FROM ({B}) LEFT JOIN (SELECT pid, count(*) AS n FROM m GROUP BY pid) USING (pid)""")
def ampliconscount(t):
    return analytics.amplicon_counts(regions_a(t), regions_b(t).drop("brand"), "pid", SIZE)


@query(f"""WITH s AS (SELECT chromosome, begin, "end", na FROM ({_segments(A)}) WHERE na > 0), p AS (SELECT b.pid, b."end" - b.begin AS size, CASE WHEN s.begin IS NOT NULL THEN least(s."end", b."end") - greatest(s.begin, b.begin) END AS n, na FROM ({B}) b LEFT JOIN s ON s.chromosome = b.chromosome AND s.begin < b."end" AND b.begin < s."end") SELECT pid, size, round(coalesce(sum(n * na), 0) / size, 9) AS mean, CAST(coalesce(sum(n) FILTER (na >= 2), 0) AS BIGINT) AS ge2, CAST(coalesce(sum(n) FILTER (na >= 5), 0) AS BIGINT) AS ge5 FROM p GROUP BY pid, size""")
def coverage_report(t):
    x = analytics.coverage_report(intervals.depth(regions_a(t), SIZE), regions_b(t), [2, 5], "pid", SIZE)
    return x.withColumn("mean", F.round("mean", 9))
