"""Projection, filters, expressions, summaries, joins, sets, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..natural import nat_key
from ..operators import group as g
from ..operators import joins, reshape, setops
from ..operators.select import add_sampleinfo, filter_by_table, project, rename_samples, select, systematic_sample, with_row
from .registry import query
from .tables import A, G, genotypes, regions_a

PAD = "regexp_replace(regexp_replace({0}, '([0-9]+)', '00000000000000000000\\1', 'g'), '0*([0-9]{{20}})', '\\1', 'g')"


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus='F') AS "count-F", round(avg(l_extendedprice) FILTER (l_linestatus='F'), 4) AS "avg_l_extendedprice-F",
count(*) FILTER (l_linestatus='O') AS "count-O", round(avg(l_extendedprice) FILTER (l_linestatus='O'), 4) AS "avg_l_extendedprice-O"
FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.08 GROUP BY l_returnflag""")
def group_pivot(t):
    out = g.group(t("lineitem"), "l_returnflag", "l_linestatus {F O} count,avg(l_extendedprice)", "$l_quantity >= 30 && $l_discount < 0.08")
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 4) for c in out.columns if c.startswith("avg")})


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_quantity * 2 > 60 AND (l_returnflag = 'A' OR l_returnflag = 'R')")
def select_calc(t):
    return select(t("lineitem"), 'l_orderkey l_linenumber twice=$l_quantity*2 -raw=$l_extendedprice*(1-$l_discount) net=round($raw*1000000)/1000000', '$twice > 60 and $l_returnflag in "A R"').withColumn("net", F.round("net", 6))


@query("SELECT l_returnflag, l_quantity, l_linenumber, l_tax FROM lineitem WHERE l_tax > 0.05")
def project_wildcard(t):
    return select(t("lineitem"), "l_ret* l_quantity l_li* l_tax", "$l_tax > 0.05", remove="l_lines*")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def project_remove(t):
    return select(t("customer"), remove="c_n* c_acc*")


@query(f'SELECT id, line, "sequenced-s1" AS "sequenced-x", "quality-s1" AS "quality-x" FROM (SELECT id, line, "sequenced-s1", "quality-s1" FROM ({G}))')
def rename_sample(t):
    return rename_samples(project(genotypes(t), "id line sequenced-s1 quality-s1"), {"s1": "x"})


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[12]') OR lower(o_orderpriority) LIKE '%low'")
def filter_regex_glob(t):
    return select(t("orders"), "o_orderkey o_orderpriority", '$o_orderpriority ~ /^[12]/ || $o_orderpriority ncmatches "*LOW"')


@query(f"""SELECT id, begin, "end" FROM ({A}) WHERE (chromosome = '3' AND 500 < "end" AND 4000 > begin) OR chromosome = '7'""")
def filter_region(t):
    return select(regions_a(t), "id begin end", 'region("chr3:500-4000","7")')


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O')")
def filter_queryfile(t):
    x = t("lineitem")
    wanted = x.sparkSession.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return filter_by_table(x, wanted).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, CAST(((l_linenumber - 4) % 3 + 3) % 3 AS BIGINT) AS m, l_quantity / 7 AS d, l_linenumber ** 2.0 AS p, (l_orderkey & 6) | 1 AS b, l_linenumber << 3 AS s,
CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS c, l_quantity BETWEEN 10 AND 20 AS w FROM lineitem""".replace("l_quantity BETWEEN 10 AND 20 AS w", "CAST(l_quantity BETWEEN 10 AND 20 AS BIGINT) AS w"))
def expr_arithmetic(t):
    return select(t("lineitem"), 'l_orderkey l_linenumber m=($l_linenumber-4)%3 d=$l_quantity/7 p=$l_linenumber**2.0 b=($l_orderkey&6)|1 s=$l_linenumber<<3 c=$l_quantity>25?"hi":"lo" w=between($l_quantity,10,20)')


@query("""SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS n, regexp_replace(c_name, '#', '-') AS sub, regexp_extract(c_name, '#0*([0-9]*)$', 1) AS ext, concat(c_mktsegment, ':', c_nationkey) AS cc,
printf('%.2f', c_acctbal) AS f, CAST(c_mktsegment LIKE 'B%' AS BIGINT) AS g FROM customer""")
def expr_string(t):
    return select(t("customer"), 'c_custkey u=toupper($c_mktsegment) n=length($c_name) sub=regsub($c_name,"#","-") ext=regextract($c_name,"#0*([0-9]*)$") cc=concat($c_mktsegment,":",$c_nationkey) f=format("%.2f",$c_acctbal) g=matches($c_mktsegment,"B*")')


_LISTS = """SELECT l_orderkey AS id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS v, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey"""


def _lists(t):
    e = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").cast("long").cast("string").alias("q"))))
    x = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(e.alias("e"))
    v = F.array_join(F.transform("e", lambda s: s["l_linenumber"].cast("string")), ",")
    q = F.array_join(F.transform("e", lambda s: F.when(s["l_linenumber"] % 3 == 0, "-").otherwise(s["q"])), ",")
    return x.select("id", v.alias("v"), q.alias("q"))


@query(f"""WITH x AS (SELECT id, v, string_split(v, ',') AS l, list_filter(string_split(q, ','), lambda e: e <> '-') AS n, q FROM ({_LISTS})), y AS (SELECT id, l, q, list_transform(n, lambda e: CAST(e AS DOUBLE)) AS n FROM x)
SELECT id, list_min(n) AS mn, list_max(n) AS mx, CASE WHEN len(n) > 0 THEN list_sum(n) END AS sm, CASE WHEN len(n) > 0 THEN round(list_avg(n), 6) END AS av, CAST(len(l) AS BIGINT) AS ln, list_median(n) AS md,
l[2] AS second, CAST(list_contains(l, '3') AS BIGINT) AS has3, CAST(len(list_filter(n, lambda e: e > 20)) > 0 AS BIGINT) AS big, array_to_string(list_transform(string_split(q, ','), lambda e: CASE WHEN e = '-' THEN '0' ELSE e END), ',') AS def FROM y""".replace("list_median(n)", "list_aggregate(n, 'median')"))
def expr_vector(t):
    return select(_lists(t), "id mn=lmin($q) mx=lmax($q) sm=lsum($q) av=round(lavg($q)*1000000)/1000000 ln=llen($v) md=lmedian($q) second=lindex($v,1) has3=contains($v,3) big=hasone($q,>,20) def=vdef($q,0)").withColumn("av", F.round("av", 6))


@query(f"""WITH x AS (SELECT id, string_split(v, ',') AS l FROM ({_LISTS})) SELECT id, array_to_string(list_transform(l, lambda e: CAST(CAST(e AS BIGINT) + 10 AS VARCHAR)), ',') AS plus, array_to_string(list_transform(l, lambda e: CAST(CAST(e AS BIGINT) * CAST(e AS BIGINT) AS VARCHAR)), ',') AS sq,
array_to_string(list_transform(l, lambda e: CASE WHEN CAST(e AS BIGINT) > 2 THEN '1' ELSE '0' END), ',') AS gt, array_to_string(list_transform(l, lambda e: CASE WHEN CAST(e AS BIGINT) > 2 THEN 'a' ELSE 'b' END), ',') AS vf, array_to_string(list_transform(l, lambda e: 'n' || e), ',') AS vc FROM x""")
def expr_vector_operators(t):
    return select(_lists(t), 'id plus=$v@+10 sq=$v@*$v gt=$v@>2 vf=vif($v@>2,"a","b") vc=vconcat("n",$v)')


@query(f"""SELECT id, line, CAST(("sequenced-s1" = 'v') AS BIGINT) + CAST(("sequenced-s2" = 'v') AS BIGINT) AS n, CASE WHEN "sequenced-s1" = 'v' AND "sequenced-s2" = 'v' THEN 's1,s2' WHEN "sequenced-s1" = 'v' THEN 's1' WHEN "sequenced-s2" = 'v' THEN 's2' ELSE '' END AS who,
greatest("quality-s1", "quality-s2") AS mx, round(("quality-s1" + "quality-s2") / 2, 6) AS av, CASE WHEN "sequenced-s1" <> 'u' OR "sequenced-s2" <> 'u' THEN round(100.0 * (CAST("sequenced-s1" = 'v' AS INT) + CAST("sequenced-s2" = 'v' AS INT)) / (CAST("sequenced-s1" <> 'u' AS INT) + CAST("sequenced-s2" <> 'u' AS INT)), 6) END AS pc FROM ({G})""")
def sample_aggregates(t):
    x = select(genotypes(t), 'id line n=scount($sequenced=="v") who=slist($sequenced=="v",$sample) mx=smax($quality) av=savg($quality) pc=spercent($sequenced!="u",$sequenced=="v")')
    return x.withColumn("av", F.round("av", 6)).withColumn("pc", F.round("pc", 6))


@query(f"""SELECT id, line, CAST(("sequenced-s1" = 'v') AS BIGINT) + CAST(("sequenced-s2" = 'v') AS BIGINT) AS n, CAST("quality-s1" > 0.05 AS BIGINT) + CAST("quality-s2" > 0.05 AS BIGINT) AS q FROM ({G})""")
def expr_count(t):
    return select(genotypes(t), 'id line n=count($sequenced-*,=="v") q=count($quality-s1,$quality-s2,>0.05)')


_ZYG = """CASE WHEN "sequenced-s1" IN ('r','u') THEN "sequenced-s1" WHEN list_contains(string_split(alt, ','), "alleleSeq1-s1") THEN CASE WHEN "alleleSeq1-s1" = "alleleSeq2-s1" THEN 'm' WHEN "alleleSeq2-s1" = ref THEN 't' ELSE 'c' END
WHEN list_contains(string_split(alt, ','), "alleleSeq2-s1") THEN CASE WHEN "alleleSeq1-s1" = ref THEN 't' ELSE 'c' END WHEN "alleleSeq1-s1" = ref AND "alleleSeq2-s1" = ref THEN 'r' ELSE 'o' END"""


@query(f"""SELECT id, line, {_ZYG} AS z, CASE WHEN "sequenced-s1" = 'u' OR "sequenced-s2" = 'u' THEN 'un' WHEN "sequenced-s1" = 'r' AND "sequenced-s2" = 'r' THEN 'r' WHEN "sequenced-s1" <> "sequenced-s2" THEN 'df'
WHEN ("alleleSeq1-s1" = "alleleSeq1-s2" AND "alleleSeq2-s1" = "alleleSeq2-s2") OR ("alleleSeq1-s1" = "alleleSeq2-s2" AND "alleleSeq2-s1" = "alleleSeq1-s2") THEN 'sm' ELSE 'mm' END AS c, CAST("sequenced-s1" = 'v' AND "alleleSeq1-s1" = "alleleSeq2-s1" AS BIGINT) AS h FROM ({G})""")
def genotype_functions(t):
    return select(genotypes(t), 'id line z=zyg("s1") c=compare("s1","s2") h=hovar("s1")')


@query("""SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS sum_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, round(avg(l_quantity), 6) AS avg_l_quantity, round(stddev_pop(l_quantity), 6) AS stdev_l_quantity,
median(l_quantity) AS median_l_quantity, count(DISTINCT l_suppkey) AS ucount_l_suppkey, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS distinct_l_linestatus FROM lineitem GROUP BY l_returnflag""")
def group_aggregates(t):
    x = g.group(t("lineitem"), "l_returnflag", "count,sum(l_quantity),min(l_extendedprice),max(l_extendedprice),avg(l_quantity),stdev(l_quantity),median(l_quantity),ucount(l_suppkey),distinct(l_linestatus)")
    return x.withColumn("avg_l_quantity", F.round("avg_l_quantity", 6)).withColumn("stdev_l_quantity", F.round("stdev_l_quantity", 6))


_Q = """SELECT l_linestatus, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY l_linestatus"""


@query(f"""WITH x AS ({_Q}), y AS (SELECT *, n // 2 AS h FROM x) SELECT l_linestatus, round((v[(h - 1) // 2 + 1] + v[h // 2 + 1]) / 2, 6) AS q1_l_extendedprice, round((v[n - h + (h - 1) // 2 + 1] + v[n - h + h // 2 + 1]) / 2, 6) AS q3_l_extendedprice FROM y""")
def group_quartiles(t):
    x = g.group(t("lineitem"), "l_linestatus", "q1(l_extendedprice),q3(l_extendedprice)")
    return x.withColumns({c: F.round(c, 6) for c in x.columns if c.startswith("q")})


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, printf('%.2f', 100.0 * n / sum(n) OVER (PARTITION BY l_linestatus)) AS p, printf('%.2f', 100.0 * n / sum(n) OVER (PARTITION BY l_returnflag)) AS g FROM c)
SELECT l_returnflag, max(p) FILTER (l_linestatus='F') AS "percent-F", max(g) FILTER (l_linestatus='F') AS "gpercent-F", max(p) FILTER (l_linestatus='O') AS "percent-O", max(g) FILTER (l_linestatus='O') AS "gpercent-O" FROM p GROUP BY l_returnflag""")
def group_percent(t):
    return g.group(t("lineitem"), "l_returnflag", "l_linestatus * percent,gpercent")


@query(f"""SELECT e AS v, count(*) AS count FROM (SELECT unnest(string_split(v, ',')) AS e FROM ({_LISTS})) GROUP BY e""")
def group_explode(t):
    return g.group(_lists(t), "+v")


@query("SELECT 'all' AS \"all\", count(*) AS count, sum(l_quantity) AS sum_l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def group_all(t):
    return g.group(t("lineitem"), "all * l_returnflag {A N}", "count,sum(l_quantity)").groupBy("all").agg(F.sum("count").alias("count"), F.sum("sum_l_quantity").alias("sum_l_quantity"))


@query(f"""SELECT sample, sequenced, count(*) AS count FROM (SELECT 's1' AS sample, "sequenced-s1" AS sequenced FROM ({G}) UNION ALL SELECT 's2', "sequenced-s2" FROM ({G})) GROUP BY ALL""")
def group_sample(t):
    return g.group(genotypes(t), "sample * sequenced *")


@query("SELECT l_linenumber, count(*) AS count FROM lineitem GROUP BY l_linenumber")
def histogram(t):
    return g.histogram(t("lineitem"), "l_linenumber")


@query("SELECT event_type, min(event_id) AS first, max(event_id) AS last, CAST(sum(user_id) AS BIGINT) AS user_id, round(min(value), 6) AS value_min, count(value) AS value_count FROM (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY run, event_type")
def groupby_runs(t):
    x = g.runs(t("events").select("event_id", "event_type", "user_id", "value", F.col("event_id").cast("string").alias("ids")), ["event_type"], ["event_id"], ["user_id"], ["value"])
    ids = F.transform(F.split("ids", ","), lambda v: v.cast("long"))
    return x.select("event_type", F.array_min(ids).alias("first"), F.array_max(ids).alias("last"), "user_id", F.round("value_min", 6).alias("value_min"), "value_count")


# joins


@query("SELECT o.o_orderkey, o.o_orderstatus, l.l_linenumber, l.l_partkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def tsvjoin_inner(t):
    return joins.tsvjoin(t("orders").select("o_orderkey", "o_orderstatus"), t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "inner", ["o_orderkey"], ["l_orderkey"])


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(CAST(c_nationkey AS VARCHAR), '?') AS \"x_c_nationkey\", coalesce(CAST(o_orderkey AS VARCHAR), '?') AS \"y_o_orderkey\" FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey")
def tsvjoin_full(t):
    return joins.tsvjoin(t("customer").select("c_custkey", "c_nationkey"), t("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), "full", ["c_custkey"], ["o_custkey"], "x_", "y_", "?")


@query("SELECT n.n_nationkey, n_name, s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
def tsvjoin_left(t):
    return joins.tsvjoin(t("nation").select("n_nationkey", "n_name"), t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "left")


@query("SELECT c_name, s_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)")
def paste(t):
    return joins.paste([t("customer").select("c_name", "c_custkey"), t("supplier").select("s_name", "s_suppkey")], [["c_custkey"], ["s_suppkey"]]).select("c_name", "s_name")


@query("SELECT k, coalesce(max(n) FILTER (s = 'A'), 0) AS \"n-A\", coalesce(max(n) FILTER (s = 'R'), 0) AS \"n-R\" FROM (SELECT CAST(l_partkey AS VARCHAR) AS k, l_returnflag AS s, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) GROUP BY k")
def multicount(t):
    one = lambda s: t("lineitem").where(F.col("l_returnflag") == s).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.multicount({"A": one("A"), "R": one("R")}, ["k"], ["n"])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def merge_keys(t):
    x = t("lineitem")
    return joins.merge_keys([x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'")], ["l_partkey", "l_suppkey"])


@query("SELECT s_suppkey, s_nationkey, n_name AS name, n_regionkey AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def sampleinfo_lookup(t):
    info = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return add_sampleinfo(t("supplier").select("s_suppkey", "s_nationkey"), info, "s_nationkey")


# order


@query("SELECT c_custkey, rn - 1 AS r FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)")
def row_number(t):
    return with_row(t("customer").select("c_custkey"), ["c_custkey"], "r")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {PAD.format('lower(p_brand)')}, p_brand, p_partkey) - 1 AS r FROM part")
def sort_natural(t):
    x = t("part").select("p_partkey", "p_brand", nat_key("p_brand").alias("key"))
    return with_row(x, ["key", "p_partkey"], "r").select("p_partkey", "r")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 4 = 0")
def sampling_skip(t):
    return systematic_sample(t("orders").select("o_orderkey"), 3, ["o_orderkey"])


# sets


@query("SELECT 'c' AS file, c_name AS name, CAST(c_acctbal AS VARCHAR) AS bal, '' AS extra FROM customer UNION ALL SELECT 's', s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier".replace("CAST(c_acctbal AS VARCHAR)", "printf('%.2f', c_acctbal)"))
def cat_merge(t):
    return setops.cat([t("customer").select(F.col("c_name").alias("name"), F.format_string("%.2f", "c_acctbal").alias("bal")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("extra"))], merge=True, names=["c", "s"])


@query("SELECT l_partkey, '-' AS diff FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_partkey, '+' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def tsvdiff(t):
    x = t("lineitem")
    return setops.difference(x.where("l_returnflag = 'A'").select("l_partkey"), x.where("l_returnflag = 'R'").select("l_partkey"))


# shape


@query(f"""SELECT id, line, 's1' AS sample, "sequenced-s1" AS sequenced, "quality-s1" AS quality FROM ({G}) UNION ALL SELECT id, line, 's2', "sequenced-s2", "quality-s2" FROM ({G})""")
def long(t):
    return reshape.long(project(genotypes(t), "id line sequenced-s1 sequenced-s2 quality-s1 quality-s2"), "sample")


@query("""WITH c AS (SELECT l_partkey, l_returnflag || '-' || l_linestatus AS k, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, coalesce(max(n) FILTER (k='A-F'), '?') AS "n-A-F", coalesce(max(n) FILTER (k='N-O'), '?') AS "n-N-O", coalesce(max(n) FILTER (k='R-F'), '?') AS "n-R-F" FROM c GROUP BY l_partkey""")
def wide(t):
    c = t("lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return reshape.wide(c, ["l_partkey"], ["l_returnflag", "l_linestatus"], values=["A-F", "N-O", "R-F"])


@query(f"""SELECT id, line, 's1' AS sample, 'sequenced' AS key, "sequenced-s1" AS value FROM ({G}) UNION ALL SELECT id, line, 's2', 'sequenced', "sequenced-s2" FROM ({G})""")
def keyvalue(t):
    return reshape.keyvalue(project(genotypes(t), "id line sequenced-s1 sequenced-s2"), ["id", "line"])


@query("""WITH c AS (SELECT l_suppkey, l_linestatus AS k, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, coalesce(max(v) FILTER (k='F'), '') AS "F", coalesce(max(v) FILTER (k='O'), '') AS "O" FROM c GROUP BY l_suppkey""")
def colvalue(t):
    c = t("lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("v"))
    return reshape.colvalue(c, ["l_suppkey"], ["l_linestatus"], "v")
