"""The tables of the domain, made of the general ones, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Regions of lineitem and part; genotypes and variants of lineitem. Names: columns and SQL source.
REGIONS_A = ["cast(l_suppkey % 22 + 1 as string) as chromosome", "l_partkey * 10 as begin", "cast(l_partkey * 10 + l_quantity as bigint) as end", "l_orderkey as id", "l_returnflag as flag", "cast(l_quantity as bigint) as score"]
REGIONS_B = ["cast(p_size % 22 + 1 as string) as chromosome", "p_partkey * 10 as begin", "p_partkey * 10 + p_size as end", "p_partkey as pid", "p_brand as brand"]
GENOTYPES = [
    "l_orderkey as id", "l_linenumber as line", "case l_returnflag when 'A' then 'v' when 'R' then 'r' else 'u' end as `sequenced-s1`", "case l_linestatus when 'O' then 'v' else 'r' end as `sequenced-s2`",
    "case when l_quantity > 25 then 'A' else 'C' end as `alleleSeq1-s1`", "case when l_tax > 0.04 then 'C' else 'G' end as `alleleSeq2-s1`", "case when l_quantity > 20 then 'A' else 'C' end as `alleleSeq1-s2`",
    "case when l_discount > 0.05 then 'C' else 'A' end as `alleleSeq2-s2`", "'A' as ref", "case when l_linenumber % 2 = 0 then 'C' else 'C,G' end as alt", "l_quantity as `quality-s1`", "l_discount as `quality-s2`",
]


def sql_of(expressions: list[str], table: str) -> str:
    out = ", ".join(expressions).replace("as string)", "as varchar)").replace("`", '"').replace(" as end", ' as "end"')
    return f"SELECT {out} FROM {table}"


A, B, G = sql_of(REGIONS_A, "lineitem"), sql_of(REGIONS_B, "part"), sql_of(GENOTYPES, "lineitem")


def regions_a(t) -> DataFrame:
    return t("lineitem").selectExpr(*REGIONS_A)


def regions_b(t) -> DataFrame:
    return t("part").selectExpr(*REGIONS_B)


def genotypes(t) -> DataFrame:
    return t("lineitem").selectExpr(*GENOTYPES)


#: A variant for each order and allele; the samples are line states.
VARIANTS = """SELECT chromosome, begin, begin + 1 AS "end", 'snp' AS type, 'A' AS ref, alt, sample, max(quality) AS quality, min(zyg) AS zyg FROM (
SELECT CAST(l_suppkey % 5 + 1 AS VARCHAR) AS chromosome, l_partkey AS begin, CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'G' ELSE 'T' END AS alt, l_returnflag AS sample, CAST(l_quantity AS BIGINT) AS quality,
CASE WHEN l_tax > 0.04 THEN 'm' ELSE 't' END AS zyg FROM lineitem) GROUP BY chromosome, begin, alt, sample"""


def variants(t) -> DataFrame:
    from pyspark.sql import functions as F

    x = t("lineitem").selectExpr(
        "cast(l_suppkey % 5 + 1 as string) as chromosome", "l_partkey as begin", "case l_linenumber % 3 when 0 then 'C' when 1 then 'G' else 'T' end as alt", "l_returnflag as sample", "cast(l_quantity as bigint) as quality", "case when l_tax > 0.04 then 'm' else 't' end as zyg"
    )
    g = x.groupBy("chromosome", "begin", "alt", "sample").agg(F.max("quality").alias("quality"), F.min("zyg").alias("zyg"))
    return g.select("chromosome", "begin", (F.col("begin") + 1).alias("end"), F.lit("snp").alias("type"), F.lit("A").alias("ref"), "alt", "sample", "quality", "zyg")
