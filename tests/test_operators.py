import random

import pytest
from locusframe import model
from locusframe.natural import nat_key, nat_sort_key
from locusframe.operators import intervals, joins, reshape, setops, variants
from locusframe.operators.group import group
from locusframe.operators.select import expand_calculated, select, split_fields
from pyspark.sql import functions as F


def test_names():
    assert model.samples(["a-x-s1", "a-s2", "b"]) == ["s1", "s2"] and model.analyses(["a-x-s1"]) == ["x-s1"]
    assert model.resolve_roles(["chrom", "txStart", "txEnd"])["begin"] == "txStart"
    with pytest.raises(model.RoleError):
        model.resolve_roles(["a"], ("begin",))
    assert split_fields('a b=if($x == "p q", 1, 2) -c=$d') == ["a", 'b=if($x == "p q", 1, 2)', "-c=$d"]
    assert expand_calculated(["count-a", "count-b", "total"], "freq-*", "$count-*/$total") == [("freq-a", "${count-a}/${total}"), ("freq-b", "${count-b}/${total}")]


def test_natural_order(spark):
    x = ["10", "9", "-1.5", "chr10", "chr2", "Chr2", "chrX", "*", "a1b10", "a1b9"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v string").orderBy(nat_key("v")).collect()]
    assert got == sorted(x, key=nat_sort_key) == ["-1.5", "9", "10", "a1b9", "a1b10", "Chr2", "chr2", "chr10", "chrX", "*"]


def rnd(rng, n, span=300, width=25):
    return [(rng.choice(["chr1", "chr2"]), b, b + rng.randint(0, width)) for b in (rng.randint(0, span) for _ in range(n))]


def cover(rows):
    return {(c[3:], p) for c, b, e in rows for p in range(b, e)}


def positions(df):
    rows = df.select("chromosome", "begin", "end").collect()
    out = [(c, p) for c, b, e in rows for p in range(b, e)]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_interval_algebra(spark, size):
    rng = random.Random(3)
    ra, rb = rnd(rng, 40), rnd(rng, 30)
    a, b = (spark.createDataFrame(r, "chromosome string, begin long, end long").cache() for r in (ra, rb))
    assert positions(intervals.regjoin(a, size=size)) == cover(ra)
    assert positions(intervals.regcommon(a, b, size)) == cover(ra) & cover(rb)
    assert positions(intervals.regsubtract(a, b, size)) == cover(ra) - cover(rb)
    m = intervals.multireg({"a": a, "b": b}, size).cache()
    assert positions(m.where("a = 1")) == cover(ra) and positions(m.where("b = 1")) == cover(rb)
    got = intervals.regselect(a, b, bin_size=size).count()
    assert got == sum(any(c == d and s < g and (f < e or s == f) for d, f, g in rb) for c, s, e in ra)


def test_long_and_wide_are_inverse(spark):
    df = spark.createDataFrame([(1, "a", "b", "c"), (2, "d", "e", "f")], "id long, `x-s1` string, `x-s2` string, `y-s1` string")
    long = reshape.long(df, "sample")
    assert long.count() == 4
    back = reshape.wide(long, ["id"], ["sample"])
    assert sorted(map(tuple, back.select("id", "`x-s1`", "`x-s2`", "`y-s1`", "`y-s2`").collect())) == [(1, "a", "b", "c", "?"), (2, "d", "e", "f", "?")]


def test_wide_takes_the_last(spark):
    df = spark.createDataFrame([(1, "s", "a", 1), (1, "s", "b", 2)], "id long, sample string, v string, at int")
    assert reshape.wide(df, ["id"], ["sample"], ["at"]).select("`v-s`").first()[0] == "b"


def test_select_hides_and_sorts(spark):
    df = spark.createDataFrame([("chr10", 1), ("chr2", 5), ("chr2", 3)], "chromosome string, begin long")
    got = select(df, "chromosome twice=$h*2 -h=$begin+1".replace("twice=$h*2 -h=$begin+1", "-h=$begin+1 twice=$h*2"), "$h > 1", "=chromosome -begin")
    assert [tuple(r) for r in got.collect()] == [("chr2", 12), ("chr2", 8), ("chr10", 4)]


def test_group_filters_and_ungiven_pivots(spark):
    df = spark.createDataFrame([("snp", "m", 1), ("snp", "t", 3), ("del", "t", 5), ("ins", "c", 9)], "type string, zyg string, q int")
    got = {r[0]: r[1:] for r in group(df, "type {snp d*}", "zyg {m t} count,max(q)").collect()}
    assert got == {"snp": (1, 1, 1, 3), "del": (0, None, 1, 5)}


def test_cat_needs_equal_headers(spark):
    a, b = spark.range(1).toDF("x"), spark.range(1).toDF("y")
    with pytest.raises(ValueError):
        setops.cat([a, b])
    assert setops.cat([a, b], force=True).columns == ["x"]
    assert joins.paste([a, b], [["x"], ["y"]]).count() == 1


def test_multicompar_completes_cells(spark):
    s = "chromosome string, begin long, end long, type string, ref string, alt string, sequenced string, zyg string, alleleSeq1 string, alleleSeq2 string"
    a = spark.createDataFrame([("chr1", 5, 6, "snp", "A", "C", "v", "m", "C", "C"), ("chr1", 9, 10, "snp", "A", "T", "v", "t", "A", "T")], s)
    b = spark.createDataFrame([("1", 5, 6, "snp", "A", "G", "v", "t", "A", "G")], s)
    reg = {"a": spark.createDataFrame([("1", 0, 100)], "chromosome string, begin long, end long"), "b": spark.createDataFrame([("1", 0, 7)], "chromosome string, begin long, end long")}
    rows = {(r["begin"], r["alt"]): r for r in variants.multicompar({"a": a, "b": b}, reg).collect()}
    assert rows[5, "C"]["zyg-b"] == "o" and rows[5, "G"]["zyg-a"] == "o" and rows[9, "T"]["sequenced-b"] == "u" and rows[9, "T"]["zyg-a"] == "t"


def test_structural_variants_match_one_to_one(spark):
    s = "id long, chromosome string, begin long, end long, type string"
    a = spark.createDataFrame([(1, "1", 1000, 2000, "del"), (2, "1", 1010, 2010, "del"), (3, "1", 9000, 9100, "inv")], s)
    b = spark.createDataFrame([(7, "1", 1011, 2010, "del"), (8, "1", 900, 1990, "del"), (9, "1", 9000, 9100, "dup")], s)
    assert sorted((r[0], r[1]) for r in variants.sv_pairs(a, b).collect()) == [(1, 8), (2, 7)]


def test_genes_and_liftover(spark):
    g = spark.createDataFrame([("1", 100, 500, "+", "t1", "100,300,", "200,500,", 150, 400)], "chromosome string, begin long, end long, strand string, name string, exonStarts string, exonEnds string, cdsStart long, cdsEnd long")
    v = spark.createDataFrame([("1", 160, 161), ("1", 120, 121), ("1", 201, 202), ("1", 250, 251), ("1", 450, 451), ("1", 5000, 5001), ("1", 90, 91)], "chromosome string, begin long, end long")
    got = {r["begin"]: r["gene_impact"] for r in variants.annotate_genes(v, g).collect()}
    assert got == {160: "CDS", 120: "UTR5", 201: "ESPLICE", 250: "intron", 450: "UTR3", 5000: "", 90: "upstream"}
    chain = spark.createDataFrame([("1", 100, 300, "2", 1000, 1200, "+"), ("1", 400, 500, "3", 50, 150, "-")], "chromosome string, begin long, end long, destchromosome string, destbegin long, destend long, strand string")
    done, left = variants.liftover(v.where("begin in (120, 450, 5000)"), chain)
    assert sorted((r[0], r[1], r[2]) for r in done.collect()) == [("2", 1020, 1021), ("3", 99, 100)] and left.count() == 1
    genome = spark.createDataFrame([("1", 0, "ACGTACGTAC"), ("1", 10, "GGGGGTTTTT")], "chromosome string, start long, seq string")
    x = spark.createDataFrame([("1", 8, 12, "N", "T"), ("1", 3, 4, "T", "A")], "chromosome string, begin long, end long, ref string, alt string")
    assert sorted((r["ref"], r["refok"]) for r in variants.correct_variants(x, genome, 10).collect()) == [("ACGG", 0), ("T", 1)]


def test_clusters(spark):
    df = spark.createDataFrame([("1", 1000 + 10 * i, 1001 + 10 * i) for i in range(30)] + [("1", 90_000, 90_001)], "chromosome string, begin long, end long")
    assert [tuple(r) for r in variants.cluster_regions(df).collect()] == [("1", 1000, 1291, 30)]


def test_splitting_recomputes_zyg(spark):
    df = spark.createDataFrame([("1", 5, "A", "C,G", "v", "c", "C", "G", "0.1,0.2")], "chromosome string, begin long, ref string, alt string, sequenced string, zyg string, alleleSeq1 string, alleleSeq2 string, freq string")
    got = sorted((r["alt"], r["zyg"], r["sequenced"], r["freq"]) for r in variants.split_alleles(df).collect())
    assert got == [("C", "c", "v", "0.1"), ("G", "c", "v", "0.2")]
    line = variants.exportplink(df.withColumnsRenamed({"alleleSeq1": "alleleSeq1-s", "alleleSeq2": "alleleSeq2-s"}).withColumn("end", F.lit(6)).withColumn("type", F.lit("snp")).drop("sequenced", "zyg")).orderBy("line").first()[0]
    assert line == "1 1-5-6-snp-C 0 5 C G"


def test_regions_that_end_on_the_border_of_a_bin_keep_their_boundary(spark):
    a = [("1", 0, 16), ("1", 16, 32), ("1", 8, 40), ("1", 48, 64)]
    b = [("1", 4, 32), ("1", 32, 36)]
    make = lambda rows: spark.createDataFrame(rows, "chromosome string, begin long, end long")
    for size in (4, 8, 16, 1000):
        got = sorted(map(tuple, intervals.multireg({"a": make(a), "b": make(b)}, size).collect()))
        cuts = sorted({p for _, x, y in a + b for p in (x, y)})
        inside = lambda rows, p: int(any(x <= p < y for _, x, y in rows))
        assert got == [("1", x, y, inside(a, x), inside(b, x)) for x, y in zip(cuts, cuts[1:]) if inside(a, x) or inside(b, x)], size
        rest = sorted((r[1], r[2]) for r in intervals.regsubtract(make(a), make(b), size).collect())
        assert rest == [(0, 4), (36, 40), (48, 64)], size


def test_rounding_is_that_of_printf(spark):
    from locusframe.functions.values import fixed

    values = [0.5625, 0.2125, 0.125, 0.375, 2.5, 1e15 + 0.5, -0.0625, 33.335, 1234567.125, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 3):
        assert [r[0] for r in df.select(fixed(F.col("x"), places)).collect()] == [f"%.{places}f" % v for v in values]
    from locusframe.operators.select import select

    got = select(df, 'f=format("a%8.2fb%-7.1f|%d%%",$x,$x,3)').collect()
    assert [r[0] for r in got] == ["a%8.2fb%-7.1f|%d%%" % (v, v, 3) for v in values]


def test_one_to_one_matches_of_a_long_chain(spark):
    """Each pair only becomes the least when the one before is gone."""
    n = 24
    at = [0]
    for i in range(2 * n - 1):
        at.append(at[-1] + 200 - 3 * i)
    rows = [("1", p, p + 1000, "dup", i) for i, p in enumerate(at)]
    frame = lambda k: spark.createDataFrame(rows[k::2], "chromosome string, begin long, end long, type string, id long")
    got = {(r["a_id"], r["b_id"]) for r in variants.sv_pairs(frame(0), frame(1)).collect()}
    left, want = sorted((2 * abs(a[1] - b[1]), a[4], b[4]) for a in rows[::2] for b in rows[1::2] if abs(a[1] - b[1]) <= 250), set()
    used = set()
    for _, a, b in left:
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert got == want


def test_lists_are_in_the_order_of_the_input(spark):
    df = spark.createDataFrame([(i % 2, f"v{(i * 7) % 10}") for i in range(10)], "k long, v string")
    assert [r[1] for r in group(df, "k", "list(v)").collect()] == ["v0,v4,v8,v2,v6", "v7,v1,v5,v9,v3"]


def test_packed_files(spark, tmp_path):
    import gzip

    import zstandard

    from locusframe.sources.tsv import read_tsv

    text = "#comment\na\tb\n" + "".join(f"{i}\tx{i}\n" for i in range(1000))
    (tmp_path / "t.tsv.zst").write_bytes(zstandard.compress(text.encode()))
    (tmp_path / "t.tsv.bgz").write_bytes(gzip.compress(text[:5000].encode()) + gzip.compress(text[5000:].encode()))
    for name in ("t.tsv.zst", "t.tsv.bgz"):
        df = read_tsv(spark, str(tmp_path / name))
        assert df.columns == ["a", "b"] and df.count() == 1000
    import pytest

    with pytest.raises(ValueError):
        read_tsv(spark, "x.rz")


def test_a_fastq_file_that_is_read_in_parts(spark, tmp_path):
    from locusframe.sources import fastq2tsv

    rows = [(f"r{i}", "ACGT"[: 1 + i % 4] * 3, "@" + "F" * (3 * (1 + i % 4) - 1)) for i in range(400)]
    (tmp_path / "a.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "517")
    try:
        got = [tuple(r) for r in fastq2tsv(spark, str(tmp_path / "a.fq")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(rows)
