"""Effects on proteins by hand: a gene of two coding stretches, ATG AAA TGG GAA | TTT CAA TAA with the border in a codon."""

import pytest
from locusframe.operators import effects
from locusframe.operators.annotate import Database, annotate, describe

PLUS = [(100, 110), (200, 211)]
CODING = "ATGAAATGGGAATTTCAATAA"


@pytest.mark.parametrize(
    "begin, end, ref, alt, want",
    [
        (100, 101, "A", "G", ("CDSSTART", "c.1A>G")),
        (103, 104, "A", "G", ("CDSMIS", "c.4A>G:p.K2E")),
        (105, 106, "A", "G", ("CDSsilent", "c.6A>G:p.K2=")),
        (103, 104, "A", "T", ("CDSNONSENSE", "c.4A>T:p.K2*")),
        (208, 209, "T", "C", ("CDSSTOP", "c.19T>C:p.*7Q")),
        (103, 106, "AAA", "", ("CDSDEL", "c.4_6del:p.K2del")),
        (103, 104, "A", "", ("CDSFRAME", "c.4del:p.K2fs")),
        (106, 106, "", "GGG", ("CDSINS", "c.6_7insGGG:p.W3ins")),
        (106, 106, "", "GG", ("CDSFRAME", "c.6_7insGG:p.W3fs")),
        (103, 105, "AA", "CC", ("CDSCOMP", "c.4_5delinsCC:p.K2sub")),
        (108, 201, "GG", "", ("CDSSPLICE", "c.9_11del")),
        (101, 104, "TGA", "", ("CDSSTARTDEL", "c.2_4del")),
    ],
)
def test_plus_strand(begin, end, ref, alt, want):
    assert effects.effect("+", PLUS, CODING, begin, end, ref, alt) == want


def test_minus_strand_reads_from_the_other_end():
    # the last base of the second stretch is the first of the coding sequence
    assert effects.effect("-", PLUS, CODING, 210, 211, "T", "C") == ("CDSSTART", "c.1A>G")
    assert effects.effect("-", PLUS, CODING, 207, 208, "T", "C") == ("CDSMIS", "c.4A>G:p.K2E")
    assert effects.effect("-", PLUS, CODING, 205, 208, "TTT", "") == ("CDSDEL", "c.4_6del:p.K2del")


def test_whole_genes_and_several_transcripts(spark):
    seq = ["N"] * 400
    seq[100:110], seq[200:211] = CODING[:10], CODING[10:]
    genome = spark.createDataFrame([("chr1", i, "".join(seq[i : i + 100])) for i in range(0, 400, 100)], "chromosome string, start long, seq string")
    genes = spark.createDataFrame([("1", 90, 220, "+", "t1", "90,200,", "110,220,", 100, 211), ("1", 90, 150, "+", "t2", "90,", "150,", 90, 90)], "chromosome string, begin long, end long, strand string, name string, exonStarts string, exonEnds string, cdsStart long, cdsEnd long")
    rows = [("1", 103, 104, "snp", "A", "G"), ("1", 80, 230, "del", "150", ""), ("1", 300, 301, "snp", "N", "A"), ("1", 103, 104, "snp", "A", "G"), ("1", None, None, "snp", "A", "G")]
    a = spark.createDataFrame(rows, "chromosome string, begin long, end long, type string, ref string, alt string")
    out = effects.annotate_effects(a, genes, genome, upstream=0, chunk=100)
    got = sorted((r["begin"], r["gene_impact"], r["gene_gene"], r["gene_descr"]) for r in out.collect())
    assert got == [(80, "GENEDEL;GENEDEL", "t1;t2", got[0][3]), *[(103, "CDSMIS;RNA", "t1;t2", "+t1:exon1:c.4A>G:p.K2E;+t2:exon1")] * 2, (300, "", "", "")]


def test_databases_are_known_by_their_names(spark):
    t = spark.createDataFrame([("1", 10, 20, "x", 3)], "chromosome string, begin long, end long, name string, score int")
    assert [(d.kind, d.name) for d in (describe(p, t) for p in ("/a/reg_hg19_repeats.tsv", "b/var_hg19_gnomad.tsv.gz", "gene_hg19_refGene.tsv", "var_hg19_cadd.bcol", "other.tsv"))] == [("reg", "repeats"), ("var", "gnomad"), ("gene", "refGene"), ("bcol", "cadd"), ("reg", "other")]
    a = spark.createDataFrame([("chr1", 15, 16), ("1", 30, 31)], "chromosome string, begin long, end long")
    out = annotate(a, [describe("reg_hg19_rep.tsv", t), Database(t, "reg", "again", ["score"])])
    assert out.columns == ["chromosome", "begin", "end", "rep_name", "rep_score", "again"]
    assert sorted(map(tuple, out.collect())) == [("1", 15, 16, "x", 3, 3), ("1", 30, 31, None, None, None)]
    with pytest.raises(ValueError):
        annotate(out, [Database(t, "reg", "again", ["score"])])
    assert annotate(out, [Database(t, "reg", "again", ["score"])], replace="n").columns == out.columns
