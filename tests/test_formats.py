import pytest
from locusframe import sources as s
from locusframe.sources import bcol
from locusframe.sources.formats import bed2genes, chain2tsv
from locusframe.sources.tsv import check_tsv
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_tsv(spark, tmp_path):
    df = s.read_tsv(spark, put(tmp_path, "a.tsv", "#key\tvalue\n#key\tother\na\tb\tb\n1\tx\t\n2\t\ty\n3\n"), types={"a": "Integer"})
    assert df.comments == {"key": ["value", "other"]} and df.columns == ["a", "b", "b_2"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", ""), (2, "", "y"), (3, None, None)]
    s.write_tsv(df, str(tmp_path / "out"), ["#made"], single=True)
    assert s.read_tsv(spark, str(tmp_path / "out")).count() == 3
    assert check_tsv(spark, put(tmp_path, "b.tsv", "a\tb\n1\t2\n3\n")).first()["fields"] == 1
    with pytest.raises(ValueError):
        s.read_tsv(spark, "x.rz")
    s.write_csv(df, str(tmp_path / "csv"))
    assert s.read_csv(spark, str(tmp_path / "csv")).count() == 3


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    text += "1\t10\trs1\tA\tC,G\t50\tPASS\tDP=7;DB\tGT:DP\t0/1:5\t1|2:9\n1\t20\t.\tAT\tA\t.\t.\tDP=1\tGT\t1/1\t./.\n1\t30\t.\tA\tATT\t9\t.\t.\tGT\t0/0\t0/1\n1\t40\t.\tACG\tATG\t9\t.\t.\tGT\t0/1\t0/0\n"
    got = {(r["begin"], r["alt"]): r for r in s.vcf2tsv(spark, put(tmp_path, "a.vcf", text), ["DP", "DB"]).collect()}
    assert {(k, r["end"], r["type"], r["ref"]) for k, r in got.items()} == {((9, "C"), 10, "snp", "A"), ((9, "G"), 10, "snp", "A"), ((20, ""), 21, "del", "T"), ((30, "TT"), 30, "ins", ""), ((40, "T"), 41, "snp", "C")}
    assert (got[9, "C"]["zyg-s1"], got[9, "C"]["zyg-s2"], got[9, "G"]["zyg-s1"], got[20, ""]["zyg-s1"], got[20, ""]["zyg-s2"]) == ("t", "c", "o", "m", "u")
    assert got[9, "C"]["coverage-s1"] == "5" and got[9, "C"]["DP"] == "7" and got[9, "C"]["DB"] == "1" and got[9, "C"]["phased-s2"] == "1"
    x = spark.createDataFrame([("1", 9, "A", "C", "A", "C"), ("1", 20, "T", "", "", "")], "chromosome string, begin long, ref string, alt string, `alleleSeq1-s` string, `alleleSeq2-s` string")
    assert sorted(r[0] for r in s.tsv2vcf(x).collect()) == ["1\t10\t.\tA\tC\t.\t.\t.\tGT\t0/1", "1\t20\t.\tNT\tN\t.\t.\t.\tGT\t1/1"]


def test_sam(spark, tmp_path):
    line = "r1\t16\tchr1\t101\t60\t2S5M1I3M2D4M3S\t=\t201\t50\tACGT\tFFFF\tNM:i:3\tRG:Z:x"
    df = s.sam2tsv(spark, put(tmp_path, "a.sam", "@HD\tVN:1\n" + line + "\n"), ["NM"])
    r = df.first()
    assert (r["begin"], r["end"], r["strand"], r["qstart"], r["qend"], r["reverse"], r["paired"], r["NM"]) == (100, 114, "-", 2, 15, 1, 0, "3")
    assert s.tsv2sam(df).first()[0] == line


def test_genes(spark, tmp_path):
    gtf = 'chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\tx\tCDS\t151\t200\t.\t+\t0\tgene_id "g"; transcript_id "t";\n'
    df = s.gtf2tsv(spark, put(tmp_path, "a.gtf", gtf))
    r = df.first()
    assert (r["begin"], r["end"], r["exonStarts"], r["exonEnds"], r["cdsStart"], r["cdsEnd"], r["geneid"]) == (100, 400, "100,300,", "200,400,", 150, 200, "g")
    assert sorted(x[0].split("\t")[2] for x in s.tsv2gtf(df).collect()) == ["CDS", "exon", "exon", "transcript"]
    bed = s.bed2tsv(spark, put(tmp_path, "a.bed", "track x\nchr1\t10\t100\tn\t0\t+\t20\t90\t0\t2\t10,20,\t0,70,\n"))
    assert bed2genes(bed).select("exonStarts", "exonEnds").first() == ("10,80,", "20,100,")
    assert s.tsv2bed(bed.select("chromosome", "begin", "end", "name")).first()[0] == "chr1\t10\t100\tn"
    assert chain2tsv(["chain 1 1 100 + 0 30 2 200 - 10 40 1", "10 5 2", "5"]) == [("1", 0, 10, "2", 180, 190, "-"), ("1", 15, 20, "2", 173, 178, "-")]


def test_sequences(spark, tmp_path):
    df = s.fasta2tsv(spark, put(tmp_path, "a.fa", ">one x\nACGT\nAC\n>two\nGG\n"))
    assert sorted(map(tuple, df.collect())) == [("one x", "ACGTAC"), ("two", "GG")]
    assert s.tsv2fasta(df, width=4).where("value like '>one%'").first()[0] == ">one x\nACGT\nAC"
    fq = s.fastq2tsv(spark, put(tmp_path, "a.fq", "@r1\nACG\n+\nFFF\n@r2\nAAA\n+\n@FF\n@r3\nC\n+\nF\n"))
    assert sorted(map(tuple, fq.collect())) == [("r1", "ACG", "FFF"), ("r2", "AAA", "@FF"), ("r3", "C", "F")]


def test_matrix_and_bcol(spark, tmp_path):
    put(tmp_path, "matrix.mtx", "%%MatrixMarket\n2 2 3\n1 1 5\n2 1 1\n2 2 2\n"), put(tmp_path, "features.tsv", "g1\tx\ng2\ty\n"), put(tmp_path, "barcodes.tsv", "c1\nc2\n")
    df = s.mm2tsv(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("g1", "c1", 5.0), ("g2", "c1", 1.0), ("g2", "c2", 2.0)]
    assert s.tsv2mm(df)[0].count() == 3
    runs = bcol.make(spark.createDataFrame([("chr1", i, i // 3) for i in range(7)], "chromosome string, pos long, v int"), "v", kind="i")
    assert [tuple(r) for r in runs.orderBy("begin").collect()] == [("1", 0, 3, 0), ("1", 3, 6, 1), ("1", 6, 7, 2)]
    assert [r[1] for r in bcol.get(runs, "chr1", 5, 9, -1).orderBy("pos").collect()] == [1, 2, -1, -1] and bcol.size(runs).first()[0] == 7 and bcol.table(runs).count() == 7


def test_stream(spark, tmp_path):
    from locusframe import streaming

    spark.range(20).select(F.col("id"), (F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    q = streaming.write(streaming.select_stream(stream, "id twice=$id*2", "$k == 1"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    with pytest.raises(ValueError):
        streaming.group_stream(stream, ["k"], "median(id)")
