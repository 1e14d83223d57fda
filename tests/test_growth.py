"""Plans whose memory doesn't grow with the tables: what is broadcast, gathered or kept, and where files are cut."""

import random

import pytest
from locusframe.operators import intervals, variants
from locusframe.operators.select import select, sort
from locusframe.plans import exchange, further, genomic, relational  # noqa: F401
from locusframe.plans.registry import QUERIES
from locusframe.sources import formats
from oracle import SF


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_side_of_an_overlap_join_is_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["annotate_genes"](spark, SF))


def test_coding_sequences_are_not_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["annotate_effects"](spark, SF))


def test_fastq_over_many_splits(spark, tmp_path):
    """Qualities of @ and +, in files of several splits that aren't read in the order of their places."""
    rng = random.Random(1)
    size = [rng.randint(3, 30) for _ in range(300)]
    rows = [(f"p{i}", "".join(rng.choice("ACGT") for _ in range(n)), "@" + "".join(rng.choice("FI#5@+") for _ in range(n - 1))) for i, n in enumerate(size)]
    for name, part in (("a", rows[:7]), ("b", rows[7:180]), ("c", rows[180:])):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in part))
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, formats.fastq2tsv(spark, str(tmp_path)).collect())) == sorted(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sweeps_sort_and_keep_no_table_of_positions(spark):
    for name in ("multireg", "depth"):
        assert "HashAggregate(keys=[chromosome" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_segments_of_events_at_one_position(spark, size):
    rng = random.Random(size)
    rows = [("1", b, b + rng.choice([0, 1, 4, 4, 8, 30])) for b in (4 * rng.randint(0, 12) for _ in range(60))]
    df = spark.createDataFrame(rows, "chromosome string, begin long, end long").repartition(5)
    got = sorted((r["begin"], r["end"], r["depth"]) for r in intervals.depth(df, size).collect())
    at = [sum(b <= p < e for _, b, e in rows) for p in range(100)]
    cuts = [p for p in range(1, 100) if at[p] != at[p - 1]]
    assert got == [(b, e, at[b]) for b, e in zip([0, *cuts], [*cuts, 100]) if at[b]]
    flags = sorted((r["begin"], r["end"]) for r in intervals.multireg({"a": df}, size).collect())
    edges = sorted({p for _, b, e in rows if b < e for p in (b, e)})
    assert flags == [(b, e) for b, e in zip(edges, edges[1:]) if at[b]]


def test_sort_keys_are_made_once(spark):
    """A sort makes expressions in its order again for each comparison."""
    df = spark.createDataFrame([("chr10", 1), ("2", 5), ("chrX", 0), (None, 2), ("chr2", 3), ("x*", 1)], "chromosome string, begin long")
    for keys in ("=chromosome begin", "~chromosome", "chromosome"):
        lines = [x for x in plan(sort(df, keys)).split("Physical Plan")[-1].splitlines() if "Sort [" in x or "rangepartitioning" in x]
        assert lines and not any("regexp" in x or "RLIKE" in x for x in lines)
    assert [tuple(r) for r in sort(df, "=chromosome begin").collect()] == [(None, 2), ("chr2", 3), ("2", 5), ("chr10", 1), ("chrX", 0), ("x*", 1)]
    assert [r[0] for r in sort(df, "-chromosome").collect()] == ["x*", "chrX", "chr10", "chr2", "2", None]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_check_sort_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(intervals, "CHECK_CHUNK", chunk, raising=False)
    rng = random.Random(chunk)
    rows = [(i, rng.choice(["chr1", "2", "chr10", "X"]), b, b + rng.randint(0, 2)) for i, b in ((i, rng.randint(0, 5)) for i in range(60))]
    got = sorted(r["i"] for r in intervals.check_sort(spark.createDataFrame(rows, "i long, chromosome string, begin long, end long").repartition(4), ["i"]).collect())
    key = lambda r: (["1", "2", "10", "X"].index(r[1].removeprefix("chr")), r[2], r[3])
    assert got == [b[0] for a, b in zip(rows, rows[1:]) if key(b) < key(a)]


def test_elements_of_vectors_are_made_once(spark):
    df = spark.createDataFrame([("1,2;x",), ("",), ("3",)], "v string")
    x = select(df, "s=$v@*$v p=$v@+1 c=vconcat($v)")
    optimized = plan(x).split("Optimized Logical Plan")[-1].split("Physical Plan")[0]
    assert optimized.count("split(") <= 6 and optimized.count("RLIKE") <= 8
    assert [tuple(r) for r in x.collect()] == [("1,4,NaN", "2,3,NaN", "1,2,x"), ("", "", ""), ("9", "4", "3")]


def test_clusters_are_scanned_in_batches(spark):
    assert "FlatMapGroups" not in plan(QUERIES["clusterregions"](spark, SF))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(5)
        rows = [(rng.choice("12"), b, b + 1) for b in (rng.choice([0, 3000]) + rng.randint(0, 400) for _ in range(120))]
        got = sorted(map(tuple, variants.cluster_regions(spark.createDataFrame(rows, "chromosome string, begin long, end long"), distance=4, least=3, stop=50).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for c in "12":
        first, score, n, last = None, 0, 0, None
        for _, b, e in [*sorted(r for r in rows if r[0] == c), (c, 10**9, 0)]:
            cut = last is not None and b - last > 50
            score = 0 if first is None or cut else score + (1 if b - last <= 4 else -1)
            if cut or first is None or score < 0:
                if first is not None and n > 3:
                    want.append((c, first, last, n))
                first, n, score = b, 0, 0
            n, last = n + 1, e
    assert got == sorted(want) and got
