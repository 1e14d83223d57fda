"""Runs and merged fields, whatever the size of chunks and bins, against plain loops."""

import random
from itertools import groupby

import pytest
from locusframe.operators import group as g
from locusframe.operators import intervals


@pytest.mark.parametrize("chunk", [1, 3, 1 << 17])
def test_runs_follow_the_order_of_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(g, "RUN_CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, k string, n int").repartition(4)
    got = sorted((r["k"] or "", r["i"], r["n"]) for r in g.runs(df, ["k"], ["i"], ["n"]).collect())
    want = []
    for k, part in groupby(rows, key=lambda r: r[1]):
        part = list(part)
        want.append((k or "", ",".join(str(r[0]) for r in part), sum(r[2] for r in part)))
    assert got == sorted(want)


@pytest.mark.parametrize("size", [4, 1000])
def test_merged_fields(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice("12"), b, b + rng.choice([0, 0, 2, 5, 9]), rng.choice(["x", "y", None])) for b in (rng.randint(0, 80) for _ in range(60))]
    got = sorted(map(repr, map(tuple, intervals.regjoin_fields(spark.createDataFrame(rows, "chromosome string, begin long, end long, f string"), ["f"], size).collect())))
    want = []
    for c, f in {(r[0], r[3]) for r in rows}:
        now = None
        for b, e in sorted((r[1], r[2]) for r in rows if (r[0], r[3]) == (c, f)):
            if now and b <= now[1]:
                now[1] = max(now[1], e)
            else:
                now = [b, e]
                want.append((c, now, f))
    assert got == sorted(repr((c, b, e, f)) for c, (b, e), f in want)


def test_no_rows(spark):
    assert g.runs(spark.createDataFrame([], "i long, k string"), ["k"], ["i"]).count() == 0
