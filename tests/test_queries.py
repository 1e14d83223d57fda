import pytest
from locusframe.plans import exchange, further, genomic, relational  # noqa: F401
from locusframe.plans.registry import QUERIES, SQL
from oracle import SF, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    n = compare(QUERIES[name](spark, SF), SQL[name], SF)
    assert n > 0


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"clusterregions"}  # a running score; test_operators compares it with a plain loop


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bcol_get_all_reads_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {r["pos"]: r["value"] for r in QUERIES["bcol_get_all"](spark, SF).collect()}
    want = {r["event_id"]: float(r["value"] // 20) for r in events.select("event_id", "value").collect() if r["value"] >= 20}
    assert want and got == {p: want.get(p, -1.0) for p in range(max(r[0] for r in events.select("event_id").collect()) + 1)}
