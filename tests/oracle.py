"""Rows of a DataFrame against rows of DuckDB's SQL, columns by name, floats to 9 places."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, int)):
        return repr(x)
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return repr(x) if math.isnan(x) else format(round(x, 9) + 0.0, ".12g")
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def kinds(names_types):
    groups = {"bigint": "i", "int": "i", "BIGINT": "i", "INTEGER": "i", "HUGEINT": "huge", "double": "f", "DOUBLE": "f", "string": "s", "VARCHAR": "s", "boolean": "b", "BOOLEAN": "b"}
    return {n: groups.get(str(t), str(t)) for n, t in names_types}


def compare(df, sql, sf_dir):
    got = rows(df.columns, df.collect())
    c = connection(sf_dir)
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    types = kinds((d[0], d[1]) for d in r.description)
    want = rows(names, r.fetchall())
    assert got[0] == want[0]
    assert kinds(df.dtypes) == types
    extra, lack = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
    assert got[1] == want[1], f"{len(got[1])} rows, {len(want[1])} wanted; only here: {extra}; lacking: {lack}"
    return len(got[1])
