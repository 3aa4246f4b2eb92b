"""Every query that has SQL gives what DuckDB gives, on tables of the smallest size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: int(v) if isinstance(v, bool) else v
    return sorted(tuple(str(plain(r[i])) for i in order) for r in values)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref", "path", "time"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
