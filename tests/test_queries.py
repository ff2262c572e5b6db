"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from parcelkit import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + ('/*.parquet' if os.path.isdir(path) else '')}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(name, spark, sf_dir, duck):
    df = q.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got
    if name in q.oracle_sql():
        found = duck.sql(q.oracle_sql()[name])
        assert sorted(found.columns) == sorted(df.columns)
        expected = rows(found.columns, found.fetchall())
        assert expected and got == expected


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
