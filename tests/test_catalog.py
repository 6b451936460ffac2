"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted([plain(v) for v in r] for r in got.collect()) == sorted([plain(v) for v in r] for r in want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["query_id", "chunk_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(catalog.__file__)
    for folder, _, names in os.walk(os.path.dirname(root)):
        if f"{os.sep}llm" not in folder:
            assert not any("tessera.llm" in open(os.path.join(folder, n), encoding="utf-8").read() for n in names if n.endswith(".py"))
