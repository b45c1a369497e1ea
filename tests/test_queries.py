"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from plumbline.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    rows = df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)
    return sorted(repr([v.item() if hasattr(v, "item") else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_entry_without_training_data_subpackage(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries()
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
