"""Every query with SQL against DuckDB on the smallest tables, and the contract's functions."""

import duckdb
import pytest

from loamstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].astype(object).where(df[columns].notna(), None)
    for c in columns:
        text[c] = [None if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in text[c]]
    return columns, sorted(map(tuple, text.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, sf).toPandas()), plain(duck.execute(catalog.ORACLE[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
