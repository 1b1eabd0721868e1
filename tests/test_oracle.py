"""Every registered query against its DuckDB form on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # whole numbers with nulls among them come as floats from one side
    got = got.astype({c: "Int64" for c in got.columns if str(want[c].dtype) == "Int64"})
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_reads_tables(spark, tmp_path):
    """Without the tables no query gives anything."""
    for name, query in entry.queries().items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            query(spark, str(tmp_path)).count()
            pytest.fail(f"{name} reads no table")


def test_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
