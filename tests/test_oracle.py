"""Every query with SQL gives the rows that DuckDB does, with the same names and types."""

import duckdb
import pytest

from textloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(arrow, columns):
    return sorted(map(repr, zip(*(arrow.column(c).to_pylist() for c in columns), strict=True)))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, db):
    got, expected = QUERIES[name](spark, sf_dir).toArrow(), db.sql(SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    assert rows(got, columns) == rows(expected, columns)
    kinds = lambda t: {c: str(t.schema.field(c).type).replace("large_", "") for c in columns}
    assert kinds(got) == kinds(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
