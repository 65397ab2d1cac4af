"""The operators' queries that SQL can express give the rows that DuckDB does."""

import os

import duckdb
import pytest

from textloom.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(name, sf, spark):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't there")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{path}/documents.parquet'")
    got, expected = registry.queries()[name](spark, path).toArrow(), db.sql(SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(expected)
    kinds = lambda t: {c: str(t.schema.field(c).type).replace("large_", "") for c in columns}
    assert kinds(got) == kinds(expected)
