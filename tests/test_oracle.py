"""Each core query against its DuckDB statement on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from meadowlark import queries as core

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(core.queries()))
def test_query_equals_oracle(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    expected = duck.sql(core.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert [kinds[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in expected.select(*columns).types]
    rows = expected.select(*columns).fetchall()
    assert rows
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(rows)
