"""The corpus queries that SQL can express against their DuckDB statements, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from meadowlark.llm import oracles, queries

DATA = Path("/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def agree(df, expected):
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert [KINDS[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in expected.select(*columns).types]
    rows = expected.select(*columns).fetchall()
    assert rows
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    agree(queries.queries()[name](spark, str(DATA)), con.sql(queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op7_quality_rules"])
def test_query_equals_oracle_on_odd_rows(spark, odd_docs, tmp_path, name):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    agree(queries.queries()[name](spark, str(tmp_path)), con.sql(queries.oracle_sql()[name]))
