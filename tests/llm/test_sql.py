"""The training-data queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, medium, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    got, want = QUERIES[name](spark, medium), con.sql(ORACLE[name])
    assert got.columns == want.columns
    assert [f.dataType.simpleString() for f in got.schema.fields] == [{"BIGINT": "bigint", "VARCHAR": "string", "INTEGER": "int", "BOOLEAN": "boolean"}[str(t)] for t in want.types]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
