"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from rollkin.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows.fetchall())
