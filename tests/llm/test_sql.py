"""Corpus queries against their SQL in DuckDB, all rows."""

import duckdb
import pytest

from tempora.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == sorted(df.columns)
    want = sorted(tuple(r[theirs.index(c)] for c in df.columns) for r in found.fetchall())
    assert want and sorted(tuple(r) for r in df.collect()) == want
