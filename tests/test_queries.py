"""Every registered query of the library proper against its SQL in DuckDB, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from tempora.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == cols
    want = table([r[theirs.index(c)] for c in cols] for r in found.fetchall())
    assert table([r[c] for c in cols] for r in df.collect()) == want
