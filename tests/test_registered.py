"""Every registered reference query against its SQL in DuckDB, over sf0.001."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from foliant.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may be empty at this size.
MAY_BE_EMPTY = {"emails", "failure_streaks", "job_purge", "batch_limits"}


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    return str(v) if isinstance(v, (list, dict)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in result.fetchall())
    assert got == want
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
