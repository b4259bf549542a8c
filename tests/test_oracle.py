"""Every query with an oracle matches DuckDB on the smallest driver tables
(column names, row count and rounded values, order-insensitive)."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import canon

from .conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLE[name])
    want = canon([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["filename", "n_utterances", "n_tokens", "n_unique_tokens", "ttr", "mean_token_length"]
