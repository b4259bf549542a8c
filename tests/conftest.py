import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parlance.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="parlance-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from parlance.sources.tables import TABLES, path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path(SF_SMALL, t)}')")
    return con
