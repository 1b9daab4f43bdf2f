"""Every query of the engine gives what its SQL gives in DuckDB, on the small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from webloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    one = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        one.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return one


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
