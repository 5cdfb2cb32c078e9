"""Each registered query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from sparkwright import plans
from sparkwright.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name in plans.ORACLE_SQL:
        found = duck.execute(plans.ORACLE_SQL[name])
        heads = [x[0] for x in found.description]
        assert sorted(heads) == names
        want = sorted((tuple(plain(dict(zip(heads, r, strict=True))[c]) for c in names) for r in found.fetchall()), key=repr)
        assert rows == want
