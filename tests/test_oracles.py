import math

import duckdb
import pytest

from locusframe.plans.queries import ORACLES, QUERIES
from locusframe.sources.domain import TABLES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found):
    number = lambda v: v is not None and not isinstance(v, (str, bool, list))
    return sorted(tuple(("" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5f}" if number(v) else str(v)) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.select(*[f"`{c}`" for c in want.columns]).collect())) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
