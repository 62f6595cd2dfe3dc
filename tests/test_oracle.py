"""Every registered query gives the rows of its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from papyrine.plans.registry import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def _value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def _rows(rows, cols):
    return sorted(tuple(_value(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.sql(oracle_sql()[name])
    assert sorted(result.columns) == cols
    want = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert _rows([r.asDict() for r in df.collect()], cols) == _rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
