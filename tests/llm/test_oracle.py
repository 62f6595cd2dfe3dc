"""Training-data queries against their SQL on the smallest of the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from papyrine.llm.oracle import SQL
from papyrine.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).is_dir():
        pytest.skip("no driver data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(rows, cols):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == cols
    want = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert _rows([r.asDict() for r in df.collect()], cols) == _rows(want, cols)
