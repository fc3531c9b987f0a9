"""The driver contract: entry() runs, and every query matches its DuckDB oracle (sf0.001)."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tessera.plans.queries import QUERIES
from tools.oracle_check import TABLES, _close, _rows

from .conftest import SF0001



def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["chunk_id", "split", "n_tokens", "input_ids"]
    assert {r.split for r in rows} == {"train", "val"}
    assert all(r.n_tokens == 1024 for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF0001).toPandas()
    ddf = duck.execute(oracle_sql()[name]).df()
    cols = sorted(sdf.columns)
    assert cols == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    a, b = _rows(sdf, cols), _rows(ddf, cols)
    for x, y in zip(a, b):
        assert all(_close(p, q) for p, q in zip(x, y)), (x, y)
