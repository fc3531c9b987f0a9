import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    names = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, len(QUERIES) + 1))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = db.execute(ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    rows = sorted(map(tuple, df.select(*columns).collect()))
    at = [[x[0] for x in want.description].index(c) for c in columns]
    assert rows == sorted(tuple(r[k] for k in at) for r in want.fetchall())
