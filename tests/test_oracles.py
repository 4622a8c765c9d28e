"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import plans  # noqa: F401
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, views, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert mine
        return
    cursor = views.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs
