"""Every query over the smallest driver tables, against its SQL where it has one."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
NAMES = sorted(__spark_entry__.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(plain(tuple(r[c] for c in cols)) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == Counter(plain(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).columns == ["pos", "ref_field", "reason", "period"]
