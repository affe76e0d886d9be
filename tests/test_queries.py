"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import importlib
import math
import os

import duckdb
import pytest

from litforge.plans import registry

for _m in ("connectors", "descriptive", "extras", "linking", "statistics", "texts"):
    importlib.import_module(f"litforge.plans.{_m}")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(frame, columns):
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.SQL:
        assert len(got) and not got.isna().all().any()
        return
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
