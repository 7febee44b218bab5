"""Each query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docsift.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def shown(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(shown(v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([[r[c] for c in columns] for r in got.collect()]) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_lines_are_spread_by_their_number(spark, monkeypatch):
    """However many lines there are, a task gets about ``TASK_ROWS``; an order's lines meet in one, and results stay as they are."""
    if not Path(DATA).exists():
        pytest.skip("no test data")
    few = catalog.table(spark, DATA, "lineitem")
    before = catalog.q36_stability(spark, DATA).collect()
    monkeypatch.setattr(catalog, "TASK_ROWS", 500)
    many = catalog.table(spark, DATA, "lineitem")
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0
    assert many.groupBy(F.spark_partition_id().alias("p"), "l_orderkey").count().groupBy("l_orderkey").count().where("count > 1").count() == 0
    assert catalog.q36_stability(spark, DATA).collect() == before
