"""Every registered query against its SQL, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    assert all(t.split("<")[0] not in ("array", "map", "struct") for _, t in frame.dtypes), "flat columns"
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    found = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "property", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_only_what_it_needs(spark):
    plan = catalog.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "Python" not in plan and "Join" not in plan


def test_a_latest_zero_stays_zero(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(0, day(1), 1, "view", 5.0), (1, day(2), 1, "view", 0.0), (2, day(1), 2, "view", 0.0), (3, day(2), 2, "view", 7.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("lww_plugin", "lww_latest"):
        got = {(r.entity_id, r.value) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {("user-1", 0.0), ("user-2", 7.0)}
