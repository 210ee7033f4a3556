"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidelog import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = plain(catalog.QUERIES[name](spark, DATA).toPandas())
    if name in catalog.ORACLES:
        assert got == plain(duck.sql(catalog.ORACLES[name]).df())
    else:
        assert got[1]


def test_no_query_leaves_rows_out_by_a_number():
    assert not {"kv_put_merge", "kv_sequence", "kv_key_compare"} & set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["k", "seq", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["kv_put_merge_all", "kv_sequence_all"])
def test_whole_customer_table_is_the_batch(spark, duck, name):
    got = {r["k"] for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert got >= {r[0] for r in duck.sql("select cast(c_custkey as varchar) from customer").fetchall()}


def test_every_user_is_compared(spark, duck):
    got = sorted(r["one"] for r in catalog.QUERIES["kv_key_compare_all"](spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(r[0] for r in duck.sql("select distinct user_id from '/root/testdata/sf0.01/events.parquet'").fetchall())
