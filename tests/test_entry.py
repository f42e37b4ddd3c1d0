"""The registered queries against their SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "page_url", "change_kind"]


def one(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return str(v) if isinstance(v, (list, dict)) else v


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(zip(*[[one(v) for v in table.column(n).to_pylist()] for n in names]))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = rows(entry.queries()[name](spark, SF).toArrow())
    want = rows(con.sql(entry.oracle_sql()[name]).to_arrow_table())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()
