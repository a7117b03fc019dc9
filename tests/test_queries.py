"""Every registered query runs on the smallest tables and, where it has one, agrees with its oracle."""

import datetime as dt
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TALLYMARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
NAMES = [n for n in entry.plans.QUERIES]


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in entry.plans.ORACLES:
        rel = duck.sql(entry.oracle_sql()[name])
        at = [rel.columns.index(c) for c in columns]
        assert len(at) == len(rel.columns)
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sheet_cells_of_keys_beyond_a_sheets_columns(spark, tmp_path):
    keys = [0, 1, 702, 703, 18278, 18279, 19999, 90_000, 130_481, 899_999, 30_000_000, 45_000_000]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame([(k, f"Customer#{k}") for k in keys], "c_custkey long, c_name string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["sheet_cells"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["sheet_cells"](spark, str(tmp_path)).collect()) == want
