"""Every registered query runs on the smallest tables and agrees with its SQL twin."""

import sys

import duckdb
import pytest

sys.path.insert(0, "tools")

import __spark_entry__ as entry  # noqa: E402
from compare import canonical  # noqa: E402
from shelfwise.plans.roles import TABLES  # noqa: E402

SLOW = {"train_all_tenants", "run_pipeline_all_tenants", "model_tournament", "ranking_fit", "ranking_topk"}  # a minute or more each; test_models.py runs their operators on small tables


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", [k for k in entry.queries() if k not in SLOW])
def test_query(spark, sf, duck, key):
    df = entry.queries()[key](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if key not in entry.oracle_sql():
        assert got
        return
    cur = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
