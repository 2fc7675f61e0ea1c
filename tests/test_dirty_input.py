"""Values that ANSI casts would stop the job for."""

from pyspark.sql import functions as F

from shelfwise.operators import catalog, cleaning, ingest

SCHEMA = "product_id string, product_name string, category string, brand string, status string, price string, in_stock string, description string, created_at string, updated_at string"
DIRTY = [("1", "a", "c", "b", "active", "N/A", "nan", "", "x", "x"), ("2", "b", "c", "b", "active", "3.5", "1e12", "", "x", "x"),
         ("3", "c", "c", "b", "active", None, "1.0", "", "x", "x"), ("4", "d", "c", "b", "active", "nan", None, "", "x", "x")]


def test_active_catalog(make):
    got = {r.product_id: r for r in cleaning.active_catalog(make(SCHEMA, *DIRTY)).collect()}
    assert [got[k].in_stock for k in "1234"] == [1, 1, 1, 1]
    assert [got[k].price for k in "123"] == [None, 3.5, None]


def test_format_and_seed(make):
    rows = make(SCHEMA, *DIRTY)
    assert {r.product_id: r.in_stock for r in cleaning.format_catalog_rows(rows).collect()} == {"1": 1, "2": 1, "3": 1, "4": None}
    seeded = ingest.seed_catalog(rows, [F.col("product_id")], F.lit("now")).collect()
    assert {r.product_id: r.in_stock for r in seeded} == {"1": 1, "2": 1, "3": 1, "4": 1}


def test_commit_keeps_untouched_stock(make):
    new = make("product_id string, product_name string, category string, in_stock string", ("1", "n", "c", "2.0"))
    got = {r.product_id: r.in_stock for r in catalog.commit_upload(make(SCHEMA, *DIRTY), new, F.lit("now")).collect()}
    assert got == {"1": 2, "2": None, "3": 1, "4": None}
