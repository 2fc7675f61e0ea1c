import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfwise.config import Feature, ServiceColumns, Tenant, TransactionColumns, tenant_from_dict
from shelfwise.operators import cleaning, ingest
from shelfwise.plans.adapters import DeclaredAdapter
from shelfwise.sources import raw

TILL = TransactionColumns("CustomerID", "StockCode", "Quantity", "InvoiceNo", "Description", ("C",))
SCHEMA = "InvoiceNo string, CustomerID string, StockCode string, Quantity string"


def test_transactions(make):
    df = make(SCHEMA, ("INV001", "CUST_1", "PROD_A", "2"), ("INV002", "CUST_1", "PROD_A", "3"), ("INV001", "CUST_1", "PROD_B", "1"),
              ("INV003", "CUST_2", "PROD_A", "5"), ("C0001", "CUST_1", "PROD_A", "9"), ("c0002", "CUST_2", "PROD_B", "9"),
              (None, "CUST_1", "PROD_A", "9"), ("INV4", None, "PROD_A", "9"), ("INV4", "CUST_1", None, "9"))
    want = [("CUST_1", "PROD_A", 5.0), ("CUST_1", "PROD_B", 1.0), ("CUST_2", "PROD_A", 5.0)]
    assert rows(ingest.sale_interactions(df, TILL)) == want
    pairs = ingest.sale_interactions(df, TransactionColumns("CustomerID", "StockCode", None, "InvoiceNo", None, ("C",)))
    assert rows(pairs) == [w[:2] for w in want]


def test_id_normalisation_and_bad_quantity(make):
    df = make(SCHEMA, ("I1", "17850.0", "P", "2"), ("I2", "17850", "P", "4"), ("I3", "1", "P", "many"))
    assert rows(ingest.sale_interactions(df, TILL)) == [("1", "P", 1.0), ("17850", "P", 6.0)]


def test_product_names(make):
    df = make("StockCode string, Description string", ("85123A", "HOLDER"), ("85123A", "HOLDER"), ("85123A", " HOLDER "), ("85123A", "holder"),
              ("71053", "LANTERN"), ("71053", "LANTERN"), ("71053", "lantern"), ("POST", None), ("POST", " "), (None, "x"))
    assert rows(ingest.sale_products(df, "StockCode", "Description")) == [("71053", "LANTERN"), ("85123A", "HOLDER"), ("POST", "POST")]


def test_services(make):
    services = ServiceColumns(("PhoneService", "StreamingTV"), ("No", "No internet service"), multi_value=ingest.INTERNET_VALUES)
    df = make("customerID string, PhoneService string, StreamingTV string, InternetService string", ("c1", "Yes", "No internet service", "DSL"),
              ("c2", None, "Yes", "Fiber optic"), ("nan", "Yes", "Yes", "DSL"), ("c3", "No", "No", "No"))
    assert rows(ingest.service_interactions(df, "customerID", services)) == [
        ("c1", "InternetService_DSL"), ("c1", "PhoneService"), ("c2", "InternetService_Fiber"), ("c2", "PhoneService"), ("c2", "StreamingTV")]
    strict = ServiceColumns(("PhoneService",), ("No",), null_is_positive=False)
    assert rows(ingest.flag_interactions(df, "customerID", strict)) == [("c1", "PhoneService")]
    assert ("PhoneService", "Phone Service", "Core") in rows(ingest.service_products(df, services))


def test_read_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" id , charges \n1,20.5\n2, \n")
    got = raw.read_raw(spark, str(tmp_path / "a.csv"), "csv", numeric=["charges"])
    assert got.columns == ["id", "charges"] and rows(got.fillna(-1.0)) == [("1", 20.5), ("2", -1.0)]
    (tmp_path / "b.json").write_text('{"id": "1", "v": 2}\n{"id": "2", "v": 3}\n')
    assert raw.read_raw(spark, str(tmp_path / "b.json"), "json", "id string, v int").count() == 2
    with pytest.raises(ValueError):
        raw.read_raw(spark, "x", "xlsx")


def test_header_aliases(make):
    df = make("StockCode string, Title string, product_type string, other int", ("1", "n", "c", 5))
    assert raw.canonical_columns(df, raw.PRODUCT_HEADERS, ignore_case=True).columns == ["product_id", "product_name", "category", "other"]


def test_adapter_validates(make):
    df = make(SCHEMA + ", Description string", ("I1", "1", "P", "2", "Pen"))
    tenant = Tenant("t", "CustomerID", (), transactions=TILL)
    assert rows(DeclaredAdapter(tenant, df).run().counts()) == [("customers", 1), ("interactions", 1), ("products", 1)]
    bad = cleaning.column_violations(make("a string", "x", "1"), "t", ["id"], ["a"])
    assert rows(bad) == [("t", "a", "non_numeric", 1), ("t", "id", "missing", 0)]


def test_config():
    t = tenant_from_dict("t", {"customers": {"id_column": "u", "features": [{"name": "a", "dtype": "categorical", "allowed_values": [1, 2], "encoding": "one_hot"}]},
                               "interactions": {"source": "transactional", "customer_id_column": "u", "product_id_column": "p", "exclude_invoice_prefix": "C"}})
    assert t.features == (Feature("a", "categorical", ("1", "2"), "one_hot"),) and t.transactions.cancel_prefixes == ("C",)
    with pytest.raises(ValueError):
        Feature("a", "date")


def test_upload_errors(make):
    df = make("row_num int, product_id string, product_name string, category string, price string, in_stock string",
              (2, "VAL-1", "a", "c", "1", None), (3, "VAL-2", "a", None, "1", None), (4, "VAL-3", "a", "c", "-5", None),
              (5, "VAL-1", "a", "c", "1", None), (6, None, "a", "c", "1", None))
    assert sorted({r[0] for r in rows(cleaning.upload_errors(df))}) == [3, 4, 5, 6]
    assert "first seen on row 2" in [r for r in rows(cleaning.upload_errors(df)) if r[0] == 5][0][1]
    assert rows(cleaning.valid_upload(df), "product_id") == [("VAL-1",)]


def test_seed(make):
    df = make("seq int, product_id string, product_name string, title string, category string", (1, "P101", "Phone", None, "Mobile"),
              (2, "P102", None, "Cable", None), (3, "P101", "Later", None, "x"), (4, " ", "x", None, None))
    got = ingest.seed_catalog(df, [F.col("seq")], F.lit("now"))
    assert rows(got, "product_id", "product_name", "category", "status", "in_stock") == [
        ("P101", "Phone", "Mobile", "active", 1), ("P102", "Cable", "General", "active", 1)]
