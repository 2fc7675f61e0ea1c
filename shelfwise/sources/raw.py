"""Reading raw tenant tables and bringing their headers to canonical names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.functions.ids import clean_id, has_id, strip

# fixed values: accepted headers of product tables, first present one wins
PRODUCT_HEADERS = {
    "product_id": ("product_id", "item_id", "stockcode", "id"),
    "product_name": ("product_name", "title", "name", "description"),
    "category": ("category", "product_type"),
}

# fixed values: accepted headers of retail transaction logs
RETAIL_HEADERS = {
    "CustomerID": ("CustomerID", "Customer ID", "Customer_ID", "customer_id", "customerID"),
    "InvoiceNo": ("InvoiceNo", "Invoice", "invoice", "invoice_no"),
    "StockCode": ("StockCode", "stock_code"),
    "Description": ("Description", "description"),
    "Quantity": ("Quantity", "quantity"),
    "UnitPrice": ("UnitPrice", "Price", "price"),
    "Country": ("Country", "country"),
    "InvoiceDate": ("InvoiceDate", "invoice_date"),
}


def read_raw(spark: SparkSession, path: str, kind: str, schema=None, numeric: Iterable[str] = ()) -> DataFrame:
    """Read one declared source; without a schema every CSV column stays text."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        df = reader.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    elif kind == "json":
        df = reader.json(path)
    elif kind in ("parquet", "orc"):
        df = getattr(reader, kind)(path)
    else:
        raise ValueError(f"unsupported data source type '{kind}'")
    return tidy_raw(df, numeric)


def tidy_raw(df: DataFrame, numeric: Iterable[str] = ()) -> DataFrame:
    """Trim the header names and coerce dirty numeric columns (bad values become null)."""
    numeric = set(numeric)
    return df.select(*[
        (strip(F.col(f"`{c}`")).try_cast("double") if c.strip() in numeric else F.col(f"`{c}`")).alias(c.strip())
        for c in df.columns
    ])


def canonical_columns(df: DataFrame, headers: Mapping[str, tuple[str, ...]], ignore_case: bool = False) -> DataFrame:
    """Rename the first present alias of every canonical column; other columns pass through."""
    fold = (lambda s: s.strip().lower()) if ignore_case else (lambda s: s.strip())
    present = {fold(c): c for c in reversed(df.columns)}
    chosen: dict[str, str] = {}
    for target, names in headers.items():
        source = next((present[fold(n)] for n in names if fold(n) in present), None)
        if source is not None and source not in chosen:
            chosen[source] = target
    return df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns])


def sample_ids(df: DataFrame, col: str, n: int) -> DataFrame:
    """The first ``n`` distinct usable ids in id order."""
    ids = df.where(has_id(F.col(col))).select(clean_id(F.col(col)).alias(col)).distinct()
    return ids.orderBy(col).limit(n)
