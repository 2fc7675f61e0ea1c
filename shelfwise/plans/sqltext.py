"""Small DuckDB SQL fragments for the twins."""

from __future__ import annotations


def has_id(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(trim({c})) NOT IN ('', 'nan', 'none', 'null'))"


def clean_id(c: str) -> str:
    return f"coalesce(regexp_replace(trim({c}), '^(-*\\d+)\\.0$', '\\1'), '')"


def nul(c: str) -> str:
    return f"nullif(trim({c}), '')"


def price(c: str) -> str:
    return f"try_cast(nullif(regexp_extract(replace({c}, ',', ''), '[-+]?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)"


ACTIVE = "lower(trim(coalesce(status, 'active'))) = 'active'"
STOCK = "coalesce(try_cast(trunc(try_cast(in_stock AS DOUBLE)) AS INTEGER), 1)"

# active catalogue as a subquery
ACTIVE_SHELF = f"""(SELECT product_id, coalesce({nul('product_name')}, product_id) AS product_name,
    {nul('category')} AS category, {nul('brand')} AS brand, price, {STOCK} AS in_stock, description, image_url, specs, tags, updated_at
    FROM shelf WHERE {ACTIVE})"""

VALID_SALE = (f"{has_id('CustomerID')} AND {has_id('StockCode')} AND {has_id('InvoiceNo')} "
              "AND NOT starts_with(upper(trim(InvoiceNo)), 'C')")

SALES = f"""(SELECT {clean_id('CustomerID')} AS customer_id, {clean_id('StockCode')} AS product_id,
    sum(coalesce(try_cast(Quantity AS DOUBLE), 1.0)) AS weight FROM till WHERE {VALID_SALE} GROUP BY 1, 2)"""

# catalogue upload rows that pass every check
UPLOAD_BASE = f"""(SELECT *, CASE WHEN {has_id('product_id')} THEN trim(product_id) END AS pid, {price('price')} AS pr,
    min(CASE WHEN {has_id('product_id')} THEN row_num END) OVER (PARTITION BY CASE WHEN {has_id('product_id')} THEN trim(product_id) END) AS first_row
    FROM upload)"""
UPLOAD_OK = f"""(SELECT pid AS product_id, trim(product_name) AS product_name, trim(category) AS category, pr AS price, in_stock
    FROM {UPLOAD_BASE} WHERE pid IS NOT NULL AND row_num = first_row AND {nul('product_name')} IS NOT NULL
    AND {nul('category')} IS NOT NULL AND (price IS NULL OR (pr IS NOT NULL AND pr >= 0)))"""
