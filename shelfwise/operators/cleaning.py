"""Row cleaning, schema checks and validation reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.config import Feature
from shelfwise.functions.ids import blank_to_null, clean_id, has_id, strip
from shelfwise.functions.text import clean_price
from shelfwise.operators.keyed import first_per_key, lowest_hashes


def column_violations(df: DataFrame, table: str, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row per broken rule: a required column is absent, or a numeric column holds other text.

    All counts come from one pass over the table.
    """
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    checked = [c for c in numeric if c in df.columns]
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(c) for c in checked]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit("non_numeric").alias("violation"), F.col(c).alias("bad_rows"))
                     for c in checked]) if checked else None
    parts = []
    if checked:
        parts.append(df.agg(*bad).select(F.lit(table).alias("table_name"), F.inline(rows)).where("bad_rows > 0"))
    if missing or not parts:
        parts.append(spark.createDataFrame(
            [(table, c, "missing", 0) for c in missing], "table_name string, column_name string, violation string, bad_rows bigint"))
    return reduce(DataFrame.unionByName, parts)


def value_violations(df: DataFrame, allowed: Mapping[str, Iterable[str]]) -> DataFrame:
    """Distinct non-null values outside the declared ones, per column, with their row counts."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                 F.col(c).cast("string").isin(*[str(v) for v in vals]).alias("known"))
        for c, vals in allowed.items()
    ])))
    return cells.where("value is not null and not known").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def cast_feature(f: Feature) -> Column:
    c = F.col(f"`{f.name}`")
    return (c.cast("string").try_cast("double") if f.dtype == "numeric" else c.cast("string")).alias(f.name)


def coerce_features(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Numeric features to double (bad text to null), categorical ones to text; absent ones are skipped."""
    by_name = {f.name: f for f in features}
    return df.select(*[cast_feature(by_name[c]) if c in by_name else F.col(f"`{c}`") for c in df.columns])


def build_customers(raw: DataFrame, id_column: str, features: Sequence[Feature], order: Sequence[Column]) -> DataFrame:
    """Customer table: usable ids only, first row per id in ingest order, declared features cast."""
    kept = raw.where(has_id(F.col(id_column))).withColumn("customer_id", clean_id(F.col(id_column)))
    first = first_per_key(kept, ["customer_id"], order)
    return first.select("customer_id", *[cast_feature(f) for f in features if f.name in raw.columns])


def is_active(status: str = "status") -> Column:
    return F.lower(strip(F.coalesce(F.col(status), F.lit("active")))) == "active"


def stock_number(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(1))


def active_catalog(catalog: DataFrame, hide_out_of_stock: bool = False) -> DataFrame:
    """Active rows with clean id, name, category, brand, price and stock."""
    df = catalog.where(is_active() & (strip(F.col("product_id")) != ""))
    if hide_out_of_stock:
        df = df.where(stock_number(F.col("in_stock")) != 0)
    pid = strip(F.col("product_id"))
    return df.withColumns({
        "product_name": F.coalesce(blank_to_null(F.col("product_name")), pid),
        "category": blank_to_null(F.col("category")),
        "brand": blank_to_null(F.col("brand")),
        "price": F.col("price").cast("string").try_cast("double"),
        "in_stock": stock_number(F.col("in_stock")),
        "product_id": pid,
    })


def format_catalog_rows(df: DataFrame) -> DataFrame:
    """Type-clean catalogue rows: stock to int (1 when unreadable), price to double, text trimmed."""
    def column(c: str) -> Column:
        v = F.col(c)
        if c == "in_stock":
            return F.when(v.isNotNull(), stock_number(v)).alias(c)
        if c == "price":
            return v.cast("string").try_cast("double").alias(c)
        return strip(v).alias(c)

    return df.select(*[column(c) for c in df.columns])


def catalog_search(catalog: DataFrame, text: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    """Filter by status, category and a case-insensitive part of id, name, description, brand or category."""
    df = catalog
    if status and status.strip():
        df = df.where(F.lower("status") == status.strip().lower())
    if category and category.strip():
        df = df.where(F.lower("category") == category.strip().lower())
    if text and text.strip():
        q = F.lit(text.strip().lower())
        hits = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
                for c in ("product_id", "product_name", "description", "brand", "category")]
        df = df.where(reduce(lambda a, b: a | b, hits))
    return df


def in_price_band(target: Column, candidate: Column, ratio: float) -> Column:
    """Candidate price unknown, or within [target / ratio, target * ratio]; ratio <= 0 switches it off."""
    if ratio <= 0:
        return F.lit(True)
    t, c = F.coalesce(target, F.lit(0.0)), F.coalesce(candidate, F.lit(0.0))
    return (t <= 0) | (c <= 0) | c.between(t / ratio, t * ratio)


def in_year(df: DataFrame, col: str, year: int) -> DataFrame:
    """Rows of one calendar year; text that is not a date is dropped."""
    return df.where(F.year(F.try_to_timestamp(F.col(col).cast("string"))) == year)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows chosen by a hash of seed and key, the same for every partitioning."""
    return lowest_hashes(df, [F.col(c).cast("string") for c in key], key, n, seed)


def upload_rows(rows: DataFrame) -> DataFrame:
    """Offered catalogue rows with an ``errors`` array and the cleaned values.

    Row numbers come with the file (2 is the first data row).  The first row of an id is found by an
    aggregate, so a much repeated id is combined before the shuffle.
    """
    pid = F.when(has_id(F.col("product_id")), strip(F.col("product_id")))
    base = rows.withColumns({"_pid": pid, "_price": clean_price(F.col("price"))})
    firsts = base.where("_pid is not null").groupBy("_pid").agg(F.min("row_num").alias("_first"))
    raw_price = F.col("price").cast("string")
    errors = F.array_compact(F.array(
        F.when(F.col("product_id").isNull(), "Missing required column 'product_id'")
        .when(F.col("_pid").isNull(), "product_id cannot be empty"),
        F.when(F.col("row_num") > F.col("_first"),
               F.concat(F.lit("Duplicate product_id '"), F.col("_pid"), F.lit("' in file (first seen on row "),
                        F.col("_first").cast("string"), F.lit(")"))),
        F.when(blank_to_null(F.col("product_name")).isNull(), "Missing required column 'product_name'"),
        F.when(blank_to_null(F.col("category")).isNull(), "Missing required column 'category'"),
        F.when(raw_price.isNotNull() & F.col("_price").isNull(),
               F.concat(F.lit("Invalid price '"), raw_price, F.lit("': must be a numeric value")))
        .when(F.col("_price") < 0, F.concat(F.lit("Invalid price '"), raw_price, F.lit("': must be non-negative (>= 0)"))),
    ))
    return (
        base.join(firsts, "_pid", "left")
        .withColumn("errors", errors)
        .withColumns({"product_id": F.col("_pid"), "product_name": strip(F.col("product_name")),
                      "category": strip(F.col("category")), "price": F.col("_price")})
        .drop("_pid", "_price", "_first")
    )


def valid_upload(rows: DataFrame) -> DataFrame:
    return upload_rows(rows).where(F.size("errors") == 0).drop("errors")


def upload_errors(rows: DataFrame) -> DataFrame:
    return upload_rows(rows).select("row_num", F.explode("errors").alias("message"))
