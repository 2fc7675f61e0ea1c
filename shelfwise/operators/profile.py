"""Column profiles of unknown raw tables: one aggregation pass, then rules over one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from shelfwise.functions.ids import strip

# fixed values: parts of column names that hint at a meaning
ID_HINTS = ("id", "_id", "customerid", "user", "key")
NUMERIC_HINTS = ("amount", "price", "charge", "charges", "fee", "cost", "total", "count", "rate", "score", "tenure", "age",
                 "salary", "revenue", "qty", "quantity", "balance", "num", "pct", "percent")
DATE_HINTS = ("date", "time", "timestamp", "year", "month", "day", "created", "updated")
CATEGORY_HINTS = ("type", "category", "status", "class", "segment", "method", "contract", "gender", "plan", "code", "tier", "mode")
BINARY_TOKENS = ("yes", "no", "true", "false", "1", "0", "y", "n", "t", "f")

# fixed values: name parts behind the column roles of a transaction log
PRODUCT_WORDS = ("stock", "product", "item", "sku", "asin", "article")
INVOICE_WORDS = ("invoice", "transaction", "order", "receipt")
NAME_WORDS = ("description", "product_name", "productname", "title", "name")
QUANTITY_WORDS = ("quantity", "qty", "units", "count")
CUSTOMER_WORDS = ("customer", "user", "client", "member", "account", "buyer", "shopper")
EXCLUDED_WORDS = ("date", "time", "price", "unitprice", "cost", "total")

MAX_CATEGORIES = 50


def _names(c: Column, words: Sequence[str]) -> Column:
    return F.rlike(F.lower(c), F.lit("|".join(words)))


def column_stats(df: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values and numeric parses of every column.

    The table is scanned once.  Cells are combined to distinct (column, value) counts first, in every
    task, and only those counts are shuffled; hot values therefore cost nothing extra.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(c in numeric).alias("typed"),
                 F.col(f"`{c}`").cast("string").alias("value"))
        for i, c in enumerate(df.columns)])))
    return values_stats(cells.groupBy("position", "column_name", "typed", "value").agg(F.count("*").alias("n")))


def values_stats(values: DataFrame, *keys: str) -> DataFrame:
    """Statistics per column from distinct-value counts."""
    number = F.col("value").try_cast("double")
    parses = F.col("value").isNotNull() & (F.col("typed") | (number.isNotNull() & ~F.isnan(number)))
    binary = F.lower(strip(F.col("value"))).isin(*BINARY_TOKENS)
    g = values.groupBy(*keys, "position", "column_name").agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"), F.coalesce(F.sum(F.when(parses, F.col("n"))), F.lit(0)).alias("parsed"),
        F.coalesce(F.max(binary), F.lit(False)).alias("has_binary"))
    present = F.col("total_rows") - F.col("null_count")
    return g.withColumns({
        "null_percentage": F.col("null_count") / F.col("total_rows") * 100,
        "parse_rate": F.when(present > 0, F.col("parsed") / present).otherwise(0.0),
        "uniqueness": F.col("unique_count") / F.col("total_rows"),
        "present": present,
    })


def with_dtype(stats: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("present") == 0, "categorical").when(F.col("parse_rate") > 0.95, "numeric")
        .when(F.col("unique_count") <= MAX_CATEGORIES, "categorical").otherwise("likely_free_text_or_id"))
    return stats.withColumn("suggested_dtype", kind)


def with_flags(stats: DataFrame) -> DataFrame:
    name = F.col("column_name")
    return stats.withColumns({
        "is_id_column": (F.col("uniqueness") > 0.98) & _names(name, ID_HINTS),
        "is_binary_service": F.col("unique_count").isin(2, 3) & F.col("has_binary"),
    })


def with_confidence(flags: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score, review mark and reason of every inference."""
    name, kind = F.col("column_name"), F.col("suggested_dtype")
    uniques, rate, unique = F.col("unique_count"), F.col("parse_rate"), F.col("uniqueness")
    numeric = kind == "numeric"
    id_hint = _names(name, ID_HINTS)
    score = (
        F.when(F.col("present") == 0, 0.0)
        .when(numeric & uniques.between(2, 4), 0.5).when(numeric & (rate < 0.98), 0.55)
        .when(numeric & (_names(name, NUMERIC_HINTS) | _names(name, DATE_HINTS)), 0.95).when(numeric, 0.8)
        .when(F.col("is_id_column"), 0.95).when((unique > 0.95) & ~id_hint, 0.5)
        .when((kind == "categorical") & F.col("is_binary_service"), 0.95)
        .when((kind == "categorical") & _names(name, CATEGORY_HINTS), 0.9).when(kind == "categorical", 0.8).otherwise(0.75))

    def one_digit(c: Column) -> Column:
        return F.format_string("%.1f", c)

    text = (
        F.when(F.col("present") == 0, "Column contains only null values — unable to reliably infer data type.")
        .when(numeric & uniques.between(2, 4), F.concat(
            F.lit("Only "), uniques.cast("string"),
            F.lit(" distinct numeric values found — this might be a category coded as numbers, not a true numeric feature.")))
        .when(numeric & (rate < 0.98), F.concat(one_digit((1 - rate) * 100), F.lit(
            "% of non-null values failed numeric parsing — verify if column is truly numeric or dirty categorical data.")))
        .when(~numeric & ~F.col("is_id_column") & (unique > 0.95) & ~id_hint, F.concat(
            F.lit("High uniqueness ("), one_digit(unique * 100),
            F.lit("%) but column name lacks clear ID naming hints — could be a primary key or high-cardinality categorical feature."))))
    scored = flags.withColumn("confidence", score).withColumn("needs_review", F.col("confidence") < threshold)
    generic = F.concat(
        F.lit("Confidence score ("), F.format_string("%.2f", F.col("confidence")), F.lit(") is below threshold ("),
        F.format_string("%.2f", F.lit(threshold)),
        F.lit(") — data supports inference but column name lacks specific pattern hints."))
    return scored.withColumn("review_reason", F.when(F.col("needs_review"), F.coalesce(text, generic)))


def profile(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return with_confidence(with_flags(with_dtype(column_stats(df))), threshold)


def distinct_values(df: DataFrame) -> DataFrame:
    """(column_name, value) of columns inferred as categorical, at most MAX_CATEGORIES each by rule."""
    kinds = with_dtype(column_stats(df)).where("suggested_dtype = 'categorical'").select("column_name")
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])))
    return cells.where("value is not null").distinct().join(F.broadcast(kinds), "column_name", "left_semi")  # one row per column


def column_roles(profiles: DataFrame, table: str = "table_name") -> DataFrame:
    """Role of every profiled column and the layout of its table.

    ``profiles`` holds one row per table and column, so the windows below are as long as a table is
    wide.  The first matching column by position takes a role.
    """
    name = F.col("column_name")
    w = W.partitionBy(table)

    def first(flag: Column) -> Column:
        """Position of the first flagged column of the table."""
        return F.min(F.when(flag, F.col("position"))).over(w)

    named = _names(name, ("id",)) & (F.col("unique_count") > 1)
    most = F.max_by("position", F.struct(F.col("unique_count"), -F.col("position"))).over(w)
    df = profiles.withColumn("_id", F.coalesce(first(F.col("is_id_column")), first(named), most))
    usable = (F.col("position") != F.col("_id")) & (F.col("null_percentage") < 99)
    df = df.withColumns({
        "_product": first(usable & _names(name, PRODUCT_WORDS)), "_invoice": first(usable & _names(name, INVOICE_WORDS)),
        "_name": first(usable & _names(name, NAME_WORDS)), "_quantity": first(usable & _names(name, QUANTITY_WORDS)),
        "_customer": first(_names(name, CUSTOMER_WORDS) & (F.col("null_percentage") < 99)),
        "_services": F.count_if(F.col("is_binary_service") & (F.col("position") != F.col("_id"))).over(w),
    })
    sales = F.col("_product").isNotNull() & (F.col("_invoice").isNotNull() | F.col("_quantity").isNotNull() | (F.col("_services") == 0))
    moved = F.col("_customer").isNotNull() & (F.col("_customer") != F.col("_id"))
    df = df.withColumn("layout", F.when(sales, "transactional").otherwise("services")).withColumns({
        # an explicit customer column takes over; the former id column then stands in for a missing invoice
        "_invoice": F.when(sales & moved, F.coalesce("_invoice", "_id")).otherwise(F.col("_invoice")),
        "_id": F.when(sales, F.coalesce("_customer", "_id")).otherwise(F.col("_id")),
    })
    at = F.col("position")
    role = (
        F.when(at == F.col("_id"), "customer_id")
        .when((F.col("layout") == "transactional") & (at == F.col("_product")), "product_id")
        .when((F.col("layout") == "transactional") & (at == F.col("_name")), "description")
        .when((F.col("layout") == "transactional") & (at == F.col("_invoice")), "invoice")
        .when((F.col("layout") == "transactional") & (at == F.col("_quantity")), "quantity")
        .when((F.col("layout") == "transactional") & (_names(name, EXCLUDED_WORDS) | (F.col("null_percentage") >= 99)), "excluded")
        .when((F.col("layout") == "services") & F.col("is_binary_service"), "service")
        .otherwise("feature"))
    return df.select(table, "position", "column_name", "layout", role.alias("role"))


def describe(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max of numbers; distinct values, top value and its frequency of texts."""
    schema = "column_name string, n bigint, mean double, std double, min double, max double, uniques bigint, top string, freq bigint"
    fields = T._parse_datatype_string(schema).fields
    stats = df.agg(*[f(F.col(c)).alias(f"{c}_{k}") for c in numeric for k, f in (
        ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    out = stats.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"), F.round(f"{c}_mean", 4).alias("mean"), F.round(f"{c}_std", 4).alias("std"),
        F.col(f"{c}_min").cast("double").alias("min"), F.col(f"{c}_max").cast("double").alias("max"),
        F.lit(None).cast("bigint").alias("uniques"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"))
        for c in numeric])))
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in categorical])))
    counts = cells.where("v is not null").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    texts = counts.groupBy("column_name").agg(F.sum("n").alias("n"), F.count("*").alias("uniques"),
                                              F.min(F.struct((-F.col("n")).alias("m"), F.col("v"))).alias("best"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name in ("mean", "std", "min", "max")]
    return out.unionByName(texts.select("column_name", "n", *missing, "uniques", F.col("best.v").alias("top"), (-F.col("best.m")).alias("freq")))
