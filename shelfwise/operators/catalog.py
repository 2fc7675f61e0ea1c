"""Catalogue maintenance as table-level jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.ids import blank_to_null, strip
from shelfwise.functions.text import clean_price
from shelfwise.operators.cleaning import is_active, stock_number
from shelfwise.operators.keyed import first_per_key, global_rank

STANDARD_COLUMNS = ("product_id", "product_name", "category", "status", "brand", "price", "in_stock", "description",
                    "image_url", "product_url", "created_at", "updated_at")


def feed_upsert(existing: DataFrame, feed: DataFrame, order: Column, mode: str = "upsert") -> DataFrame:
    """Whole-row replace by product id: untouched rows plus the feed's last row per id."""
    if mode not in ("upsert", "replace"):
        raise ValueError("mode must be upsert or replace")
    last = first_per_key(feed.withColumn("product_id", strip(F.col("product_id"))).withColumn("_o", order), ["product_id"], [F.col("_o").desc()]).drop("_o")
    if mode == "replace":
        return last
    old = existing.withColumn("product_id", strip(F.col("product_id")))
    untouched = old.join(last.select("product_id"), "product_id", "left_anti")
    out = untouched.unionByName(last, allowMissingColumns=True)
    return out.select("product_id", "product_name", *[c for c in out.columns if c not in ("product_id", "product_name")])


def feed_counts(existing: DataFrame, feed: DataFrame) -> DataFrame:
    """fetched / updated / added / total of an upsert."""
    ids = feed.select(strip(F.col("product_id")).alias("product_id")).groupBy("product_id").agg(F.count("*").alias("n"))
    old = existing.select(strip(F.col("product_id")).alias("product_id"), F.lit(True).alias("old")).distinct()
    both = ids.join(old, "product_id", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.count_if(F.col("n").isNotNull() & F.col("old").isNotNull()).alias("updated"),
        F.count_if(F.col("n").isNotNull() & F.col("old").isNull()).alias("added"), F.count("*").alias("total"))


def upload_diff(catalog: DataFrame, rows: DataFrame, replace: bool = False) -> DataFrame:
    """How many ids an upload would add, update and (in replace mode) archive."""
    ids = rows.select("product_id").distinct().withColumn("new", F.lit(True))
    both = catalog.select("product_id", (F.lower("status") == "active").alias("was_active")).join(ids, "product_id", "full")
    gone = F.col("new").isNull() & F.col("was_active") if replace else F.lit(False)
    return both.agg(
        F.count_if(F.col("was_active").isNull()).alias("to_add"),
        F.count_if(F.col("was_active").isNotNull() & F.col("new").isNotNull()).alias("to_update"),
        F.count_if(gone).alias("to_archive"))


def commit_upload(catalog: DataFrame, rows: DataFrame, now: Column, replace: bool = False) -> DataFrame:
    """Apply valid upload rows: a row replaces the whole old row but keeps its ``created_at``.

    In replace mode active products absent from the file are archived, never deleted.
    """
    new = rows.withColumns({
        "status": F.coalesce(F.col("status").cast("string"), F.lit("active")) if "status" in rows.columns else F.lit("active"),
        "in_stock": stock_number(F.col("in_stock")) if "in_stock" in rows.columns else F.lit(1),
    }).select(F.struct("*").alias("new"), F.col("product_id"))
    old = catalog.select(F.struct("*").alias("old"), F.col("product_id"))
    both = old.join(new, "product_id", "full")
    has_new, has_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    archive = ~has_new & (F.lower("old.status") == "active") if replace else F.lit(False)
    new_cols = set(rows.columns) | {"status", "in_stock"}

    def column(c: str) -> Column:
        if c == "product_id":
            return F.col("product_id")
        old_v = F.col(f"old.`{c}`") if c in catalog.columns else F.lit(None)
        if c == "created_at":
            return F.when(has_old, old_v).otherwise(now).alias(c)
        if c == "updated_at":
            return F.when(has_new | archive, now).otherwise(old_v).alias(c)
        new_v = F.col(f"new.`{c}`") if c in new_cols else F.lit(None)
        if c == "in_stock":
            old_v = old_v.cast("string").try_cast("double").try_cast("int")
        if c == "status":
            old_v = F.when(archive, "archived").otherwise(old_v)
        return F.when(has_new, new_v).otherwise(old_v).alias(c)

    names = list(catalog.columns) + sorted(new_cols - set(catalog.columns))
    return both.select(*[column(c) for c in names])


def bulk_status(catalog: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """Set the status of listed ids; ``affected`` marks the changed rows."""
    if status not in ("active", "archived"):
        raise ValueError("status must be active or archived")
    listed = ids.select(strip(F.col("product_id")).alias("product_id")).distinct().withColumn("affected", F.lit(True))
    df = catalog.join(listed, "product_id", "left").withColumn("affected", F.coalesce("affected", F.lit(False)))
    return df.withColumns({"status": F.when(F.col("affected"), status).otherwise(F.col("status")),
                           "updated_at": F.when(F.col("affected"), now).otherwise(F.col("updated_at"))})


def bulk_delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove listed ids that are already archived; active ones stay."""
    doomed = catalog.where(F.lower("status") == "archived").join(
        ids.select(strip(F.col("product_id")).alias("product_id")), "product_id", "left_semi").select("product_id")
    return catalog.join(doomed, "product_id", "left_anti")


def change_outcomes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome and reason of every single-product change.

    ``changes`` holds one row per product: action (create, update, archive, delete, restore) and the
    offered product_name, category, price text and status; null means "not given", except for create.
    """
    known = catalog.select("product_id", F.lower(strip(F.col("status"))).alias("now_status"))
    df = changes.withColumn("product_id", strip(F.col("product_id"))).join(known, "product_id", "left")
    price = clean_price(F.col("price"))
    bad_price = F.col("price").isNotNull() & (price.isNull() | (price < 0))
    blank = {c: blank_to_null(F.col(c)).isNull() for c in ("product_name", "category")}
    exists, create, update = F.col("now_status").isNotNull(), F.col("action") == "create", F.col("action") == "update"
    reason = (
        F.when(create & (F.coalesce(F.col("product_id"), F.lit("")) == ""), "missing product_id")
        .when(create & blank["product_name"], "blank product_name")
        .when(create & blank["category"], "blank category")
        .when(create & bad_price, "invalid price")
        .when(create & exists, "duplicate")
        .when(~create & ~exists, "not found")
        .when(update & F.col("product_name").isNotNull() & blank["product_name"], "blank product_name")
        .when(update & F.col("category").isNotNull() & blank["category"], "blank category")
        .when(update & bad_price, "invalid price")
        .when(update & F.col("status").isNotNull() & ~F.lower(strip(F.col("status"))).isin("active", "archived"), "invalid status")
        .when((F.col("action") == "delete") & (F.col("now_status") != "archived"), "active product")
        .when(~F.col("action").isin("create", "update", "archive", "delete", "restore"), "unknown action")
    )
    return df.withColumns({"reason": reason, "clean_price": price}).withColumn(
        "outcome", F.when(F.col("reason").isNull(), "applied").otherwise("rejected"))


def apply_changes(catalog: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The catalogue after all accepted changes."""
    ok = change_outcomes(catalog, changes).where("outcome = 'applied'").select(
        "product_id", F.struct("action", strip(F.col("product_name")).alias("product_name"), strip(F.col("category")).alias("category"),
                               F.lower(strip(F.col("status"))).alias("status"), F.col("clean_price").alias("price")).alias("ch"))
    df = catalog.withColumn("_old", F.lit(True)).join(ok, "product_id", "full").where(~F.col("ch.action").eqNullSafe("delete"))
    status = (F.when(F.col("ch.action") == "archive", "archived").when(F.col("ch.action").isin("restore", "create"), "active")
              .otherwise(F.coalesce("ch.status", "status")))
    return df.withColumns({
        "product_name": F.coalesce("ch.product_name", "product_name"), "category": F.coalesce("ch.category", "category"),
        "price": F.coalesce("ch.price", "price"), "status": status,
        "in_stock": F.when(F.col("_old").isNull(), "1").otherwise(F.col("in_stock").cast("string")),
        "created_at": F.when(F.col("_old").isNull(), now).otherwise(F.col("created_at")),
        "updated_at": F.when(F.col("ch").isNotNull(), now).otherwise(F.col("updated_at")),
    }).select(*catalog.columns)


def summary(catalog: DataFrame, trained: DataFrame, last_trained: Column) -> DataFrame:
    """Active, archived and out-of-stock counts; products added or changed since the last training."""
    active, archived = F.lower("status") == "active", F.lower("status") == "archived"
    df = catalog.join(trained.select("product_id", F.lit(True).alias("seen")).distinct(), "product_id", "left")
    return df.agg(
        F.count_if(active).alias("active"), F.count_if(archived).alias("archived"),
        F.count_if(active & (stock_number(F.col("in_stock")) == 0)).alias("out_of_stock"),
        F.count_if(active & F.col("seen").isNull()).alias("added_since"),
        F.count_if(active & F.col("seen") & (F.coalesce("updated_at", F.lit("")) > last_trained)).alias("changed_since"))


def by_category(catalog: DataFrame) -> DataFrame:
    return catalog.where(is_active()).groupBy(F.coalesce("category", F.lit("nan")).alias("category")).agg(F.count("*").alias("n"))


def page(catalog: DataFrame, number: int, size: int, order: str = "product_id") -> DataFrame:
    """One page of the ordered catalogue, equal values by id; page size is kept in 1..100 and the number in 1..total_pages.

    Rows are numbered over the whole range-partitioned order, so a deep page costs no more than a first one.
    """
    total = catalog.count()
    size = max(1, min(100, size))
    pages = -(-total // size)
    number = max(1, min(number, pages)) if pages else 1
    start = (number - 1) * size
    keys = [F.col(c).asc() for c in dict.fromkeys((order, "product_id"))]
    rows = global_rank(catalog, keys, "_at").where(F.col("_at").between(start + 1, start + size)).drop("_at")
    return rows.withColumns({"total": F.lit(total), "total_pages": F.lit(pages), "page": F.lit(number)})


def training_products(catalog: DataFrame, columns: tuple[str, ...] = ("product_id", "product_name", "category", "brand", "price")) -> DataFrame:
    """Active products offered to training; fewer than two is an error."""
    active = catalog.where(is_active())
    if active.limit(2).count() < 2:
        raise ValueError("at least 2 active products are needed for training")
    return active.select(*[c for c in columns if c in catalog.columns])
