"""Raw tables to customers, products and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.config import ServiceColumns, TransactionColumns
from shelfwise.functions.ids import blank_to_null, clean_id, has_id, strip
from shelfwise.functions.text import humanize
from shelfwise.functions.values import rounded
from shelfwise.operators.keyed import first_per_key

# fixed values: service columns whose products are core products
CORE_SERVICES = ("PhoneService", "MultipleLines")
# fixed values: the products behind the multi-valued internet column
INTERNET_VALUES = {("InternetService", "DSL"): "InternetService_DSL",
                   ("InternetService", "Fiber optic"): "InternetService_Fiber"}
INTERNET_PRODUCTS = (("InternetService_DSL", "Internet - DSL", "Core"),
                     ("InternetService_Fiber", "Internet - Fiber Optic", "Core"))


def flag_interactions(raw: DataFrame, id_column: str, services: ServiceColumns) -> DataFrame:
    """Wide yes/no columns to (customer, product) rows: every value that is not a declared negative."""
    ids = raw.where(has_id(F.col(id_column))).withColumn("customer_id", clean_id(F.col(id_column)))
    cells = ids.select("customer_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("product_id"), F.col(f"`{c}`").cast("string").alias("value")) for c in services.flags])))
    known = F.col("value").isin(*services.negatives)
    keep = F.coalesce(~known, F.lit(services.null_is_positive))
    return cells.where(keep).select("customer_id", "product_id")


def multi_value_interactions(raw: DataFrame, id_column: str, services: ServiceColumns) -> DataFrame:
    """Columns with several positive values: each (column, value) names its own product."""
    columns = sorted({c for c, _ in services.multi_value})
    table = F.create_map(*[F.lit(x) for (c, v), pid in services.multi_value.items() for x in (f"{c}={v}", pid)])
    ids = raw.where(has_id(F.col(id_column))).withColumn("customer_id", clean_id(F.col(id_column)))
    cells = ids.select("customer_id", F.explode(F.array(*[
        F.try_element_at(table, F.concat(F.lit(f"{c}="), F.col(f"`{c}`"))) for c in columns])).alias("product_id"))
    return cells.where("product_id is not null")


def service_interactions(raw: DataFrame, id_column: str, services: ServiceColumns) -> DataFrame:
    out = flag_interactions(raw, id_column, services)
    return out.unionByName(multi_value_interactions(raw, id_column, services)) if services.multi_value else out


def service_products(raw: DataFrame, services: ServiceColumns) -> DataFrame:
    """The product table of a wide source: one product per flag column, plus the multi-valued ones."""
    flags = raw.sparkSession.createDataFrame([(c,) for c in services.flags if c in raw.columns], "product_id string")
    products = flags.select(
        "product_id", humanize(F.col("product_id")).alias("product_name"),
        F.when(F.col("product_id").isin(*CORE_SERVICES), "Core").otherwise("Add-on").alias("category"))
    extra = [p for p in INTERNET_PRODUCTS if p[0] in services.multi_value.values()]
    return products.unionByName(raw.sparkSession.createDataFrame(extra, products.schema)) if extra else products


def _valid_sales(raw: DataFrame, cols: TransactionColumns) -> DataFrame:
    keep = has_id(F.col(cols.customer)) & has_id(F.col(cols.product))
    invoice = cols.invoice if cols.invoice in raw.columns else ("InvoiceNo" if "InvoiceNo" in raw.columns else None)
    if invoice:
        keep &= has_id(F.col(invoice))
        text = strip(F.col(invoice))
        for p in cols.cancel_prefixes:
            keep &= ~F.startswith(F.upper(text), F.lit(p.strip().upper()))
    return raw.where(keep).withColumns({"customer_id": clean_id(F.col(cols.customer)), "product_id": clean_id(F.col(cols.product))})


def sale_interactions(raw: DataFrame, cols: TransactionColumns) -> DataFrame:
    """One row per (customer, product): summed quantity (unreadable counts 1), cancelled invoices dropped."""
    sales = _valid_sales(raw, cols)
    if cols.quantity and cols.quantity in raw.columns:
        number = F.col(cols.quantity).cast("string").try_cast("double")
        number = F.when(F.isnan(number), 1.0).otherwise(F.coalesce(number, F.lit(1.0)))
        return sales.groupBy("customer_id", "product_id").agg(F.sum(number).alias("weight"))
    return sales.select("customer_id", "product_id").distinct()


def sale_products(raw: DataFrame, id_column: str, name_column: str | None = None) -> DataFrame:
    """One row per product: its most frequent description (ties by name), else its id."""
    rows = raw.where(has_id(F.col(id_column))).withColumn("product_id", clean_id(F.col(id_column))).where("product_id <> ''")
    if not name_column or name_column not in raw.columns:
        return rows.select("product_id").distinct().withColumn("product_name", F.col("product_id"))
    name = F.when(has_id(F.col(name_column)), strip(F.col(name_column)))
    counts = rows.groupBy("product_id", name.alias("name")).agg(F.count("*").alias("n"))
    # the null name of a product sorts last, so it wins only when there is no other
    best = first_per_key(counts, ["product_id"], [F.col("name").isNull(), F.col("n").desc(), F.col("name")])
    return best.select("product_id", F.coalesce("name", "product_id").alias("product_name"))


def wide_flags(ratings: DataFrame, items: DataFrame, genres: Sequence[str], min_rating: float = 3.5) -> DataFrame:
    """Yes/No per user and genre: any positively rated item whose genre text holds the genre."""
    liked = ratings.where(F.col("rating") >= min_rating).join(items, "movie_id")
    flags = liked.groupBy("user_id").agg(*[
        F.max(F.contains(F.coalesce("genres", F.lit("")), F.lit(g))).alias(_flag_name(g)) for g in genres])
    users = ratings.select("user_id").distinct().join(flags, "user_id", "left")
    return users.select("user_id", *[
        F.when(F.col(f"`{_flag_name(g)}`"), "Yes").otherwise("No").alias(_flag_name(g)) for g in genres])


def _flag_name(genre: str) -> str:
    return genre.lower().replace("-", "_")


def user_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count("rating").alias("rating_count"), rounded(F.avg("rating"), 2).alias("avg_rating"))


def favorite_genre(ratings: DataFrame, items: DataFrame, default: str = "Drama", min_rating: float = 3.5) -> DataFrame:
    """Most frequent genre over each user's positively rated items, ties by name."""
    liked = ratings.where(F.col("rating") >= min_rating).join(items.where("genres <> '(no genres listed)'"), "movie_id")
    # count whole genre texts first: the exploded rows are then few
    texts = liked.groupBy("user_id", "genres").agg(F.count("*").alias("n"))
    counts = texts.select("user_id", "n", F.explode(F.split("genres", r"\|")).alias("genre")).groupBy("user_id", "genre").agg(F.sum("n").alias("n"))
    best = first_per_key(counts, ["user_id"], [F.col("n").desc(), F.col("genre")])
    users = ratings.select("user_id").distinct()
    return users.join(best, "user_id", "left").select("user_id", F.coalesce("genre", F.lit(default)).alias("favorite_genre"))


def behavioral_features(customers: DataFrame, interactions: DataFrame) -> DataFrame:
    """``interaction_count`` per customer, for tenants that declare no feature."""
    n = interactions.groupBy("customer_id").agg(F.count("*").alias("n"))
    return customers.join(n, "customer_id", "left").withColumn("interaction_count", F.coalesce("n", F.lit(0))).drop("n")


def seed_catalog(products: DataFrame, order: Sequence[Column], now: Column) -> DataFrame:
    """A standard catalogue from any product table; first row per id wins."""
    def pick(*names: str) -> Column:
        present = [F.col(n).cast("string") for n in names if n in products.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    pid = strip(F.col("product_id"))
    rows = first_per_key(products.where(pid != "").withColumn("product_id", pid), ["product_id"], order)
    name = strip(F.coalesce(pick("product_name", "title", "name"), F.col("product_id")))
    category = F.coalesce(blank_to_null(F.coalesce(pick("category", "product_type", "google_product_category"), F.lit("General"))), F.lit("General"))
    stock = F.coalesce(pick("in_stock").try_cast("double").try_cast("int"), F.lit(1))
    return rows.select(
        "product_id", name.alias("product_name"), category.alias("category"), F.lit("active").alias("status"),
        pick("brand").alias("brand"), pick("price").try_cast("double").alias("price"), stock.alias("in_stock"),
        pick("description").alias("description"), pick("image_url").alias("image_url"), pick("product_url").alias("product_url"),
        F.coalesce(pick("created_at"), now).alias("created_at"), F.coalesce(pick("updated_at"), now).alias("updated_at"))
