"""Popularity, fallbacks and recommendation lists for all customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfwise.functions.ids import has_id, strip
from shelfwise.operators.keyed import global_rank, top_per_key
from shelfwise.session import cut_lineage


def popularity(interactions: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Interactions (and queued events) per product."""
    ids = interactions.select(strip(F.col("product_id")).alias("product_id"))
    if queued is not None:
        ids = ids.union(queued.select(strip(F.col("product_id"))))
    return ids.where(F.col("product_id").isNotNull() & (F.col("product_id") != "")).groupBy("product_id").agg(F.count("*").alias("n"))


def active_by_popularity(active: DataFrame, pop: DataFrame) -> DataFrame:
    """Active products with their count, 0 for never seen ones."""
    return active.join(pop, "product_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def popularity_fallback(active: DataFrame, pop: DataFrame, n: int) -> DataFrame:
    """Top ``n`` active products: popular ones first, then the others by id.

    Taking the first 3n popular ones, filtering and topping up again gives this same list, because
    the top-up walks the full popularity order.
    """
    best = active_by_popularity(active, pop).orderBy(F.col("n").desc(), F.col("product_id")).limit(n)
    # at most n rows are left for this window
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), F.col("product_id"))))


def fallback_by(active: DataFrame, pop: DataFrame, n: int, by: str) -> DataFrame:
    """:func:`popularity_fallback` for every value of the column ``by`` of ``active``."""
    return top_per_key(active_by_popularity(active, pop), [by], [F.col("n").desc(), F.col("product_id")], n)


def ranked_active(active: DataFrame, pop: DataFrame) -> DataFrame:
    """Every active product with its 1-based popularity position."""
    df = active_by_popularity(active.select("product_id", "product_name"), pop)
    return global_rank(df, [F.col("n").desc(), F.col("product_id").asc()], "position")


def unseen_popular(customers: DataFrame, owned: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` most popular products that each customer does not own.

    A customer who owns m of them finds the answer within the first m + k positions, so the work grows
    with the interactions, not with customers x products.  ``owned`` holds distinct pairs.
    """
    total = ranked.agg(F.count("*").alias("n"))
    positions = ranked.select("product_id", "position")
    # used for the counts and again for the anti join
    have = cut_lineage(owned.select("customer_id", "product_id").join(positions, "product_id").select("customer_id", "position"))
    m = have.groupBy("customer_id").agg(F.count("*").alias("m"))
    reach = F.least(F.coalesce("m", F.lit(0)) + k, total.scalar())
    wanted = (
        customers.select("customer_id").join(m, "customer_id", "left")
        .select("customer_id", reach.alias("reach")).where("reach > 0")
        .select("customer_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reach"))).alias("position"))
    )
    free = wanted.join(have, ["customer_id", "position"], "left_anti")
    best = top_per_key(free, ["customer_id"], [F.col("position")], k)
    return best.join(ranked, "position").select("customer_id", "rank", "product_id", "product_name")


def recommend_all(requests: DataFrame, customers: DataFrame, lists: DataFrame, active: DataFrame, fallback: DataFrame,
                  n: int, trained: Column | bool = True, by: str | None = None) -> DataFrame:
    """One ranked list of active products and a reason for every requested customer.

    ``lists`` holds (customer_id, product_id, rank) of the winning model, drawn from active products so that ``n``
    entries are enough; ``fallback`` is the top ``n`` of :func:`popularity_fallback`, or of :func:`fallback_by` when ``by`` names
    the column of ``requests`` whose value has a list of its own.
    """
    trained = trained if isinstance(trained, Column) else F.lit(trained)
    # details travel with the lists, so no join meets the few fallback products once per customer
    shown = F.struct("product_id", "product_name", "category", "price")
    info = active.select("product_id", "product_name", "category", "price")
    own = lists.join(info, "product_id").groupBy("customer_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id", shown.alias("shown")))), lambda s: s["shown"]).alias("own"))
    listed = lists.select("customer_id").distinct().withColumn("listed", F.lit(True))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "product_id", shown.alias("shown"))))
    pool = F.transform(ordered, lambda s: s["shown"]).alias("pool")
    keys = [by] if by else []
    offered = fallback.select(*keys, "rank", "product_id").join(info, "product_id")
    if by is None:
        asked = requests.select("customer_id").withColumn("pool", offered.agg(pool).scalar())
    else:
        asked = requests.select("customer_id", by).join(cut_lineage(offered.groupBy(by).agg(pool)), by, "left").drop(by)
    df = (
        asked
        .join(customers.select("customer_id", F.lit(True).alias("known")), "customer_id", "left")
        .join(own, "customer_id", "left").join(listed, "customer_id", "left")
    )
    reason = (
        F.when(~trained, "model_not_trained").when(F.col("known").isNull(), "unknown_customer")
        .when(F.col("listed").isNull(), "no_history")
    )
    mine = F.when(reason.isNull(), F.col("own"))
    parts = F.flatten(F.filter(F.array(mine, F.col("pool")), lambda x: x.isNotNull()))
    df = df.select("customer_id", reason.alias("reason"), F.slice(F.array_distinct(parts), 1, n).alias("shown"))
    rows = df.select("customer_id", "reason", F.posexplode("shown").alias("pos", "p"))
    return rows.select("customer_id", (F.col("pos") + 1).alias("rank"), "p.product_id", "p.product_name", "p.category", "p.price", "reason")


def drop_owned(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    return pairs.join(owned, ["customer_id", "product_id"], "left_anti")


def add_missing_products(catalog: DataFrame, interactions: DataFrame, now: Column) -> DataFrame:
    """Catalogue plus every product seen in interactions only: active, in stock, category General."""
    seen = interactions.where(has_id(F.col("product_id"))).select(strip(F.col("product_id")).alias("product_id")).distinct()
    new = seen.join(catalog.select(strip(F.col("product_id")).alias("product_id")), "product_id", "left_anti")
    new = new.select(
        "product_id", F.col("product_id").alias("product_name"), F.lit("General").alias("category"), F.lit("active").alias("status"),
        F.lit("1").alias("in_stock"), now.alias("created_at"), now.alias("updated_at"))
    return catalog.unionByName(new, allowMissingColumns=True)
