"""Content-based recommender: customer vectors, product profiles, cosine top-k."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.values import let
from shelfwise.operators.blocks import top_matches
from shelfwise.operators.encode import dictionary, with_indicators, with_scaled


@dataclass(frozen=True)
class ContentModel:
    vectors: DataFrame  # customer_id, vec
    profiles: DataFrame  # product_id, vec
    dims: int
    groups: tuple[DataFrame, DataFrame] | None = None  # (customer_id, grp) and (product_id, grp) where tenants are fitted side by side


def customer_vectors(customers: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scope: str | None = None) -> tuple[DataFrame, int]:
    """(customer_id, vec) and the length of the vectors: scaled numeric features followed by an indicator for every observed value."""
    own = [scope] if scope else []
    rows = customers.select("customer_id", *own, *dict.fromkeys([*numeric, *categorical]))
    values = dictionary(customers, categorical) if categorical else None
    dims = len(numeric) + (values.count() if categorical else 0)
    if not dims:
        raise ValueError("no customer features")
    rows = with_indicators(rows, categorical, values, "_marks") if categorical else rows.withColumn("_marks", F.array().cast("array<double>"))
    rows = with_scaled(rows, numeric, scope) if numeric else rows
    return rows.select("customer_id", F.concat(F.array(*[F.col(c) for c in numeric]).cast("array<double>"), "_marks").alias("vec")), dims


def join_vectors(interactions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Interaction counts per pair with the customer's vector (null for an unknown customer)."""
    cells = interactions.groupBy("customer_id", "product_id").agg(F.count("*").alias("cnt"))
    return cells.join(vectors, "customer_id", "left")


def product_profiles(interactions: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Mean vector over the interactions of each product; unknown customers do not count."""
    # one pass over the interactions; zeros of unknown customers add nothing, and rows without a product have no profile
    none = F.array_repeat(F.lit(0.0), dims)
    rows = interactions.select("customer_id", "product_id").join(vectors, "customer_id", "left")
    total = vector_to_array(Summarizer.sum(array_to_vector(F.coalesce("vec", none))))
    sums = rows.groupBy("product_id").agg(total.alias("total"), F.count("vec").alias("n"))
    mean = F.when((F.col("n") > 0) & F.col("product_id").isNotNull(), F.transform("total", lambda x: x / F.col("n")))
    return sums.select("product_id", F.coalesce(mean, none).alias("vec"))


def unit(vec: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.transform(vec, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def fit(customers: DataFrame, interactions: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scope: str | None = None) -> ContentModel:
    """With ``scope`` (a column of both tables that the ids determine) every scope is scaled and matched by itself."""
    vectors, dims = customer_vectors(customers, numeric, categorical, scope)
    groups = None
    if scope:
        groups = (customers.select("customer_id", F.col(scope).alias("grp")), interactions.select("product_id", F.col(scope).alias("grp")).distinct())
    return ContentModel(vectors, product_profiles(interactions, vectors, dims), dims, groups)


def top_products(model: ContentModel, k: int, offered: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The ``k`` closest products (of ``offered`` ones, if given) for every customer (of ``asked``, if given); owned products stay in."""
    vectors = model.vectors if asked is None else model.vectors.join(asked.select("customer_id"), "customer_id", "left_semi")
    queries = vectors.select(F.col("customer_id").alias("qid"), unit(F.col("vec")).alias("vec"))
    items = model.profiles.select(F.col("product_id").alias("iid"), unit(F.col("vec")).alias("vec"))
    if offered is not None:
        items = items.join(offered.select(F.col("product_id").alias("iid")), "iid", "left_semi")
    if model.groups:
        people, goods = model.groups
        queries = queries.join(people.withColumnRenamed("customer_id", "qid"), "qid")
        items = items.join(goods.withColumnRenamed("product_id", "iid"), "iid")
    out = top_matches(queries, items, k, model.dims, grouped=model.groups is not None)
    return out.select(F.col("qid").alias("customer_id"), F.col("iid").alias("product_id"), "score", "rank")
