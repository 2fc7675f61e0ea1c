"""Offline evaluation: split, ranking metrics, segments, leaderboard."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.config import Segmentation
from shelfwise.functions.ids import strip
from shelfwise.operators.keyed import exact_median, first_per_key, top_per_key
from shelfwise.session import cut_lineage

METRICS = ("precision", "recall", "ndcg")


def split_flags(interactions: DataFrame, max_test: int = 2, seed: int = 42) -> DataFrame:
    """The test rows: up to ``max_test`` per customer, always leaving one for training; a customer with
    a single row is test only.

    The draw is ordered by a hash of seed, customer and product, so it does not depend on
    partitioning.  ``interactions`` holds one row per pair.
    """
    if max_test < 1:
        raise ValueError("max_test must be at least 1")
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "customer_id", "product_id"))
    drawn = top_per_key(interactions.select("customer_id", "product_id", mark.alias("mark")), ["customer_id"],
                        [F.col("mark"), F.col("product_id")], max_test)
    sizes = interactions.groupBy("customer_id").agg(F.count("*").alias("n"))
    quota = F.when(F.col("n") <= 1, 1).otherwise(F.least(F.lit(max_test), F.col("n") - 1))
    return drawn.join(sizes, "customer_id").where(F.col("rank") <= quota).select("customer_id", "product_id")


def train_test(interactions: DataFrame, max_test: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the interactions are computed once and the flagged rows are written, so both sides only read them."""
    keys = ["customer_id", "product_id"]
    rows = cut_lineage(interactions)
    test = split_flags(rows, max_test, seed).withColumn("_test", F.lit(True))
    marked = cut_lineage(rows.join(test, keys, "left"))
    return marked.where("_test IS NULL").drop("_test"), marked.where("_test").drop("_test")


def hits(recommended: DataFrame, held_out: DataFrame) -> DataFrame:
    """Ranked lists with a flag for held-out products."""
    marked = held_out.select("customer_id", "product_id", F.lit(1).alias("hit"))
    return recommended.join(marked, ["customer_id", "product_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def customer_metrics(recommended: DataFrame, held_out: DataFrame, k: int = 5, models: Sequence[str] = ()) -> DataFrame:
    """precision, recall and ndcg at ``k`` for every customer with held-out products.

    With ``models`` the lists carry a ``model`` column and every named model is measured at once.
    """
    keys = ["customer_id", "model"] if models else ["customer_id"]
    ideal = [0.0]
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + 1 / math.log2(i + 1))
    best = F.array(*[F.lit(x) for x in ideal])
    relevant = held_out.groupBy("customer_id").agg(F.count("*").alias("n_relevant"))
    if models:
        relevant = relevant.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    found = (
        recommended.where(F.col("rank") <= k).join(held_out.select("customer_id", "product_id"), ["customer_id", "product_id"])
        .groupBy(*keys).agg(F.count("*").alias("n_hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    )
    n_hits = F.coalesce("n_hits", F.lit(0))
    precision = n_hits / k if k > 0 else F.lit(0.0)
    return relevant.join(found, keys, "left").select(
        *keys, "n_relevant", n_hits.alias("n_hits"), precision.cast("double").alias("precision"),
        (n_hits / F.col("n_relevant")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / F.get(best, F.least(F.col("n_relevant"), F.lit(k)).cast("int"))).alias("ndcg"))


def first_customers(held_out: DataFrame, limit: int | None) -> DataFrame:
    """Held-out rows of the first ``limit`` customers by id; ``None`` keeps all."""
    if limit is None:
        return held_out
    chosen = held_out.select("customer_id").distinct().orderBy("customer_id").limit(limit)
    return held_out.join(F.broadcast(chosen), "customer_id", "left_semi")


def mean_metrics(per_customer: DataFrame, *keys: str) -> DataFrame:
    return per_customer.groupBy(*keys).agg(F.count("*").alias("customers"), *[F.avg(m).alias(m) for m in METRICS])


def segment_of(customers: DataFrame, seg: Segmentation) -> DataFrame:
    """One segment label per customer: at most the threshold (or median), or equal to a category value."""
    if seg.split == "categorical":
        wanted = (seg.category_value or "United Kingdom").lower()
        low = F.lower(strip(F.coalesce(F.col(seg.field).cast("string"), F.lit("")))) == wanted
    else:
        value = F.col(seg.field).cast("string").try_cast("double")
        limit = seg.threshold if seg.threshold is not None else exact_median(customers.select(value.alias("v")), "v")
        low = value.isNull() | F.isnan(value) | (value <= F.lit(limit))
    return customers.select("customer_id", F.when(low, seg.lower_label).otherwise(seg.upper_label).alias("segment"))


def history_segment(customers: DataFrame, train: DataFrame, limit: int = 2) -> DataFrame:
    n = train.groupBy("customer_id").agg(F.count("*").alias("n"))
    label = F.when(F.coalesce("n", F.lit(0)) <= limit, "newer").otherwise("established")
    return customers.select("customer_id").join(n, "customer_id", "left").select("customer_id", label.alias("segment"))


def with_model(frames: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(name)) for name, df in frames.items()])


def segment_metrics(per_customer: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean metrics per (segment, model) with the winner of each segment; first model name wins ties."""
    means = mean_metrics(per_customer.join(segments, "customer_id"), "segment", "model")
    # one row per (segment, model): small enough for any plan
    best = first_per_key(means, ["segment"], [F.round("ndcg", 9).desc(), F.col("model")]).select("segment", F.col("model").alias("winner"))
    return means.join(best, "segment").withColumn("is_winner", F.col("model") == F.col("winner")).drop("winner")


def tournament(means: DataFrame, order: tuple[str, ...], failed: Sequence[str] = ()) -> DataFrame:
    """Metrics rounded to 4 digits; the winner has the highest ndcg, the earlier model wins a tie, a failed model never wins."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    status = F.when(F.col("model").isin(*failed), "failed").otherwise("completed")
    scored = means.select("model", "customers", *[F.round(F.coalesce(m, F.lit(0.0)), 4).alias(m) for m in METRICS], status.alias("status"), place.alias("_place"))
    winner = scored.where("status = 'completed'").orderBy(F.col("ndcg").desc(), "_place").limit(1).select(F.col("model").alias("winner"))
    return scored.withColumn("is_winner", F.coalesce(F.col("model") == winner.scalar(), F.lit(False))).drop("_place")


def leaderboard(models: DataFrame, metrics: DataFrame, run_status: Column, winner: Column) -> DataFrame:
    """All known models with metrics where present, best ndcg first, unscored ones last."""
    default = F.when(run_status == "completed", "done").when(
        run_status.isin("running", "queued", "stalled", "failed"), run_status).otherwise("not_started")
    return (
        models.join(metrics, "model", "left")
        .select("model", *METRICS, F.coalesce("model_status", default).alias("status"), (F.col("model") == winner).alias("is_winner"))
        .orderBy(F.col("ndcg").desc_nulls_last(), "model")
    )


def examples(customers: DataFrame, owned: DataFrame, held_out: DataFrame, lists: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """For the first ``n`` evaluated customers: owned, held-out and each model's products by name."""
    chosen = held_out.select("customer_id").distinct().orderBy("customer_id").limit(n)
    label = names.select("product_id", F.coalesce("product_name", "product_id").alias("name"))

    def side(df: DataFrame, out: str) -> DataFrame:
        rows = df.join(F.broadcast(chosen), "customer_id", "left_semi").join(label, "product_id", "left")
        text = F.array_join(F.array_sort(F.collect_set(F.coalesce("name", "product_id"))), ", ")
        return rows.groupBy("customer_id").agg(text.alias(out))

    ranked = lists.join(F.broadcast(chosen), "customer_id", "left_semi").join(label, "product_id", "left")
    shown = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("name", "product_id").alias("name"))))
    per_model = ranked.groupBy("customer_id", "model").agg(F.array_join(F.transform(shown, lambda s: s["name"]), ", ").alias("recommended"))
    return (
        chosen.join(customers, "customer_id", "left").join(side(owned, "owned"), "customer_id", "left")
        .join(side(held_out, "held_out"), "customer_id", "left").join(per_model, "customer_id", "left")
    )
