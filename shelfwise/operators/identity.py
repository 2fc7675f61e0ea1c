"""Session to customer identity, and tracking events as weighted interactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions import events as ev
from shelfwise.functions.ids import has_id, strip
from shelfwise.operators.keyed import join_hot


def identity_links(events: DataFrame) -> DataFrame:
    """Every event that links a session to a customer."""
    session, customer = F.col("session_id"), F.col("customer_id")
    return events.where(ev.is_identity_link(session, customer)).select(
        strip(session).alias("session_id"), strip(customer).alias("mapped"), "ts", "event_id")


def identity_map(events: DataFrame) -> DataFrame:
    """The last linked customer per session by event order."""
    return identity_links(events).groupBy("session_id").agg(F.max_by("mapped", F.struct("ts", "event_id")).alias("mapped"))


def resolve(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``effective_customer``: earlier anonymous events follow a later link of their session.

    Only events without a customer look for a link; all others get a key of their own that matches nothing, so neither blank
    sessions nor known customers meet in one task.  A session with a large share of a stored table is joined where it lies.
    """
    session = strip(F.col("session_id"))
    open_ = ~has_id(F.col("customer_id")) & has_id(F.col("session_id"))
    alone = F.concat(F.lit("\x1f"), F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]).cast("string"))
    keyed = events.withColumn("_s", F.when(open_, session).otherwise(alone))
    links = mapping.select(F.col("session_id").alias("_s"), "mapped")
    df = keyed.join(links, "_s", "left") if events.isStreaming else join_hot(keyed, links, "_s", "left")
    who = ev.effective_customer(F.col("customer_id"), F.col("mapped"), F.col("session_id"))
    return df.withColumn("effective_customer", who).drop("_s", "mapped")


def event_interactions(events: DataFrame, mapping: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(customer_id, product_id, event_type, weight, ts, event_id) of all usable events."""
    df = resolve(events, mapping).where(
        ev.transform_reject(F.col("customer_id"), F.col("session_id"), F.col("product_id")).isNull())
    return df.select(
        F.col("effective_customer").alias("customer_id"), strip(F.col("product_id")).alias("product_id"),
        F.lower(strip(F.coalesce("event_type", F.lit("view")))).alias("event_type"),
        ev.event_weight(F.col("event_type"), F.col("quantity"), weights).alias("weight"), "ts", "event_id")


def union_interactions(batch: DataFrame, streamed: DataFrame) -> DataFrame:
    """Batch and streamed interactions in one table; a missing weight counts 1."""
    out = batch.unionByName(streamed, allowMissingColumns=True)
    return out.withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))
