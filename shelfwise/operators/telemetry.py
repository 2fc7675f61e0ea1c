"""Telemetry reports per tenant.

Records carry tenant_id, ts, type (recommendation | event) and the columns of both kinds;
``recommended_products`` is an array.  Every report leaves test traffic out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.events import EVENT_TYPES, is_live
from shelfwise.functions.text import time_ago
from shelfwise.functions.values import rounded
from shelfwise.operators.keyed import top_per_key

RETENTION_DAYS = 30
SHOWN_TYPES = EVENT_TYPES


def live(records: DataFrame) -> DataFrame:
    return records.where(is_live(F.col("source"), F.col("request_source")))


def day(ts: str = "ts") -> Column:
    return F.col(ts).cast("date")


def window_of(today: dt.date, days: int) -> tuple[dt.date, dt.date]:
    return today - dt.timedelta(days=days - 1), today


def in_window(records: DataFrame, today: dt.date, days: int) -> DataFrame:
    """Records whose own date lies in the last ``days`` days."""
    first, last = window_of(today, days)
    return records.where(day().between(F.lit(first), F.lit(last)))


def calendar(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every row once per date between ``first`` and ``last``, with a weekday label."""
    days = rows.select("*", F.explode(F.sequence(first, last)).alias("date"))
    return days.withColumn("label", F.date_format("date", "E"))


def _kind() -> Column:
    return F.coalesce("kind", F.lit("recommendation"))


def _is_rec() -> Column:
    return F.col("type") == "recommendation"


def events_by_day(records: DataFrame, today: dt.date, days: int, types: Sequence[str] = SHOWN_TYPES) -> DataFrame:
    """Zero-filled counts per tenant, day and event type, with the total of all types."""
    events = in_window(live(records), today, days).where("type = 'event'")
    counts = events.groupBy("tenant_id", day().alias("date")).agg(
        *[F.count_if(F.coalesce("event_type", F.lit("view")) == t).alias(t) for t in types], F.count("*").alias("total"))
    first, last = window_of(today, days)
    days_of = calendar(records.select("tenant_id").distinct(), F.lit(first), F.lit(last))
    return days_of.join(counts, ["tenant_id", "date"], "left").select(
        "tenant_id", F.col("date").cast("string").alias("date"), "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*types, "total")])


def recommendation_totals(records: DataFrame, today: dt.date, days: int) -> DataFrame:
    """Requests, requests today, fallbacks and their rate; similar-product requests do not count here."""
    recs = in_window(live(records), today, days).where(_is_rec() & (_kind() != "similar"))
    out = recs.groupBy("tenant_id").agg(
        F.count("*").alias("total"), F.count_if(day() == F.lit(today)).alias("today"), F.count_if(F.col("fallback")).alias("fallbacks"))
    return out.withColumn("fallback_rate", F.when(F.col("total") > 0, rounded(F.col("fallbacks") / F.col("total"), 4)))


def top_recommended(records: DataFrame, active: DataFrame, today: dt.date, days: int, n: int = 5) -> DataFrame:
    recs = in_window(live(records), today, days).where(_is_rec() & (_kind() != "similar"))
    shown = recs.select("tenant_id", F.explode("recommended_products").alias("product_id")).where("product_id <> ''")
    counts = shown.groupBy("tenant_id", "product_id").agg(F.count("*").alias("n"))
    return _named_top(counts.join(active, "product_id", "left_semi"), active, n)


def top_similar_sources(records: DataFrame, names: DataFrame, today: dt.date, days: int, n: int = 5) -> DataFrame:
    recs = in_window(live(records), today, days).where(_is_rec() & (_kind() == "similar"))
    source = F.coalesce(F.when(F.col("target_product_id") != "", F.col("target_product_id")), F.when(F.col("customer_id") != "", F.col("customer_id")))
    counts = recs.select("tenant_id", source.alias("product_id")).where("product_id is not null").groupBy("tenant_id", "product_id").agg(F.count("*").alias("n"))
    return _named_top(counts, names, n)


def _named_top(counts: DataFrame, names: DataFrame, n: int) -> DataFrame:
    best = top_per_key(counts, ["tenant_id"], [F.col("n").desc(), F.col("product_id")], n)
    named = best.join(names.select("product_id", "product_name"), "product_id", "left")
    return named.withColumn("product_name", F.coalesce("product_name", "product_id"))


def ctr_by_source(records: DataFrame, today: dt.date, days: int) -> DataFrame:
    """min(1, distinct clicked rec_ids / requests) for similar and recommendation.

    Click ids are made distinct by (tenant, source, id) first, so a large tenant is no single group.
    """
    rows = in_window(live(records), today, days)
    requests = rows.where(_is_rec()).groupBy("tenant_id", F.when(_kind() == "similar", "similar").otherwise("recommendation").alias("source")).agg(
        F.count("*").alias("requests"))
    clicks = rows.where((F.col("type") == "event") & (F.col("event_type") == "click") & F.col("source").isin("similar", "recommendation") & (F.col("rec_id") != ""))
    clicked = clicks.select("tenant_id", "source", "rec_id").distinct().groupBy("tenant_id", "source").agg(F.count("*").alias("clicked"))
    sides = rows.select("tenant_id").distinct().withColumn("source", F.explode(F.array(F.lit("similar"), F.lit("recommendation"))))
    both = sides.join(requests, ["tenant_id", "source"], "left").join(clicked, ["tenant_id", "source"], "left")
    rate = F.least(F.lit(1.0), F.coalesce("clicked", F.lit(0)) / F.col("requests"))
    return both.select("tenant_id", "source", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("clicked", F.lit(0)).alias("clicked"),
                       F.when(F.col("requests") > 0, rounded(rate, 4)).alias("ctr"))


def funnel_by_source(records: DataFrame, today: dt.date, days: int) -> DataFrame:
    rows = in_window(live(records), today, days).where((F.col("type") == "event") & F.col("source").isin("similar", "recommendation"))
    return rows.groupBy("tenant_id", "source").agg(*[
        F.count_if(F.col("event_type") == t).alias(out) for t, out in (("click", "clicks"), ("add_to_cart", "add_to_carts"), ("purchase", "purchases"))])


def recent_events(records: DataFrame, names: DataFrame, now: dt.datetime, n: int = 20, days: int = 3) -> DataFrame:
    """Newest ``n`` events per tenant of the last ``days`` dates, with product name and relative time; older partitions are not read."""
    events = in_window(records, now.date(), days).where("type = 'event'").select("tenant_id", "event_id", "ts", "event_type", "product_id")
    best = top_per_key(events, ["tenant_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)
    return best.join(names.select("product_id", "product_name"), "product_id", "left").select(
        "tenant_id", "rank", "event_id", "event_type", "product_id", F.coalesce("product_name", "product_id").alias("product_name"),
        time_ago(F.col("ts"), F.lit(now).cast("timestamp_ntz")).alias("ago"))


def expired(partitions: DataFrame, today: dt.date, days: int = RETENTION_DAYS) -> DataFrame:
    """Day partitions strictly older than ``days`` days."""
    return partitions.where(F.col("dt") < F.lit(today - dt.timedelta(days=days)))
