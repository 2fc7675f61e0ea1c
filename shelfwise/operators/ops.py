"""Multi-tenant table jobs: counts, readiness, retraining, stalled jobs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.ids import blank_to_null, has_id, strip

# fixed values: a tenant can be trained from this size on
MIN_CUSTOMERS = 50
MIN_INTERACTIONS = 200
STALL_MINUTES = 15


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per tenant and table."""
    counts = [df.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit(name).alias("table_name"), "n")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def discover_tenants(*listings: DataFrame) -> DataFrame:
    """Distinct non-blank tenant ids over any number of listings."""
    ids = reduce(DataFrame.union, [df.select(blank_to_null(F.col("tenant_id")).alias("tenant_id")) for df in listings])
    return ids.where("tenant_id is not null").distinct()


def tenant_counts(interactions: DataFrame, customers: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct customers over all three sources and number of interactions, per tenant.

    Ids are made distinct per (tenant, customer) first, so a large tenant spreads over many tasks.
    """
    def ids(df: DataFrame) -> DataFrame:
        return df.where(has_id(F.col("customer_id"))).select("tenant_id", strip(F.col("customer_id")).alias("customer_id"))

    people = reduce(DataFrame.union, [ids(d) for d in (interactions, customers, queued)]).distinct()
    people = people.groupBy("tenant_id").agg(F.count("*").alias("customers"))
    rows = interactions.select("tenant_id").union(queued.select("tenant_id")).groupBy("tenant_id").agg(F.count("*").alias("interactions"))
    return people.join(rows, "tenant_id", "full").select(
        "tenant_id", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("interactions", F.lit(0)).alias("interactions"))


def readiness(status: DataFrame, counts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Untrained tenants against their thresholds; an override counts only when it names both values."""
    df = status.where("not trained").join(counts, "tenant_id", "left").fillna(0, ["customers", "interactions"])
    if overrides is not None:
        df = df.join(overrides, "tenant_id", "left")
        both = F.col("min_customers").isNotNull() & F.col("min_interactions").isNotNull()
        df = df.withColumns({"min_customers": F.when(both, F.col("min_customers")).otherwise(MIN_CUSTOMERS),
                             "min_interactions": F.when(both, F.col("min_interactions")).otherwise(MIN_INTERACTIONS)})
    else:
        df = df.withColumns({"min_customers": F.lit(MIN_CUSTOMERS), "min_interactions": F.lit(MIN_INTERACTIONS)})
    ready = (F.col("customers") >= F.col("min_customers")) & (F.col("interactions") >= F.col("min_interactions"))
    marked = F.coalesce(F.col("status").isin("ready_to_train", "ready-to-train"), F.lit(False))
    action = F.when(ready & marked, "already_marked").when(ready, "marked_ready_to_train").otherwise("below_threshold")
    return df.select("tenant_id", "customers", "min_customers", "interactions", "min_interactions",
                     ready.alias("is_ready"), F.col("status").alias("current_status"), action.alias("action"))


def retrain_plan(status: DataFrame) -> DataFrame:
    """What the scheduled retraining does with each tenant."""
    busy = F.coalesce(F.col("status").isin("queued", "running"), F.lit(False))
    ready = F.coalesce(F.col("status").isin("ready_to_train", "ready-to-train"), F.lit(False))
    kind = (F.when(busy, "in_progress").when(F.col("trained"), "already_trained").when(ready, "new_ready").otherwise("below_threshold"))
    action = F.when(busy, "skipped").when(F.col("trained"), "retrain").when(ready, "first_training").otherwise("skipped")
    return status.select("tenant_id", kind.alias("tenant_type"), action.alias("action"),
                         F.when(action == "skipped", "skipped").otherwise("queued").alias("status"))


def effective_status(status: Column, updated: Column, now: Column, minutes: int = STALL_MINUTES) -> Column:
    """``stalled`` for a queued or running job without an update for more than ``minutes``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))
    return F.when(status.isin("queued", "running") & (age > minutes * 60_000_000), "stalled").otherwise(F.coalesce(status, F.lit("not_started")))
