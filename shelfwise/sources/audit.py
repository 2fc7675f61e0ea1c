"""Append-only audit records of catalogue mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.operators.keyed import top_per_key

KEPT_IDS = 100

SCHEMA = ("tenant_id string, who string, `when` string, action string, product_ids_count bigint, product_ids array<string>, dt string")


def records(changed: DataFrame) -> DataFrame:
    """One record per (tenant_id, who, when, action) from one row per changed product.

    The full count is kept, the ids only up to KEPT_IDS; they are chosen before they are collected.
    """
    keys = ["tenant_id", "who", "when", "action"]
    counts = changed.groupBy(*keys).agg(F.count("*").alias("product_ids_count"))
    some = top_per_key(changed, keys, [F.col("product_id")], KEPT_IDS).groupBy(*keys).agg(
        F.array_sort(F.collect_list("product_id")).alias("product_ids"))
    return counts.join(some, keys).withColumn("dt", F.substring("when", 1, 10))


def append(rows: DataFrame, path: str) -> None:
    rows.select("tenant_id", "who", "when", "action", "product_ids_count", "product_ids", "dt").write.mode("append").partitionBy("dt").json(path)


def history(spark: SparkSession, path: str, tenant_id: str, limit: int = 50) -> DataFrame:
    """Newest records of a tenant first."""
    df = spark.read.schema(SCHEMA).json(path).where(F.col("tenant_id") == tenant_id)
    return df.orderBy(F.col("when").desc(), "who", "action").limit(limit)
