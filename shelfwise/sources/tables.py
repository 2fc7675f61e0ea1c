"""Tenant tables and telemetry as partitioned Parquet."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    """Partitioned write; rows of a partition are brought together, a large partition is split again."""
    writer = df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by)
    if mode == "overwrite":
        # replaces only the partitions that occur in ``df``
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)


def write_tenant_tables(path: str, tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        write_partitioned(df, f"{path}/{name}", ["tenant_id"], "overwrite")


def written_counts(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Rows per table and tenant as read back; a missing table is an error."""
    from shelfwise.operators.ops import table_counts

    return table_counts({n: spark.read.parquet(f"{path}/{n}") for n in names})


def with_day(records: DataFrame, ts: str = "ts") -> DataFrame:
    return records.withColumn("dt", F.col(ts).cast("date"))


def write_telemetry(records: DataFrame, path: str) -> None:
    """Append records below tenant_id=/dt= folders (UTC date of the record)."""
    write_partitioned(with_day(records), path, ["tenant_id", "dt"])


def read_telemetry(spark: SparkSession, path: str, tenant_id: str | None = None, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Telemetry of one tenant and date range; both filters prune folders."""
    df = spark.read.parquet(path)
    if tenant_id is not None:
        df = df.where(F.col("tenant_id") == tenant_id)
    if first is not None:
        df = df.where(F.col("dt") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("dt") <= F.lit(last))
    return df


def drop_expired(spark: SparkSession, path: str, today: dt.date, days: int = 30) -> int:
    """Delete day folders strictly older than ``days`` days; returns how many."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff, dropped = (today - dt.timedelta(days=days)).isoformat(), 0
    for folder in fs.globStatus(hpath(f"{path}/tenant_id=*/dt=*")) or []:
        date = folder.getPath().getName().split("=", 1)[1]
        if len(date) == 10 and date < cutoff and fs.delete(folder.getPath(), True):
            dropped += 1
    return dropped
