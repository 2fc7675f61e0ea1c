"""Tracking and telemetry as Structured Streaming jobs.

Delivery is at least once and events have ids; checkpoints replace acknowledgement and redelivery.
Raw events stay immutable: identity and late links are resolved when the tables are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfwise.functions.events import transform_reject
from shelfwise.functions.ids import strip
from shelfwise.operators.identity import event_interactions, identity_links
from shelfwise.session import durable_path


def file_stream(spark: SparkSession, path: str, schema: StructType, name: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_to(stream: DataFrame, path: str, partition_by: Sequence[str] = (), every: str | None = None) -> StreamingQuery:
    """Append rows to a Parquet folder, exactly once per row of the source."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _start(writer, f"{path}-checkpoint", every)


def each_batch(stream: DataFrame, path: str, write: Callable[[DataFrame, str], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write every micro-batch to its own ``batch=N`` folder; a repeated batch overwrites itself."""
    def run(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch={number}")

    return _start(stream.writeStream.foreachBatch(run).outputMode(mode), f"{path}-checkpoint", every)


def finished(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def interactions(events: DataFrame) -> DataFrame:
    """Stateless event to interaction projection; sessions keep their own id until read time."""
    none = events.sparkSession.createDataFrame([], "session_id string, mapped string")
    return event_interactions(events, none)


def split_events(events: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Usable events to ``good``, the others with their reason to ``rejected``."""
    why = transform_reject(F.col("customer_id"), F.col("session_id"), F.col("product_id"))

    def write(batch: DataFrame, folder: str) -> None:
        # one pass, one table with a folder per outcome
        batch.withColumn("outcome", F.when(F.col("reject_reason").isNull(), "good").otherwise("rejected")).write.mode(
            "overwrite").partitionBy("outcome").parquet(folder)

    return each_batch(events.withColumn("reject_reason", why), path, write, every=every)


def identity_transitions(events: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Append every session to customer link; the latest per session is taken when the table is read."""
    return append_to(identity_links(events), path, every=every)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Redelivered events are dropped as long as they arrive within ``delay``; events later than that are dropped, :func:`append_once` keeps them."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def append_once(events: DataFrame, path: str, key: str = "event_id", every: str | None = None) -> StreamingQuery:
    """Append every event once, however often and however late it is delivered again.

    What was stored is the state: a batch is compared with the stored events of the days that occur in it, and only those day
    folders are read.  Redelivered events have the time they had.  A repeated batch replaces its own folder.
    """
    spark, schema = events.sparkSession, events.schema

    def run(batch: DataFrame, number: int) -> None:
        dated = batch.dropDuplicates([key]).withColumn("day", F.col("ts").cast("date"))
        days = [r.day for r in dated.select("day").distinct().collect()]  # days of one batch
        if number:
            stored = spark.read.schema(dated.schema.add("batch", "long")).option("basePath", path).parquet(path)
            seen = stored.where(F.col("day").isin(days) & (F.col("batch") < number)).select(key)
            dated = dated.join(seen, key, "left_anti")
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return _start(events.select(schema.names).writeStream.foreachBatch(run), f"{path}-checkpoint", every)


def daily_counts(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Events per (day, type) as a running aggregate: late events count, the state has a row per day and type.

    ``delay`` ends the state of days that lie that far back, and with it the counting of later events.
    """
    if delay is None:
        return events.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("date").alias("date"), "event_type", "n")


def running_popularity(events: DataFrame) -> DataFrame:
    pid = strip(F.col("product_id"))
    return events.where(pid != "").groupBy(pid.alias("product_id")).agg(F.count("*").alias("n"))


def keep_updates(aggregate: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Write the changed rows of a running aggregate, one folder per batch."""
    return each_batch(aggregate, path, lambda batch, folder: batch.write.mode("overwrite").parquet(folder), "update", every)


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key from :func:`keep_updates`."""
    df = spark.read.option("basePath", path).parquet(path)
    w = W.partitionBy(*keys).orderBy(F.col("batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def new_path(spark: SparkSession, name: str) -> str:
    return durable_path(spark, f"stream-{name}")
