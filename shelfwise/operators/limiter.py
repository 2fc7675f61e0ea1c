"""Sliding-window rate limiting of a request log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

# fixed values: default requests per minute and scope
LIMITS = {"recommendations": 60, "onboarding": 5, "tracking": 120, "catalog": 60}
OTHER_LIMIT = 60


def with_limits(requests: DataFrame, limits: DataFrame, tenant: str = "tenant_id", scope: str = "scope") -> DataFrame:
    """Requests with ``limit_per_minute`` of their tenant and scope.

    ``limits`` holds (tenant_id, scope, limit_per_minute), at most one row per tenant and scope; a null scope stands for
    the whole tenant.  The scope's own limit comes first, then the tenant's, then the default of the scope.
    """
    named = limits.select(F.col("tenant_id").alias(tenant), F.col("scope").alias("_scope"), F.col("limit_per_minute").cast("int").alias("_own"))
    for_scope = named.where("_scope IS NOT NULL").withColumnRenamed("_scope", scope)
    for_tenant = named.where("_scope IS NULL").select(tenant, F.col("_own").alias("_all"))
    default = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    found = F.coalesce("_own", "_all", F.try_element_at(default, F.col(scope)), F.lit(OTHER_LIMIT))
    return requests.join(for_scope, [tenant, scope], "left").join(for_tenant, tenant, "left").withColumn("limit_per_minute", found).drop("_own", "_all")


def limit_requests(requests: DataFrame, keys: Sequence[str], ts: str, order_id: str, limit: int | Column, seconds: int = 60) -> DataFrame:
    """allowed, remaining and retry_after of every request; ``limit`` is one number or a column that is the same for all rows of a key.

    Only allowed requests occupy the window (t - seconds, t], so a request depends on the fate of the
    ones before it.  That chain is cut wherever it can be: time is divided into slots of the window
    length, and a slot that together with its predecessor holds at most ``limit`` requests is calm:
    all its requests are allowed, and they alone decide what the next slot starts with.  Every run of
    slots between two cuts is its own group, opened with the requests of the calm slot before it, and is
    folded batch by batch with at most ``limit`` remembered times; no group is collected.
    """
    keys = list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    bound = limit if isinstance(limit, Column) else F.lit(limit)
    rows = requests.select(*keys, F.col(order_id), us.alias("_us"), F.floor(us / size).alias("_slot"), bound.cast("int").alias("_limit"))
    slots = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("n"), F.min("_limit").alias("_most"))
    # one row per key and slot: as long as the log's time span, not as its traffic
    w = W.partitionBy(*keys).orderBy("_slot")
    slots = slots.withColumn("follows", F.lag("_slot").over(w) == F.col("_slot") - 1).withColumn(
        "calm", F.col("n") + F.when(F.col("follows"), F.lag("n").over(w)).otherwise(0) <= F.col("_most"))
    opens = ~F.coalesce("follows", F.lit(False)) | F.lag("calm").over(w)
    slots = slots.withColumn("opens", opens).withColumns({
        "_run": F.max(F.when(F.col("opens"), F.col("_slot"))).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_lend": F.col("calm") & F.coalesce(F.lead("_slot").over(w) == F.col("_slot") + 1, F.lit(False))})
    tagged = rows.join(slots.select(*keys, "_slot", "_run", "_lend"), [*keys, "_slot"])
    tagged = tagged.select(*keys, order_id, "_us", "_limit", F.inline(F.filter(F.array(
        F.struct(F.col("_run").alias("_group"), F.lit(1).alias("_own")),
        F.when(F.col("_lend"), F.struct((F.col("_slot") + 1).alias("_group"), F.lit(0).alias("_own")))), lambda s: s.isNotNull())))
    # keys as one text, so that the fold compares a single value
    folded = tagged.select(F.to_json(F.struct(*keys, "_group")).alias("_key"), *keys, order_id, "_us", "_limit", "_own")
    folded = folded.repartition("_key").sortWithinPartitions("_key", "_us", "_own", order_id)
    out_schema = folded.drop("_us", "_limit").schema.add("allowed", T.BooleanType()).add("remaining", T.IntegerType()).add("retry_after", T.IntegerType())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for b in batches:
            names = b.schema.names
            group, times = b.column(names.index("_key")).to_pylist(), b.column(names.index("_us")).to_numpy()
            allowed, remaining, retry = np.zeros(len(group), bool), np.zeros(len(group), np.int32), np.zeros(len(group), np.int32)
            limits = b.column(names.index("_limit")).to_pylist()
            for i, (g, t, most) in enumerate(zip(group, times.tolist(), limits)):
                if g != current:
                    current = g
                    recent.clear()
                while recent and recent[0] <= t - size:
                    recent.popleft()
                if len(recent) >= most:
                    retry[i] = max(1, -((t - recent[0] - size) // 1_000_000)) if recent else size // 1_000_000
                else:
                    recent.append(t)
                    allowed[i], remaining[i] = True, most - len(recent)
            keep = [c for c in names if c not in ("_us", "_limit")]
            yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in keep] + [pa.array(allowed), pa.array(remaining), pa.array(retry)],
                                             names=keep + ["allowed", "remaining", "retry_after"])

    return folded.mapInArrow(fold, out_schema).where("_own = 1").drop("_key", "_own")
