"""Reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from counts per bucket, not from one sorted task; the permutation is a column
expression, so shard and slot of a row follow from its number, and the number from shard and slot.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

ROUNDS = 6
MAX_BUCKETS = 4096  # rows of the broadcast table of bucket offsets
BUCKET_ROWS = 20_000


def domain(n: int) -> tuple[int, int, int]:
    """(a, b, walks): the Feistel halves, a * b >= n, with as few numbers beyond n as possible.

    A cycle can hold at most a * b - n numbers that are out of range, so ``walks`` steps always end in range.
    """
    n = max(1, n)
    root = math.isqrt(n - 1) + 1
    a = np.arange(max(1, root // 2), root + 1, dtype=np.int64)[-200_000:]
    over = -n % a
    best = int(len(a) - 1 - np.argmin(over[::-1]))
    return int(a[best]), int(-(-n // a[best])), int(over[best]) + 1


def permuted(x: Column, n: int, seed: int) -> Column:
    """Place of number ``x`` (0 <= x < n) under the permutation that ``seed`` names."""
    a, b, walks = domain(n)

    def once(y: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            left, right, key = s["l"], s["r"], F.lit(seed) * F.lit(1_000_003) + r
            return F.when(r % 2 == 0, F.struct(F.pmod(left + F.pmod(F.xxhash64(right, key), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))).otherwise(
                F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, key), F.lit(b)), F.lit(b)).alias("r")))

        start = F.struct((y % a).cast("long").alias("l"), F.call_function("div", y, F.lit(a)).alias("r"))
        return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["r"] * a + s["l"])

    return F.reduce(F.sequence(F.lit(1), F.lit(walks)), F.lit(-1).cast("long"),
                    lambda at, _: F.when((at >= 0) & (at < n), at).otherwise(once(F.when(at < 0, x).otherwise(at))))


def row_numbers(ids: DataFrame) -> DataFrame:
    """``ids`` with ``row_number`` 0, 1, 2, ...; the same rows get the same numbers on every run and layout.

    ``ids`` has narrow columns that identify a row.  Equal rows are counted first and numbered from their
    count, so one key repeated any number of times is one row in the shuffle.
    """
    columns = [F.col(f"`{c}`") for c in ids.columns]
    counted = ids.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    total = ids.count()
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    counted = counted.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    # at most MAX_BUCKETS rows: one task orders them and every task may hold them
    offsets = counted.groupBy("__bucket").agg(F.sum("__n").alias("__rows")).withColumn(
        "__offset", F.sum("__rows").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce("__offset", F.lit(0)) + F.coalesce("__before", F.lit(0))
    return (
        counted.withColumn("__before", F.sum("__n").over(before)).join(F.broadcast(offsets.drop("__rows")), "__bucket")
        .select(*columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("row_number"))
    )


def shard(ids: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """``ids`` plus (row_number, shard, slot): counts of shards differ by one at most, slots have no gap.

    Shard and slot depend on the set of rows, ``shards`` and ``seed`` alone.  Nulls are values like any other; an
    empty table gives an empty result.  ``ids`` must not have a column called row_number, shard or slot.
    """
    n = ids.count()
    numbered = row_numbers(ids).withColumn("__at", permuted(F.col("row_number"), n, seed))
    return numbered.select(*[F.col(f"`{c}`") for c in ids.columns], "row_number", (F.col("__at") % shards).cast("int").alias("shard"),
                           F.expr(f"__at div {shards}").alias("slot"))
