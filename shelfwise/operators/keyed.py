"""Per-key selection, global ranks, trailing counts and exact quantiles that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfwise.session import cut_lineage


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, with their 1-based rank.

    ``row_number() <= k`` lets Spark keep at most ``k`` rows per key in every task *before* the
    shuffle, so a hot key never reaches one task whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_first").drop("_first")


def by_score(score: str = "score", tie: str = "product_id") -> list[Column]:
    """The one ranking rule of this package: score rounded to 9 digits, then id."""
    return [F.round(F.col(score), 9).desc(), F.col(tie).asc()]


HOT_SHARE = 200  # a key is hot from 1 / HOT_SHARE of the rows on, so there are fewer than HOT_SHARE hot keys
HOT_ROWS = 1 << 20  # one task takes so many narrow rows, so no key of a smaller table is hot


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` joined to the few rows that ``right`` has of a key, whatever share of ``left`` one key holds.

    Keys with more than 1 / HOT_SHARE of the rows of ``left`` stay where they are and get their rows of ``right`` by
    broadcast; those are fewer than HOT_SHARE keys.  ``left`` is read three times: hand in a written table or a scan.
    """
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, on, how)
    hot = cut_lineage(left.groupBy(on).count().where(F.col("count") * HOT_SHARE > total).select(on).where(F.col(on).isNotNull()))
    if hot.isEmpty():
        return left.join(right, on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    return left.join(F.broadcast(hot), on, "left_anti").join(right, on, how).unionByName(
        left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """1-based position of every row in the total order, without a one-task window.

    Range-partition and sort once, write that stage down, then add each partition's offset.  ``order``
    should be unique, as everywhere in this package.
    """
    staged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    )
    # one row per partition: its size and the rows in front of it
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_lo"))
    before = sizes.select(
        "_part", "_lo",
        (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    return (
        staged.join(F.broadcast(before), "_part")
        .withColumn(rank, F.col("_before") + F.col("_id") - F.col("_lo") + 1)
        .drop("_part", "_id", "_lo", "_before")
    )


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in ``(ts - seconds, ts]``.

    Every row is also lent to the next time slot of the same length, so the window can be split by
    (key, slot) and a busy key spreads over many tasks.  A row counts from its own time on and is taken off again ``seconds`` later, so
    one running sum per slot gives the counts; its cost does not grow with the rows of a window.  Lent entries travel without the row.
    """
    size = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(micros / size)
    whole = F.struct(*[F.col(c) for c in df.columns if c not in keys])

    def entry(row: Column, slot: Column, at: Column, step: int) -> Column:
        return F.struct(row.alias("_row"), slot.alias("_slot"), at.alias("_us"), F.lit(step).alias("_step"))

    nothing = F.when(F.lit(False), whole)
    entries = F.array(entry(F.when(F.lit(True), whole), slot, micros, 1), entry(nothing, slot + 1, micros, 1),
                      F.when(micros.isNotNull(), entry(nothing, slot + 1, micros + size, -1)))
    spread = df.select(*keys, F.inline(F.filter(entries, lambda e: e.isNotNull())))
    w = W.partitionBy(*keys, "_slot").orderBy("_us").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = spread.withColumn(out, F.sum("_step").over(w)).where("_row IS NOT NULL")
    return counted.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns], out)


def lowest_hashes(df: DataFrame, key: Sequence[Column], tie: Sequence[str], n: int, seed: int) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest md5 of seed and ``key`` (``tie`` orders equal ones), the same for every partitioning.

    The rows are counted and a limit on the hash lets through few more than ``n`` of them before any are sorted, so the sort does not
    get ``n`` rows of every task.  ``df`` is read three times.
    """
    total = df.count()
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    marked = df.withColumn("_mark", mark)
    wanted = n + 8 * int(n ** 0.5) + 64
    while wanted < total:
        # 13 hex digits of the hash, a fraction of all of which lies below the limit
        below = marked.where(F.substring("_mark", 1, 13) < f"{int(2 ** 52 * (wanted / total)):013x}")
        if below.limit(n).count() >= n:
            marked = below
            break
        wanted *= 2
    return marked.orderBy("_mark", *tie).limit(n).drop("_mark")


def exact_median(df: DataFrame, col: str, accuracy: int = 20_000) -> float | None:
    """Median of the numbers in ``col`` (nulls and NaN left out), in two scans.

    A quantile sketch brackets both middle ranks; the second scan counts what lies below the bracket and every value inside it, at
    most some 6 / ``accuracy`` of the rows.
    """
    value = F.col(col).cast("double")
    values = df.select(value.alias("v")).where(value.isNotNull() & ~F.isnan(value))
    off = 2 / accuracy
    n, cuts = values.agg(F.count("*"), F.percentile_approx("v", [0.5 - off, 0.5 + off], accuracy)).first()
    if n == 0:
        return None
    near = values.where(F.col("v") <= cuts[1]).groupBy(F.when(F.col("v") >= cuts[0], F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = cut_lineage(near).withColumn("upto", F.sum("n").over(W.orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)))
    first, second = (F.min(F.when(F.col("upto") > k, F.col("v"))) for k in ((n - 1) // 2, n // 2))
    return float(sum(upto.where("v IS NOT NULL").agg(first, second).first()) / 2)
