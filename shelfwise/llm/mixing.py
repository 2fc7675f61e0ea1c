"""Mixing sources to target weights in fixed-length blocks.

The words of a source, its documents one after another, are cut into blocks of equal length.  Every output
shard draws how many of its slots each source fills: a multinomial draw from what the sources still owe,
made by halving the range of shards again and again, so that each shard's counts and the slots before it
follow from a few draws and the totals are met.  A source's slots run through pseudorandom permutations of
its block numbers, one permutation an epoch, and blocks join documents by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.llm.common import Out, WORD, batch, mix, raw_strings, rows, spark_schema, unused
from shelfwise.session import cut_lineage

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
BUCKET_ROWS = 5000
MAX_DRAW = 500_000_000  # NumPy's own sampler draws from at most so many slots; beyond, ``drawn`` inverts the distribution
KEPT_DRAWS = 100_000  # draws a task remembers; neighbouring shards share all but the last of theirs
ROUNDS = 6


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Places of numbers below ``n`` under a Feistel permutation with cycle walking."""
    side = int(np.ceil(np.sqrt(max(1, n))))
    side += side * side < n
    a, keys = np.uint64(side), mix(np.arange(ROUNDS, dtype=np.uint64) + mix(np.array([int(key) & (2 ** 64 - 1)], np.uint64)))
    x = np.array(x, np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] // a, x[walk] % a
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = (right + a - mix(left + keys[r]) % a) % a, left
            else:
                left, right = right, (left + mix(right + keys[r]) % a) % a
        x[walk] = left * a + right
        walk &= x >= n
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """What the mix takes of one source: ``slots`` blocks, the last of them without its last ``cut`` words."""

    number: int
    size: int
    target: float
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK_WORDS)

    def words(self, block: np.ndarray) -> np.ndarray:
        return np.minimum(BLOCK_WORDS, self.size - block * BLOCK_WORDS)

    def key(self, epoch: int) -> int:
        return (self.seed * 1_000_003 + self.number) * 1_000_003 + epoch

    def plan(self) -> tuple[int, int]:
        """(slots, cut): whole epochs, then blocks in permuted order until the target's words are reached."""
        wanted = round(self.target)
        if not self.size or not wanted:
            return 0, 0
        epochs, rest = divmod(wanted, self.size)
        if not rest:
            return epochs * self.blocks, 0
        short = BLOCK_WORDS * self.blocks - self.size
        place = int(permute(np.array([self.blocks - 1]), self.blocks, self.key(epochs), inverse=True)[0])  # of the short block
        slots = -(-rest // BLOCK_WORDS)
        if place < slots:
            slots = max(place + 1, -(-(rest + short) // BLOCK_WORDS))
        return epochs * self.blocks + slots, slots * BLOCK_WORDS - (short if place < slots else 0) - rest


def drawn(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` slots drawn without replacement are good: a hypergeometric draw at every size.

    Beyond MAX_DRAW the probabilities around the mode follow from the ratios of neighbours, 12 standard deviations to either side
    (what lies outside has less than 1e-30 of the mass), so work and memory grow with the square root of the slots.
    """
    if good + bad <= MAX_DRAW:
        return int(rng.hypergeometric(good, bad, take))
    low, high, total = max(0, take - bad), min(good, take), good + bad
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    spread = (take / total * good * (bad / total) * ((total - take) / max(1, total - 1))) ** 0.5
    reach = int(12 * spread) + 20
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1))])
    mass = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(mass[:-1], rng.random() * mass[-1], side="right"))


def split_draw(quota: np.ndarray, take: int, key: list[int]) -> np.ndarray:
    """How many of ``take`` slots drawn from all that sources owe fall to each source."""
    rng = np.random.default_rng(key)
    total = int(quota.sum())
    if total <= MAX_DRAW:
        return rng.multivariate_hypergeometric(quota, take, method="marginals") if total else quota.copy()
    out = np.zeros_like(quota)
    for i, good in enumerate(quota.tolist()):
        total -= good
        out[i] = drawn(good, total, take, rng)
        take -= int(out[i])
    return out


def draw_counts(quota: np.ndarray, shards: int, shard: int, slots: int, seed: int, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, counts): per source the slots before ``shard`` and in it, the same on every call.

    ``kept`` remembers draws between calls with the same other arguments.
    """
    kept = {} if kept is None else kept
    low, high = 0, shards
    first, quota = np.zeros(len(quota), np.int64), quota.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = kept.get((low, high))
        if left is None:
            if len(kept) >= KEPT_DRAWS:
                kept.clear()
            left = kept[low, high] = split_draw(quota, min((mid - low) * slots, int(quota.sum())), [seed, low, high])
        if shard < mid:
            quota, high = left, mid
        else:
            first, quota, low = first + left, quota - left, mid
    return first, quota


SLOTS = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("source_no", pa.int64()), ("epoch", pa.int64()), ("block", pa.int64()), ("words", pa.int64())])


def _slots(sources: list[Source], shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = [s.plan() for s in sources]
        quota = np.array([p[0] for p in plans], np.int64)
        kept: dict = {}
        for b in batches:
            for shard in b.column(0).to_pylist():
                first, counts = draw_counts(quota, shards, shard, SHARD_SLOTS, seed, kept)
                parts = []
                for s, (slots, cut), a, n in zip(sources, plans, first.tolist(), counts.tolist()):
                    if not n:
                        continue
                    at = np.arange(a, a + n)
                    epoch, inside = np.divmod(at, s.blocks)
                    block = np.empty(n, np.int64)
                    for e in np.unique(epoch):
                        block[epoch == e] = permute(inside[epoch == e], s.blocks, s.key(int(e)))
                    words = s.words(block) - np.where(at == slots - 1, cut, 0)
                    parts.append((np.full(n, s.number), epoch, block, words))
                if not parts:
                    continue
                number, epoch, block, words = (np.concatenate(x) for x in zip(*parts))
                order = permute(np.arange(len(number)), len(number), seed + 31 * shard)  # sources interleave within the shard
                yield batch(SLOTS, [np.full(len(number), shard), order, number, epoch, block, words])
    return run


@dataclass(frozen=True)
class Mix:
    sources: DataFrame  # (source, source_no, source_size, target), a row per source
    placed: DataFrame  # (doc_id, source, source_no, size, first): a document's words lie in its source from ``first`` on
    slots: DataFrame  # (shard, slot, source_no, epoch, block, words)

    def pieces(self) -> DataFrame:
        """(shard, slot, epoch, source_no, block, doc_id, first, start, words): which words of which documents fill a slot."""
        return self.slots.join(_blocks(self.placed), ["source_no", "block"]).select(
            "shard", "slot", "epoch", "source_no", "block", "doc_id", "first", "start",
            F.least("n", F.col("words") - F.col("at")).alias("words")).where("words > 0")

    def taken(self) -> DataFrame:
        """(doc_id, source, size, taken) of every document; words taken twice count twice."""
        full = self.slots.groupBy("source_no", "block", "words").agg(F.count(F.lit(1)).alias("times"))
        parts = full.join(_blocks(self.placed), ["source_no", "block"]).select(
            "source_no", "first", (F.col("times") * F.greatest(F.lit(0), F.least("n", F.col("words") - F.col("at")))).alias("taken"))
        parts = parts.groupBy("source_no", "first").agg(F.sum("taken").alias("taken"))
        return self.placed.join(parts, ["source_no", "first"], "left").select(
            "doc_id", "source", "source_no", "size", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def _blocks(placed: DataFrame) -> DataFrame:
    """(source_no, block, doc_id, first, start, at, n): ``n`` words of a document from its word ``start`` fill a block from its word ``at``."""
    last = F.col("first") + F.col("size") - 1
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK_WORDS}"), F.call_function("div", last, F.lit(BLOCK_WORDS)))))
    begin = F.greatest("first", F.col("block") * BLOCK_WORDS)
    end = F.least(last + 1, (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select("source_no", "block", "doc_id", "first", (begin - F.col("first")).alias("start"), (begin - F.col("block") * BLOCK_WORDS).alias("at"), (end - begin).alias("n"))


def mix_sources(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, seed: int = 11,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan a mix of ``share`` of all words in which sources (by code point, null last) weigh ``weights``, repeating.

    No source is taken more than ``most`` times over.  A null text has no words and is taken 0 times.  The same rows
    give the same mix on every run and layout; equal rows are told apart by nothing, and share what is taken evenly enough.
    One row per source reaches the driver (the list of weights has that length too).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    # Python orders text by code point
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    plans = [Source(i, s, t, seed) for i, (s, t) in enumerate(zip(sizes, targets))]
    spark = docs.sparkSession
    sources = spark.createDataFrame([(r.source, i, s, t) for i, (r, s, t) in enumerate(zip(totals, sizes, targets))],
                                    "source string, source_no long, source_size long, target double")

    # documents get their place by counts per bucket of a source, so no source is ordered in one task
    total = sum(r.n for r in totals)
    buckets = max(1, total // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets))).join(
        F.broadcast(sources.select(F.col("source").alias("s"), "source_no")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    offsets = sized.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(F.col("doc_id"), F.col("h"))
    placed = sized.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, ["source_no", "bucket"])
    placed = cut_lineage(placed.select("doc_id", "h", "source", "source_no", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("first")))

    slots = sum(p.plan()[0] for p in plans)
    shards = max(1, -(-slots // SHARD_SLOTS))
    drawn = spark.range(shards, numPartitions=min(shards, 1000)).mapInArrow(_slots(plans, shards, seed), spark_schema(SLOTS))
    return Mix(sources, placed, cut_lineage(drawn))


def _slice(schema: pa.Schema, index: int, text_index: int):
    """Cut the words [start, start + words) of a text, with the blanks between them; the last three columns are start, words and all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD.encode())
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                columns = part.columns[:len(schema)]
                texts = columns[text_index].cast(pa.binary()).to_pylist()
                lengths = columns[index].to_pylist() if index >= 0 else None
                for i, (start, words, size) in enumerate(zip(*(c.to_pylist() for c in part.columns[len(schema):]))):
                    if words < size:
                        spans = [m.span() for m in word.finditer(texts[i])]
                        texts[i] = texts[i][spans[start][0]:spans[start + words - 1][1]]
                        if lengths:
                            lengths[i] = len(texts[i].decode("utf-8", "replace"))
                columns[text_index] = raw_strings(texts)
                if lengths:
                    columns[index] = pa.array(lengths, schema.field(index).type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document once per epoch that takes all of it, and each run of words that an epoch takes of it.

    ``length_col``, where there is one, becomes the length of a cut text.  Empty documents are not taken.  Other columns may have
    any names; bytes that are no valid UTF-8 are parts of words and stay as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # runs of adjoining pieces within an epoch
    of_id, h, begin, words, size = unused(docs, "of_id", "h", "start", "words", "size")
    one = ["source_no", "first"]  # a document with words
    pieces = mix.pieces().select(*one, "epoch", "start", "words")
    by = Window.partitionBy(*one, "epoch").orderBy("start")
    joined = pieces.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("words")).over(by), F.lit(-1))).cast("int")).withColumn(
        "run", F.sum("new").over(by)).groupBy(*one, "epoch", "run").agg(F.min("start").alias("start"), F.sum("words").alias("words"))
    runs = joined.join(mix.placed.where("size > 0").select(*one, "doc_id", "h", "size"), one).select(
        F.col("doc_id").alias(of_id), F.col("h").alias(h), F.col("start").alias(begin), F.col("words").alias(words), F.col("size").alias(size))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(h, F.xxhash64(text)).dropDuplicates([id_col, h])  # equal rows of one id have their runs under one key
    full = keyed.join(runs, F.col(id_col).eqNullSafe(F.col(of_id)) & (keyed[h] == runs[h]))
    schema = pa.schema([f.with_nullable(True) for f in to_arrow_schema(docs.schema)])
    index = docs.columns.index(length_col) if length_col in docs.columns else -1
    return full.select(*docs.columns, begin, words, size).mapInArrow(_slice(schema, index, docs.columns.index(text_col)), docs.schema)
