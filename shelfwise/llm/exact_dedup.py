"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every task sorts the fingerprints of its rows, Golomb-codes the gaps and sends each range of values to
the owner of that range.  An owner merges the lists it gets and answers every list with a bitmap of the
values that some other row also has.  Only rows behind a set bit are suspects; their texts are compared
as bytes (they are the key of an aggregation, combined in every task before the shuffle, so a large
group of copies sends one row per task).  Fingerprints are as short as the table allows, because a
chance match only makes one more suspect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import batch, spark_schema, unused
from shelfwise.session import cut_lineage

SPARE_BITS = 12  # one unique text in 2**12 is a suspect by chance
LIST_ROWS = 1 << 20  # fingerprints a task holds before it sends its lists
OWNER_ROWS = 1 << 18  # fingerprints an owner is meant to merge

LISTS = pa.schema([("list_id", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("rice", pa.int64()),
                   ("gaps", pa.binary()), ("twice", pa.binary())])
BITMAPS = pa.schema([("list_id", pa.int64()), ("owner", pa.int64()), ("bits", pa.binary())])
FOUND = pa.schema([("fp", pa.int64())])


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(parameter, code) of sorted distinct non-negative values below 2**62: unary quotients, then remainders."""
    if len(values) == 0:
        return 0, b""
    gaps = np.diff(values, prepend=0).astype(np.int64)
    rice = max(0, int(math.log2(max(1.0, float(gaps.mean()) * math.log(2)))))
    quotients = gaps >> rice
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(rice - 1, -1, -1)) & 1
    return rice, np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def golomb_decode(n: int, rice: int, code: bytes) -> np.ndarray:
    if n == 0:
        return np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1:ends[-1] + 1 + n * rice].reshape(n, rice).astype(np.int64)
    return np.cumsum((quotients << rice) + (rest << np.arange(rice - 1, -1, -1)).sum(axis=1))


def _send(owner_shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0

        def lists(held: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sent
            values, times = np.unique(np.concatenate(held), return_counts=True)
            list_id = (TaskContext.get().partitionId() << 24) + sent
            sent += 1
            owners, starts = np.unique(values >> owner_shift, return_index=True)
            out = []
            for owner, a, b in zip(owners.tolist(), starts, [*starts[1:], len(values)]):
                rice, code = golomb_encode(values[a:b] - (owner << owner_shift))
                out.append((list_id, owner, int(b - a), rice, code, np.packbits(times[a:b] > 1).tobytes()))
            return batch(LISTS, list(zip(*out)))

        held, n = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= LIST_ROWS:
                yield lists(held)
                held, n = [], 0
        if n:
            yield lists(held)
    return run


def _answer(lists: pa.Table) -> pa.Table:
    """The owner's bitmaps: which values of a list occur twice, in it or in any other list."""
    got = lists.to_pylist()
    values = [golomb_decode(x["n"], x["rice"], x["gaps"]) for x in got]
    twice = [np.unpackbits(np.frombuffer(x["twice"], np.uint8), count=x["n"]).astype(bool) for x in got]
    distinct, times = np.unique(np.concatenate(values), return_counts=True)
    bits = [np.packbits(t | (times[np.searchsorted(distinct, v)] > 1)).tobytes() for v, t in zip(values, twice)]
    return pa.Table.from_batches([batch(BITMAPS, [[x["list_id"] for x in got], [x["owner"] for x in got], bits])])


def _receive(owner_shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, np.int64)]
            for x in b.to_pylist():
                marked = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).astype(bool)
                found.append(golomb_decode(x["n"], x["rice"], x["gaps"])[marked] + (x["owner"] << owner_shift))
            yield batch(FOUND, [np.concatenate(found)])
    return run


def suspect_fingerprints(docs: DataFrame, fingerprint: Column, bits: int, owners: int) -> DataFrame:
    """(fp): fingerprints that at least two rows of ``docs`` have."""
    shift = bits - (owners - 1).bit_length()
    lists = cut_lineage(docs.select(fingerprint.alias("fp")).mapInArrow(_send(shift), spark_schema(LISTS)))
    bitmaps = lists.groupBy("owner").applyInArrow(_answer, spark_schema(BITMAPS))
    found = lists.drop("twice").join(bitmaps, ["list_id", "owner"]).mapInArrow(_receive(shift), spark_schema(FOUND)).distinct()
    return cut_lineage(found)  # written, so Spark knows its size and moves only suspect texts while it is small


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_sha256, keep_id, group_size) of every text that at least two rows share, compared byte by byte."""
    n = docs.count()
    owner_bits = max(4, (n // OWNER_ROWS).bit_length())
    owners, bits = 1 << owner_bits, min(61, max(owner_bits + 1, n.bit_length() + SPARE_BITS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    fingerprint = F.shiftrightunsigned(F.xxhash64(text), 64 - bits)
    suspects = suspect_fingerprints(docs, fingerprint, bits, owners)
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), fingerprint.alias("fp"))
    return (
        named.join(suspects, "fp", "left_semi")
        .groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when their bytes are; null counts as empty.  Of equal texts the largest id stays, and
    ``kept`` is true on every row that has it (a repeated row is the same document twice; a null id is
    smaller than any other).  Other columns are ignored.
    """
    groups = copy_groups(docs, id_col, text_col)
    marked = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")).join(
        groups.withColumnRenamed("keep_id", "of_group"), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("of_group"))
    return marked.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, columns unchanged, whatever their names; of a repeated row one stays."""
    sha, hit, kept = unused(docs, "text_sha256", "in_group", "keep_id")
    groups = copy_groups(docs, id_col, text_col).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(kept), F.lit(True).alias(hit))
    known = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(groups, sha, "left")
    single = known.where(F.col(hit).isNull()).select(docs.columns)
    # one row of each group, chosen by id; equal rows of one id are told apart by nothing that matters
    best = known.where(F.col(hit) & F.col(id_col).eqNullSafe(F.col(kept)))
    return single.unionByName(best.dropDuplicates([sha]).select(docs.columns))
