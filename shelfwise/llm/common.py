"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts UTF-8 text at exactly these places
CACHE_WORDS = 200_000  # entries a task's word cache may hold before it starts afresh

_A, _B, _S30, _S27, _S31 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def raw_strings(values: list[bytes | None]) -> pa.Array:
    """Bytes as an array of strings, invalid UTF-8 included."""
    held = pa.array(values, pa.binary())
    valid, ends, data = held.buffers()
    return pa.StringArray.from_buffers(len(held), ends, data, valid)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8; null counts as empty.  Binary, so invalid UTF-8 reaches Python unharmed."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class WordHashes(dict):
    """word -> 64-bit hash; filled as words appear."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    runs = max(1, n - k + 1)
    out = np.zeros(runs, np.uint64)
    for j in range(min(k, n)):
        out = mix(out + words[j:j + runs] + np.uint64(j + 1))
    return out


def rows(batches: Iterator[pa.RecordBatch], *columns: str, held: int = 256) -> Iterator[tuple]:
    """Python values of the named columns, row by row, holding a slice of a batch at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, held):
            part = batch.slice(a, held)
            yield from zip(*(part.column(c).to_pylist() for c in columns))
    free_memory()


def free_memory() -> None:
    """Give unused memory back at the end of a task; Spark keeps its Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # the C library's own unused memory, where it is glibc


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Out:
    """Collects rows and hands them on as record batches of bounded length and size."""

    def __init__(self, schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self.held, self.bytes = [], 0

    def add(self, *row, size: int = 0) -> bool:
        """True when the held rows should be yielded."""
        self.held.append(row)
        self.bytes += size
        return len(self.held) >= self.most_rows or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        out = batch(self.schema, list(zip(*self.held)) or [[] for _ in self.schema])
        self.held, self.bytes = [], 0
        return out


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def held_out(id_column: str = "doc_id") -> Column:
    """A quarter of the documents never serves for learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


FILTER_BITS = 1 << 23  # least size of the bit table of ``likely``
MOST_FILTER_BITS = 1 << 28  # 2^22 rows of two numbers, some 64 MB; where a table needs more, there is none
BITS_A_KEY = 8  # so at most one row in eight passes by chance


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash ``key`` may be in ``keys`` (a written table), found without moving them.

    A bit table is broadcast whose size follows from the counted keys.  It never loses a key; what passes by chance is left to the
    join that follows, as are all rows where the keys are too many for a broadcast.
    """
    bits = max(FILTER_BITS, 1 << max(0, BITS_A_KEY * keys.count() - 1).bit_length())
    if bits > MOST_FILTER_BITS:
        return df
    place = F.pmod(F.col(key), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    table_ = keys.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    hit = df.withColumn("__word", word).join(F.broadcast(table_), "__word").where(
        F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1)
    return hit.select(df.columns)
