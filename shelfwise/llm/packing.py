"""Vector bin packing by the dot-product heuristic, and documents cut into token pieces for it.

A sequence has several limits at once (tokens, segments, loss-bearing tokens).  A bin is filled by taking,
again and again, the example that fits and whose demand vector has the largest dot product with what the
bin has left, each dimension weighted by its mean demand.  Tasks work on bounded buffers; badly filled
bins are opened again with the next buffer, so only a task's last bins stay short.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfwise.llm.common import Out, rows, spark_schema, text_bytes
from shelfwise.session import cut_lineage

BUFFER = 2048  # examples a task packs at a time
GROUP_ROWS = 32_768  # examples a task packs in all
WELL_FILLED = 0.985
CACHE_CHUNKS = 250_000
CACHE_PLAIN = 150_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LONG_CHUNK = 64


def fill_bins(demand: np.ndarray) -> list[list[int]]:
    """Bins of row numbers; ``demand`` holds shares of each limit.  A row over a limit gets a bin of its own."""
    bins: list[list[int]] = []
    alone = (demand > 1).any(axis=1) | (demand >= 1).any(axis=1)
    bins += [[int(i)] for i in np.flatnonzero(alone)]
    left = np.flatnonzero(~alone)
    if len(left) == 0:
        return bins
    weight = demand[left].mean(axis=0)
    # equal scores go to the lower row number; large examples first keeps the scan short
    left = left[np.argsort(-(demand[left] @ weight), kind="stable")]
    while len(left):
        now = demand[left]
        weighted = now * weight
        free = np.ones(now.shape[1])
        open_ = np.ones(len(left), bool)
        taken = []
        while True:
            fits = open_ & (now <= free + 1e-12).all(axis=1)
            if not fits.any():
                break
            at = int(np.argmax(np.where(fits, weighted @ free, -1.0)))
            taken.append(int(left[at]))
            open_[at] = False
            free = free - now[at]
        bins.append(taken)
        left = left[open_]
    return bins


def _pack(schema: pa.Schema, names: list[str], limits: list[float], length: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: pa.Table | None = None

        def packed(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            nonlocal number
            demand = np.stack([np.nan_to_num(table.column(c).to_numpy().astype(np.float64)) for c in names], axis=1) / np.array(limits)
            order, sequence, offset, back = [], [], [], []
            tokens = np.nan_to_num(table.column(length).to_numpy().astype(np.float64)).astype(np.int64)
            for members in fill_bins(demand):
                if not last and demand[members].sum(axis=0).max() < WELL_FILLED and len(back) < BUFFER // 2:
                    back += members
                    continue
                order += members
                sequence += [number] * len(members)
                offset += (np.cumsum(tokens[members]) - tokens[members]).tolist()
                number += 1
            out = table.take(pa.array(order, pa.int64())).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            return out, table.take(pa.array(sorted(back), pa.int64()))

        for b in batches:
            for a in range(0, b.num_rows, BUFFER // 2):
                part = pa.Table.from_batches([b.slice(a, BUFFER // 2)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows >= BUFFER:
                    out, held = packed(held, False)
                    yield from out.cast(schema).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from packed(held, True)[0].cast(schema).combine_chunks().to_batches()
    return run


def pack(items: DataFrame, limits: dict[str, float], length: str, spread: list[str]) -> DataFrame:
    """``items`` plus (sequence_id, offset): sequences whose sums stay within every limit.

    ``limits`` names a numeric column per limit; ``length`` is the column whose running sum is the offset;
    ``spread`` are columns that deal the rows over the tasks and order them there.  A null demand counts as 0; an example that alone
    exceeds a limit has a sequence of its own.  An empty table gives an empty result.  ``items`` must be a
    table that reads the same when read again, and have no column called sequence_id or offset.
    """
    import pyarrow as pa_
    from pyspark.sql.pandas.types import to_arrow_schema

    groups = max(1, -(-items.count() // GROUP_ROWS))
    keys = [F.col(f"`{c}`") for c in spread]
    dealt = items.repartition(groups, F.xxhash64(*keys)).sortWithinPartitions(*keys)
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = pa_.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    return dealt.mapInArrow(_pack(arrow, list(limits), [float(x) for x in limits.values()], length), schema)


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit numbers, each distinct chunk encoded once.

    Blanks and line ends end every pre-token, so a text is encoded chunk by chunk.  A chunk of Latin letters with marks behind
    them has the letters, in lower case, and the marks as pre-tokens; the vocabulary's model encodes a word by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # letters whose lower case is one letter
        self.plain = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        # the printable stand-in of every byte of such letters in UTF-8, as byte-level vocabularies write them
        self.stands = {i: 0x100 + 33 + i - 0x7F if i < 0xA1 else 0x143 if i == 0xAD else i for i in range(0x7F, 0x100)}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, c: str) -> bytes:
        got = self.chunks.get(c)
        if got is not None:
            return got
        stem = c.rstrip(MARKS)
        if not stem or len(c) > LONG_CHUNK or not self.plain(stem):
            got = self.ids(c)
            if len(c) <= LONG_CHUNK:
                self.chunks[c] = got
            return got
        word, marks = stem.lower(), c[len(stem):]
        got = self.words.get(word)
        if got is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.stands)
            got = self.words[word] = array("I", [t.id for t in self.model(letters)]).tobytes()
        if marks:
            got += self.chunk(marks)
        self.chunks[c] = got
        return got

    def encode(self, text: str) -> bytes:
        if len(self.chunks) > CACHE_CHUNKS or len(self.words) > CACHE_PLAIN:
            self.chunks.clear()
            self.words.clear()
        chunks = text.replace("\n", " ").split(" ")
        got = list(map(self.chunks.get, chunks))
        if None in got:
            got = [self.chunk(c) if b is None else b for b, c in zip(got, chunks)]
        return b"".join(got)


def _cut(schema: pa.Schema, path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        end, out = struct.pack("<I", end_id), Out(schema)
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = memoryview(encoder.encode(text.decode("utf-8", "replace")) + end)
            n = len(ids) // 4
            for start in range(0, n, capacity):
                piece = ids[4 * start:4 * (start + capacity)]
                row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                if out.add(*row, *([bytes(piece)] if with_ids else []), size=len(piece) if with_ids else 0):
                    yield out.take()
        yield out.take()
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids, cut after each ``capacity`` of them.

    A null text is empty and has the end id alone.  ``tokenizer`` is a file that every worker has, whose pre-tokens end at blanks and line ends.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    fields = [("doc_id", to_arrow_type(named.schema["doc_id"].dataType)), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))
    return named.mapInArrow(_cut(schema, tokenizer, capacity, end_id, with_ids), spark_schema(schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, max_segments: int = 512, end_id: int = 2,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", loss: Column | None = None) -> DataFrame:
    """Pieces of all documents with (sequence_id, offset); every id counts towards the loss unless ``loss`` says how many do."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col)
                         .withColumn("segments", F.lit(1)).withColumn("loss_tokens", (F.col("length") if loss is None else loss).cast("long")))
    limits = {"length": capacity, "segments": max_segments, "loss_tokens": capacity}
    return pack(pieces, limits, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"]).drop("segments")
