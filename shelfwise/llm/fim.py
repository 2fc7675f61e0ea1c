"""Fill-in-the-middle texts, cut at unit boundaries that are found eight bytes at a time.

A unit is a word with the blanks before it, or the blanks at the end of a text.  The UTF-8 of a text is viewed as 64-bit
words; arithmetic within a word marks every byte that ends a unit, ``bitwise_count`` counts the marks of a word, a search in
the running counts finds the word that holds the k-th end, and clearing marks one by one selects it in that word.
Blanks are single bytes below 0x80, so bytes of longer characters never look like one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import Out, rows, spark_schema

P, S, M = b"<P>", b"<S>", b"<M>"
BLANKS = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 16  # 64-bit words that are marked at once


def _each(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


HIGH, LOW = _each(0x80), _each(0x7F)
SPACE, FROM_TAB, BEYOND_CR = _each(0x20), _each(0x80 - 0x09), _each(0x80 - 0x0E)
EIGHT, TOP = np.uint64(8), np.uint64(56)


def blanks(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D; no sum carries into the next byte."""
    low = x & LOW
    space = ~((low ^ SPACE) + LOW)
    control = (low + FROM_TAB) & ~(low + BEYOND_CR)
    return (space | control) & ~x & HIGH


class Units:
    """Where the units of a text end."""

    def __init__(self, raw: bytes):
        self.length = n = len(raw)
        words = -(-(n + 1) // 8)  # at least one blank follows the text, so a last word ends like any other
        data = np.frombuffer(raw + b" " * (8 * words - n), "<u8")
        self.ends = np.empty(words, np.uint64)
        for a in range(0, words, BLOCK):
            blank = blanks(data[a:a + BLOCK + 1])
            here = blank[:BLOCK]
            follows = here >> EIGHT
            ahead = blank[1:BLOCK + 1]
            follows[:len(ahead)] |= ahead << TOP
            self.ends[a:a + BLOCK] = ~here & HIGH & follows
        if n and raw[-1] in BLANKS:
            self.ends[(n - 1) // 8] |= np.uint64(0x80) << np.uint64(8 * ((n - 1) % 8))
        self.running = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def __len__(self) -> int:
        return int(self.running[-1])

    def cut(self, k: int) -> int:
        """The number of bytes that the first ``k`` units have."""
        if k <= 0:
            return 0
        at = int(np.searchsorted(self.running, k))
        marks = int(self.ends[at])
        for _ in range(k - int(self.running[at] - marks.bit_count()) - 1):
            marks &= marks - 1
        return 8 * at + (marks & -marks).bit_length() // 8


def characters(raw: bytes) -> int:
    """Code points: bytes that do not continue a character."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def draws(doc_id: object, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that depend on seed and id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return tuple(int.from_bytes(hashlib.sha256(name.encode()).digest()[i:i + 4]) for i in (0, 4, 8, 12))


def assemble(form: str, raw: bytes, first: int, second: int) -> bytes:
    """The output for a text whose middle lies between the bytes ``first`` and ``second``."""
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    if form == "psm":
        return P + prefix + S + suffix + M + middle
    if form == "spm":
        return S + suffix + P + prefix + M + middle
    return raw


def restore(form: str, output: bytes) -> bytes:
    """The text that ``output`` was made from; texts of the marked forms hold no marks of their own."""
    if form == "plain":
        return output
    head, _, middle = output.rpartition(M)
    if form == "psm":
        prefix, _, suffix = head.removeprefix(P).partition(S)
    else:
        suffix, _, prefix = head.removeprefix(S).partition(P)
    return prefix + middle + suffix


def _transform(schema: pa.Schema, seed: int, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for doc_id, raw in rows(batches, "doc_id", "text"):
            units = Units(raw)
            n = len(units)
            h1, h2, h3, h4 = draws(doc_id, seed)
            if not raw or h3 % 100 >= rate or P in raw or S in raw or M in raw:
                row = doc_id, n, "plain", None, None, raw
            else:
                form = "spm" if h4 % 100 < spm_rate else "psm"
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                first, second = units.cut(a), units.cut(b)
                row = doc_id, n, form, characters(raw[:first]), characters(raw[first:second]), assemble(form, raw, first, second)
            if out.add(*row, size=len(raw)):
                yield out.take()
        yield out.take()
    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: ``output`` (binary, UTF-8) is the training text.

    Of 100 documents ``rate`` get a marked form, and of 100 of these ``spm_rate`` the one with the suffix first; seed and id decide, so equal
    ids get equal draws and repeated rows equal results.  A null text is empty; empty texts and texts that hold a mark stay plain.  A null id
    draws as an empty one.  Invalid UTF-8 is kept byte by byte, each byte that does not continue a character counting as one.
    Other columns are ignored.  A text is worked on alone, at some 25 bytes of memory a byte.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("n", pa.int64()), ("form", pa.string()),
                        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(_transform(schema, seed, rate, spm_rate), spark_schema(schema))


def _restore(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [restore(form, output) for form, output in zip(part.column("form").to_pylist(), part.column("output").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], schema=schema)
    return run


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with columns form and output) plus ``restored``, the text rebuilt from these two alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(outputs.schema).append(pa.field("restored", pa.binary()))
    return outputs.mapInArrow(_restore(schema), spark_schema(schema))
