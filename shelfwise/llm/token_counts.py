"""Edit-aware token counts.

The state of a document is its text and a segment tree: leaves are runs of pre-tokens, every node holds
the characters and tokens below it.  An edit finds its leaves by descending the character sums, the text
from the start of the first one is split again until a cut meets an old leaf boundary behind the edit
(pre-token patterns look little ahead and never behind, so everything beyond stays as it is), and only
the sums above the touched leaves change.  Edits mark their leaves, so a region that many edits touch is
encoded once.  Documents and edits meet by one shuffle and are worked
through as a stream, an edit at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import Out, rows, spark_schema, text_bytes

LEAF = 32  # pre-tokens of a new leaf
CACHE = 300_000
LONG_PRETOKEN = 64


class Tokenizer(dict):
    """Counts tokens of pre-tokens with a byte-level BPE rank file; as a dictionary it keeps the counts of short pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)

    def __missing__(self, pretoken: str) -> int:
        n = len(self.encoding.encode_ordinary(pretoken))
        if len(pretoken) <= LONG_PRETOKEN:
            self[pretoken] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self) > CACHE:
            self.clear()
        return list(map(self.__getitem__, pieces))

    def leaves(self, pieces: list[str]) -> np.ndarray:
        """(characters, pre-tokens, tokens) of new leaves for these pre-tokens, a row a leaf."""
        n = len(pieces)
        if n == 0:
            return np.zeros((0, 3), np.int64)
        each = np.array([list(map(len, pieces)), [1] * n, self.counts(pieces)], np.int64)
        return np.add.reduceat(each, np.arange(0, n, LEAF), axis=1).T


class Tree:
    """Segment tree over leaf texts; node i has the children 2i and 2i + 1, a node sums (characters, pre-tokens, tokens).

    Edits change texts and character sums at once and mark leaves; ``settle`` encodes the marked regions.
    """

    def __init__(self, text: str, leaves: np.ndarray):
        ends = np.cumsum(leaves[:, 0]).tolist()
        self.encoded = 0  # pre-tokens that edits had encoded
        self.build([text[a:b] for a, b in zip([0, *ends], ends)], *leaves.T.tolist())

    def build(self, texts: list[str], *leaves: list[int]) -> None:
        self.size = 1 << max(0, len(texts) - 1).bit_length()
        spare = self.size - len(texts)
        self.texts = texts + [""] * spare
        self.dirty: set[int] = set()
        self.sums = []
        for values in leaves:
            tree = [0] * self.size + values + [0] * spare
            for node in range(self.size - 1, 0, -1):
                tree[node] = tree[2 * node] + tree[2 * node + 1]
            self.sums.append(tree)

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf with character ``offset``; the last leaf with text for the end of the text."""
        chars, node, start = self.sums[0], 1, 0
        while node < self.size:
            node *= 2
            if offset >= start + chars[node] and chars[node + 1]:
                start += chars[node]
                node += 1
        return node - self.size, start

    def put(self, kind: int, leaf: int, value: int) -> None:
        tree, node = self.sums[kind], leaf + self.size
        change = value - tree[node]
        while change and node:
            tree[node] += change
            node //= 2

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` by ``new``; both are cut to the text's bounds."""
        total = self.sums[0][1]
        start = min(max(start, 0), total)
        end = min(start + max(length, 0), total)
        first, at = self.find(start)
        last, last_at = self.find(end) if end > start else (first, at)
        tail = self.texts[last][end - last_at:]
        self.texts[first] = self.texts[first][:start - at] + new + tail
        for leaf in range(first + 1, last + 1):
            self.texts[leaf] = ""
            self.put(0, leaf, 0)
            self.dirty.add(leaf)
        self.put(0, first, len(self.texts[first]))
        self.dirty.add(first)
        # a pre-token that ends within two characters before the edit may now match further
        near = start - at
        while near < 2 and first:
            first -= 1
            near += len(self.texts[first])
            self.dirty.add(first)

    def settle(self, tokenizer: Tokenizer) -> None:
        """Encode the marked leaves again, each from its start until a cut meets the start of an unmarked leaf.

        Patterns look ahead by two characters at most and never behind, so what follows stays as it is.
        """
        grown: dict[int, list[str]] = {}
        done = 0
        for first in sorted(self.dirty):
            if first < done:
                continue
            found, done = self.again(tokenizer, first)
            self.encoded += len(found)
            slots = done - first
            each = max(LEAF, -(-len(found) // slots))
            if each > 4 * LEAF:
                grown[first] = found
            counts = tokenizer.counts(found)
            for i in range(slots):
                part = slice(i * each, (i + 1) * each)
                self.texts[first + i] = "".join(found[part])
                for kind, value in enumerate((len(self.texts[first + i]), len(found[part]), sum(counts[part]))):
                    self.put(kind, first + i, value)
        self.dirty.clear()
        if grown:
            self.split_leaves(tokenizer, grown)

    def again(self, tokenizer: Tokenizer, first: int) -> tuple[list[str], int]:
        """(pre-tokens, next leaf) of the region that begins with leaf ``first``."""
        beyond = 1
        while True:
            clean, at, starts, parts, leaf = 0, 0, {}, [], first
            while leaf < self.size and clean < beyond:
                text = self.texts[leaf]
                if leaf not in self.dirty and text:
                    starts[at] = leaf
                    clean += 1
                parts.append(text)
                at += len(text)
                leaf += 1
            window, whole, found = "".join(parts), leaf == self.size, []
            if 0 in starts:
                return found, starts[0]
            for m in tokenizer.split.finditer(window):
                found.append(m.group())
                cut = m.end()
                if cut in starts and (whole or cut + 2 <= len(window)):
                    return found, starts[cut]
            if whole:
                return found, self.size
            beyond *= 2

    def split_leaves(self, tokenizer: Tokenizer, grown: dict[int, list[str]]) -> None:
        """Build the tree anew with more leaves where edits put much text; empty leaves go."""
        texts, leaves, skip = [], [], 0
        for leaf in range(self.size):
            if leaf in grown:
                pieces = grown[leaf]
                parts = tokenizer.leaves(pieces)
                texts += ["".join(pieces[a:a + LEAF]) for a in range(0, len(pieces), LEAF)]
                leaves += parts.tolist()
                skip = sum(map(len, pieces))
            if skip:
                skip -= len(self.texts[leaf])  # the slots that hold these pieces now
            elif self.texts[leaf]:
                texts.append(self.texts[leaf])
                leaves.append([s[self.size + leaf] for s in self.sums])
        self.build(texts, *map(list, zip(*leaves)))


def _build(schema: pa.Schema, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path, pattern)
        out = Out(schema)
        for doc_id, raw in rows(batches, "doc_id", "text"):
            text = raw.decode("utf-8", "replace")
            leaves = tokenizer.leaves(tokenizer.split.findall(text))
            _, pretokens, tokens = leaves.sum(axis=0).tolist()
            if out.add(doc_id, text, leaves.astype("<i4").tobytes(), pretokens, tokens, size=len(raw)):
                yield out.take()
        yield out.take()
    return run


def _state_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("text", pa.string()), ("leaves", pa.binary()), ("pretokens", pa.int64()), ("tokens", pa.int64())])


def _id_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def build_trees(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, leaves, pretokens, tokens): the state that edits are applied to.

    ``leaves`` holds three 32-bit numbers a leaf: characters, pre-tokens, tokens.  A null text is empty and has no leaf.  Other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = _state_schema(_id_type(docs, id_col))
    return named.mapInArrow(_build(schema, ranks, pattern), spark_schema(schema))


def _apply(schema: pa.Schema, path: str, pattern: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path, pattern)
        out = Out(schema)
        tree, row, edits, copies, last = None, None, 0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            tree.settle(tokenizer)
            chars, pretokens, tokens = (x[1] for x in tree.sums)
            state = ()
            if with_text:
                leaves = np.array([x[tree.size:] for x in tree.sums], "<i4").T
                state = (tree.text, leaves[leaves[:, 0] > 0].tobytes())
            for _ in range(copies):
                if out.add(row[0], *state, pretokens, tokens, row[1], row[2], edits, tree.encoded, chars, size=chars if with_text else 0):
                    yield out.take()

        for doc_id, h, text, leaves, pretokens, tokens, *change in rows(
                batches, "doc_id", "text_hash", "text", "leaves", "pretokens", "tokens", "edit_no", "start", "length", "replacement"):
            if leaves is not None:
                if tree is not None and (doc_id, h, text) == (row[0], row[3], row[4]):
                    copies += 1  # the same row again, before its edits
                    continue
                if tree is not None:
                    yield from done()
                tree = Tree(text, np.frombuffer(leaves, "<i4").reshape(-1, 3))
                row, edits, copies, last = (doc_id, pretokens, tokens, h, text), 0, 1, None
            elif tree is not None and doc_id is not None and doc_id == row[0] and h in (None, row[3]) and (h is None or change != last):
                _, start, length, replacement = change
                tree.edit(start or 0, length or 0, replacement or "")
                edits, last = edits + 1, change
        if tree is not None:
            yield from done()
        yield out.take()
    return run


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: str, pattern: str, with_text: bool = True) -> DataFrame:
    """The state after ``edits`` (doc_id, edit_no, start, length, replacement), with ``tokens_before``, ``edits`` and ``encoded_pretokens``.

    Edits of a document apply in the order of ``edit_no``; ``start`` and ``length`` are characters of the text as the edits before have left it,
    beyond its end they are cut, null counts as 0 or as the empty text.  Edits of unknown or null ids change nothing.  Edits may
    name the text they were made for (``text_hash``, Spark's xxhash64 of it, as :func:`redactions` does): where an id is repeated with
    different texts each row gets its own, a row that is repeated gets them once each time, and so do rows that share a text.  Edits
    of a table without that column apply to the rows of the id that come last by hash of the text.  An id's edits stream past its tree, so any number of them needs no more memory.
    """
    id_type = _id_type(trees, "doc_id")
    none = {"text": "string", "leaves": "binary", "pretokens": "long", "tokens": "long"}
    h = F.col("text_hash").cast("long") if "text_hash" in edits.columns else F.lit(None).cast("long").alias("text_hash")
    e = edits.select(F.col("doc_id").cast(trees.schema["doc_id"].dataType), h, *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
                     F.col("edit_no").cast("long"), F.col("start").cast("long"), F.col("length").cast("long"), F.col("replacement").cast("string"))
    t = trees.select("doc_id", F.xxhash64("text").alias("text_hash"), *none, *[F.lit(None).cast("long").alias(c) for c in ("edit_no", "start", "length")], F.lit(None).cast("string").alias("replacement"))
    # rows without an id can have no edits; they are dealt by their text, as are the rows of an id when all edits name theirs
    own = ["doc_id", "text_hash"] if "text_hash" in edits.columns else ["doc_id"]
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(*own))
    both = t.unionByName(e).repartition(key).sortWithinPartitions(
        "doc_id", F.col("text_hash").asc_nulls_last(), F.col("leaves").isNull(), "text", "edit_no", "start", "length", "replacement")
    state = [("text", pa.string()), ("leaves", pa.binary())] if with_text else []
    schema = pa.schema([("doc_id", id_type), *state, ("pretokens", pa.int64()), ("tokens", pa.int64()), ("pretokens_before", pa.int64()),
                        ("tokens_before", pa.int64()), ("edits", pa.int64()), ("encoded_pretokens", pa.int64()), ("chars", pa.int64())])
    return both.mapInArrow(_apply(schema, ranks, pattern, with_text), spark_schema(schema))


EDITS = [("edit_no", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("replacement", pa.string()), ("text_hash", pa.int64())]


def _redact(schema: pa.Schema, rules: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        patterns = [(regex.compile(p), need, new) for p, need, new in rules]
        out = Out(schema)
        for doc_id, raw in rows(batches, "doc_id", "text"):
            text = raw.decode("utf-8", "replace")
            found = sorted((m.start(), i, m.end(), new) for i, (p, need, new) in enumerate(patterns) if need in text for m in p.finditer(text))
            places, upto = [], 0
            for start, _, end, new in found:
                if start >= upto:
                    places.append((start, end - start, new))
                    upto = end
            # from the end to the start, so that no edit moves the next
            for n, (start, length, new) in enumerate(reversed(places)):
                if out.add(doc_id, n, start, length, new, text_hash(text)):
                    yield out.take()
        yield out.take()
    return run


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def redactions(docs: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits (doc_id, edit_no, start, length, replacement, text_hash) that put a rule's replacement in place of every match of its pattern.

    A rule is (pattern, text that every match has, replacement).  Of matches that overlap, the first stays.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = pa.schema([("doc_id", _id_type(docs, id_col)), *EDITS])
    return named.mapInArrow(_redact(schema, rules), spark_schema(schema))
