"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found in a trie kept as tables.

The trie is compressed and lies in an edge table (node, first, label, child): a node is a prefix after which words go on
differently or end, named by a 64-bit hash; a label is the run of code points between two nodes.  The frontier holds states
(word, position, node, edits).  A word's states without an edit are the nodes of its own path.  One edit is spent at such a
node, since a word of the trie can leave another only where the trie branches or a word ends: a replacement takes another
edge, a deletion goes on from the node behind the next code point (of equal ones in a row the last is deleted).  States
with their edit spent then follow the edge table level by level until the word ends; what is left is looked up among the
words.  An insertion is the deletion seen from the other word.  The first half of a word is searched in the trie of the
reversed words, so every search starts below its word's middle, where nodes have few edges.

Hashes only prune: a pair is made of the word itself with its edit, and the lookup compares whole words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import Out, batch, rows, spark_schema, text_bytes
from shelfwise.operators.keyed import join_hot
from shelfwise.session import cut_lineage

LETTERS = "[a-zÀ-ÿ]{%d,}"  # whole runs of a text whose A to Z are in lower case: a match begins where a run does, and a run that is too short has none
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
PREFIXES = pa.schema([("word", pa.string()), ("depth", pa.int32()), ("node", pa.int64()), ("next", pa.string())])
FLUSH_WORDS = 400_000  # distinct words a task counts before it hands them on
LONG_TEXT = 1 << 20  # characters, above which the runs of a text are not listed before they are counted


def _observe(least_length: int, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(LETTERS % least_length)
        counted: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counted)
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                yield batch(COUNTED, [part, [counted[w] for w in part]])
            counted.clear()

        for id_, raw in rows(batches, "id", "text"):
            text = raw.lower().decode("utf-8", "replace")  # of bytes, only A to Z change
            runs = Counter(letters.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in letters.finditer(text)))
            begun = zlib.crc32(f"{id_}:".encode())
            for word, n in runs.items():
                h = zlib.crc32(word.encode(), begun)
                if h % modulus == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                counted[word] += n
            if len(counted) > FLUSH_WORDS:
                yield from flush()
        yield from flush()
    return run


def observed(docs: DataFrame, least_length: int = 1, id_col: str = "doc_id", text_col: str = "text", modulus: int = 97) -> DataFrame:
    """(word, n): occurrences of runs of at least ``least_length`` letters, A to Z in lower case, with the planted slips.

    Where ``modulus`` divides h, the unsigned crc32 of the UTF-8 of ``<id>:<run>``, the run loses its code point h % length.
    A null text has no words, a null id counts as an empty one; bytes that are no UTF-8 belong to no run.  Every task counts what it
    reads, so a word has several rows; repeated rows of ``docs`` count each.
    """
    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_bytes(text_col).alias("text"))
    return read.mapInArrow(_observe(least_length, modulus), spark_schema(COUNTED))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, from the partial counts in ``words`` (word, n)."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a prefix from depth ``begin`` on, the whole word included; hashes are built up code point by code point."""
    import xxhash

    out = Out(PREFIXES)
    for word, begin in rows(batches, "word", "begin"):
        rolling = xxhash.xxh3_64()
        for depth, char in enumerate([*word, None]):
            if depth >= begin:
                node = rolling.intdigest()
                if out.add(word, depth, node - (1 << 64) if node >> 63 else node, char):
                    yield out.take()
            if char is not None:
                rolling.update(char.encode())
    yield out.take()


def trie(words: DataFrame, begin: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, paths) of the compressed trie over ``words`` (word), every word from its depth ``begin`` on.

    edges: node, first, label, child.  paths: word, node, depth, the nodes of each word's own path.
    """
    prefixes = cut_lineage(words.select("word", begin.cast("int").alias("begin")).mapInArrow(_prefixes, spark_schema(PREFIXES)))
    # a prefix is a node if words go on from it in two ways, or if one ends there
    marks = prefixes.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"), F.max(F.col("next").isNull()).alias("ends"))
    nodes = cut_lineage(marks.where("ends OR least <> most").select("node"))
    paths = cut_lineage(join_hot(prefixes.select("word", "depth", "node"), nodes, "node"))
    # the nodes of a word in order: as many as it has code points at most, and one group a word
    steps = paths.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("at"))
    pairs = steps.select("word", F.explode(F.arrays_zip(F.slice("at", 1, F.size("at") - 1).alias("a"), F.slice("at", 2, F.size("at")).alias("b"))).alias("s")).where("s.b IS NOT NULL")
    label = F.substring(F.col("word"), F.col("s.a.depth") + 1, F.col("s.b.depth") - F.col("s.a.depth"))
    edges = pairs.select(F.col("s.a.node").alias("node"), F.substring(label, 1, 1).alias("first"), label.alias("label"), F.col("s.b.node").alias("child")).distinct()
    return cut_lineage(edges), paths


def _rest(column: str, begin: Column, length: Column) -> Column:
    return F.substring(F.col(column), begin, length)


def tail_neighbours(words: DataFrame, begin: Column) -> DataFrame:
    """(word, near): ``near`` is ``word`` with one code point from ``begin`` (counted from 0) on replaced or deleted.

    ``begin`` must grow with the word's length, by one at most a code point.  Everything that differs from a word of ``words`` in that way is found; ``near`` may be no word, which the caller's lookup shows.
    """
    # words at one edit differ by one in length and so by one at most in ``begin``
    edges, paths = trie(words, F.greatest(begin - 1, F.lit(0)))
    size = F.char_length("word")
    own = cut_lineage(paths.where(F.col("depth") >= begin))
    # replacement: another edge of a node on the word's path
    branching = edges.groupBy("node").count().where("count > 1").select("node")
    at, length = F.col("depth"), F.char_length("label")
    forks = own.where(at < size).join(branching, "node", "left_semi")
    others = edges.groupBy("node").agg(F.collect_list(F.struct("first", "label", "child")).alias("edges")).where(F.size("edges") > 1)  # an alphabet's size at most
    spent = join_hot(cut_lineage(forks), others, "node").select("word", "depth", F.explode("edges").alias("e")).select("word", "depth", "e.*")
    replaced = spent.where((F.col("first") != _rest("word", at + 1, F.lit(1))) & (at + length <= size)
                           & (_rest("word", at + 2, length - 1) == F.substring(F.col("label"), F.lit(2), length - 1))).select(
        "word", (at + length).alias("position"), F.col("child").alias("node"),
        F.concat(_rest("word", F.lit(1), at), "first", _rest("word", at + 2, size)).alias("near"))
    # deletion: the last of equal code points in a row goes
    deleted = own.where((at < size) & ((at + 1 == size) | (_rest("word", at + 1, F.lit(1)) != _rest("word", at + 2, F.lit(1))))).select(
        "word", (at + 1).alias("position"), "node", F.concat(_rest("word", F.lit(1), at), _rest("word", at + 2, size)).alias("near"))
    position = F.col("position")

    def written(states: DataFrame) -> DataFrame:
        """The states with the edge that each takes next, null at the end of the word."""
        return cut_lineage(states.withColumn("step", F.when(position < size, F.xxhash64("node", _rest("word", position + 1, F.lit(1))))))

    frontier = written(replaced.unionByName(deleted))
    steps = edges.select(F.xxhash64("node", "first").alias("step"), "label", "child")
    found = []
    while True:
        found.append(frontier.where("step IS NULL").select("word", "near"))
        frontier = written(
            join_hot(frontier.where("step IS NOT NULL"), steps, "step")
            .where((position + length <= size) & (_rest("word", position + 1, length) == F.col("label")))
            .select("word", (position + length).alias("position"), F.col("child").alias("node"), "near"))
        if frontier.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) in both directions: all pairs of ``words`` (word) that differ by one inserted, deleted or replaced code point."""
    size = F.char_length("word")
    behind = tail_neighbours(words, F.floor(size / 2))
    # the other half is the tail of the reversed word
    back = words.select(F.reverse("word").alias("word"))
    before = tail_neighbours(back, size - F.floor(size / 2)).select(F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    pairs = behind.unionByName(before)
    both = pairs.unionByName(pairs.where(F.char_length("near") < size).select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct()


def follow(forms: DataFrame, key: str = "word", to: str = "form") -> DataFrame:
    """(word, root): where the chain of forms that begins with a word ends; steps double, so their number is a logarithm.

    ``forms`` (word, form) has at most one row a word and no cycle.
    """
    step = cut_lineage(forms.select(F.col(key).alias("word"), F.col(to).alias("root")))
    while True:
        next_ = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        doubled = cut_lineage(join_hot(step, next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        step = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            return step


def spelling_variants(counted: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counted`` (word, n).

    A word's form is the near word of largest n (the smallest in code-point order where several have it) if that n is at least
    ``factor`` times, 2 or more, the word's own; ``root`` ends the chain of forms.  ``counted`` has each word once, not null; an empty
    table gives an empty result.  Words of any length and alphabet are compared by code points.
    """
    counted = cut_lineage(counted.select("word", "n"))
    pairs = cut_lineage(near_words(counted))
    known = join_hot(pairs, counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = cut_lineage(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")))
    roots = follow(joined.where("f IS NOT NULL").select("word", F.col("f.form").alias("form")))
    return joined.join(roots, "word", "left").select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.form_n").alias("form_n"))
