"""Exact Jaccard join of word shingle sets by universe partition and the pigeonhole principle.

The universe of shingles is cut by hash into segments, as many as the size band needs: two sets that are
similar enough differ in at most H shingles, so of H + 1 segments one is equal in both.  Segments that would
cost too much (one shingle, or frequent ones only) get allocation 0, and spare segments stand in for them;
small bands get allocation 2, where a segment may differ by one shingle and the subsets with one shingle
deleted are indexed too.  A set with more weak segments than spares is indexed by its rare shingles.
So every similar pair meets in some bucket.  The members of a large bucket are first compared with its centre,
the set that most large buckets have in common (the text that others were copied from).  Where several
components are left in a bucket, its sets are compared block against block, each pair of blocks once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.llm.common import Out, WordHashes, batch, free_memory, likely, mix, rows, shingle_hashes, spark_schema, text_bytes, unused
from shelfwise.llm.exchange import BLOBS, owner_bits, pack, unpack
from shelfwise.llm.graph import components, spanning
from shelfwise.session import cut_lineage

LIGHT = 12  # members of a bucket whose pairs are all listed
FLUSH = 500_000  # signatures a task holds
FLUSH_DOCS = 50_000
OWNER_DOCS = 8192
SLICE = 1 << 21  # signatures that an owner sorts at once
SAMPLE_DOCS = 8192  # distinct texts from which frequent shingles are told
FREQUENT = 5  # texts of the sample that a frequent shingle is in
BLOCK = 128  # sets of large buckets that are compared as one block
SLAB = 16_384  # shingles a block comparison holds as a matrix
FREQUENT_MOST = 1_000_000  # the most frequent ones; this choice steers cost, never results

PAIRS = [("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())]
DOCUMENTS = 3  # kind of a blob that carries documents (ids, set keys, set sizes, text hashes) instead of signatures
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``num`` / ``den``."""

    num: int
    den: int

    def fits(self, a, b):
        """Sizes that similar sets may have."""
        return np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num

    def similar(self, common: int, union: int) -> bool:
        return self.den * common >= self.num * union

    @functools.cached_property
    def edges(self) -> np.ndarray:
        """First sizes of the bands; similar sets lie in one band or in two neighbours."""
        out = [1]
        while out[-1] < 1 << 31:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out)

    def difference(self, n: int) -> int:
        """Most shingles in which a set of ``n`` and a similar set not smaller differ."""
        return (self.den - self.num) * (n + n * self.den // self.num) // (self.den + self.num)

    @functools.cached_property
    def _plans(self) -> dict[int, tuple[int, int, int, int]]:
        return {}

    def plan(self, group: int) -> tuple[int, int, int, int]:
        """(H, allocation, segments, spares) for pairs whose smaller set is in band ``group``."""
        if group not in self._plans:
            self._plans[group] = self._planned(group)
        return self._plans[group]

    def _planned(self, group: int) -> tuple[int, int, int, int]:
        low, high = int(self.edges[group]), int(self.edges[group + 1]) - 1
        h = self.difference(high)
        best = None
        for allocation in (1, 2):
            need = -(-(h + 1) // allocation)
            for spare in range(0, need + 8):
                segments = need + spare
                mean = low / segments
                if mean < 2.5:
                    break
                weak = segments * math.exp(-mean) * (1 + mean + (mean * mean / 2 if allocation == 2 else 0))
                term, tail = math.exp(-weak), 1.0
                for k in range(spare + 1):  # Poisson
                    tail -= term
                    term *= weak / (k + 1)
                if tail < 0.01:
                    cost = segments + (low if allocation == 2 else 0)
                    if best is None or cost < best[0]:
                        best = cost, allocation, segments, spare
                    break
        if best is None:
            return h, 2, -(-(h + 1) // 2), 0
        return h, *best[1:]


def shingle_set(text: bytes, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; letters A-Z count as a-z."""
    return np.unique(shingle_hashes(words.of(text.lower().split()), k))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit number of the set."""
    total = int(mix(hashes + _C[0]).sum(dtype=np.uint64)) + len(hashes) * int(_C[1])
    return int(mix(np.array([total % 2 ** 64], np.uint64))[0].astype(np.int64))


def signatures(hashes: np.ndarray, threshold: Threshold, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set in the groups it takes part in; the last bit is set for subsets with one shingle deleted."""
    n = len(hashes)
    band = int(np.searchsorted(threshold.edges, n, side="right")) - 1
    out = []
    rare = None
    for group in (band, band - 1):
        if group < 0 or (group < band and n > (int(threshold.edges[group + 1]) - 1) * threshold.den // threshold.num):
            continue
        h, allocation, segments, spares = threshold.plan(group)
        if h == 0:  # only equal sets are similar
            continue
        if rare is None:
            rare = np.ones(n, bool) if len(frequent) == 0 else frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes
        salt = np.uint64((group + 1) * int(_C[2]) % 2 ** 64)
        segment = (mix(hashes + salt) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        mixed = mix(hashes[order] ^ _C[3])
        used, starts, sizes = np.unique(segment[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(mixed, starts)
        rares = np.add.reduceat(rare[order].astype(np.int64), starts)
        base = mix(used.astype(np.uint64) * _C[1] + salt)
        strong = (sizes >= 2) & (rares >= 1)
        found = [_flag(mix(sums + base)[strong], False)]
        if allocation == 1:
            weak = segments - int(strong.sum())
        else:
            weak = segments - int((strong & (sizes >= 3) & (rares >= 2)).sum())
            of = np.repeat(np.arange(len(used)), sizes)
            some = sizes[of] >= 3
            found.append(_flag(mix(sums[of] - mixed + base[of])[some], True))
        if weak > spares:
            own = hashes[rare] if int(rare.sum()) > h else hashes
            found.append(_flag(mix(mix(own ^ salt) + _C[0]), False))
        out += found
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_BIT = np.uint64(1)


def _flag(sig: np.ndarray, deleted: bool) -> np.ndarray:
    """The last bit tells whether a shingle was deleted."""
    return sig | _BIT if deleted else sig & ~_BIT


def _sampled(k: int):
    schema = pa.schema([("shingle", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for text, h in rows(batches, "text", "h"):
            hashes = shingle_set(text, words, k)
            if len(hashes):
                yield batch(schema, [hashes.view(np.int64), np.full(len(hashes), h)])
    return run, schema


def _blobs(id_type: pa.DataType) -> pa.Schema:
    return BLOBS.append(pa.field("ids", pa.list_(id_type)))


def _found(id_type: pa.DataType) -> pa.Schema:
    """Rows of three sorts: candidate pairs (a, b), members of large buckets (sig, a, size), documents (doc_id, n, key, h)."""
    return pa.schema([*PAIRS, ("doc_id", id_type), ("n", pa.int64()), ("key", pa.int64()), ("h", pa.int64())])


def _send(bits: int, k: int, threshold: Threshold, frequent: np.ndarray, id_type: pa.DataType):
    """One pass over the texts: signatures to the owners of their hashes, and what is known of each document next to them."""
    schema = _blobs(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        keys: dict[int, int] = {}
        sizes, found, held, docs = [], [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            if found:
                sig, doc = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
                key, size = np.fromiter(keys, np.int64, len(keys)), np.array(sizes, np.int64)
                # a signature that many documents of this task share is settled here, only one of them goes to the owner
                _, back, times = np.unique(sig | _BIT, return_inverse=True, return_counts=True)
                crowd = times[back] > LIGHT
                out = pack(bits, sig[~crowd], doc[~crowd], key, size)
                if crowd.any():
                    first = np.unique(back[crowd], return_index=True)[1]
                    some = np.flatnonzero(crowd)
                    chosen = np.sort(some[first])
                    out += pack(bits, sig[chosen], doc[chosen], key, size, kind=1) + pack(bits, sig[some], doc[some], key, size, kind=2)
            out = [(*row, None) for row in out]
            ids, n, of, h = zip(*docs)
            of = np.array(of, "<i8")
            out.append((int(of[0]) & ((1 << bits) - 1), DOCUMENTS, of.tobytes(), np.array(n, "<i4").tobytes(), b"", np.array(h, "<i8").tobytes(), b"", list(ids)))
            yield batch(schema, list(zip(*out)))
            free_memory()

        for doc_id, text, h in rows(batches, "doc_id", "text", "h"):
            hashes = shingle_set(text, words, k)
            key = set_key(hashes)
            docs.append((doc_id, len(hashes), key, h))
            if len(hashes) and key not in keys:
                keys[key] = 0
                sizes.append(len(hashes))
                found.append(signatures(hashes, threshold, frequent))
                held += len(found[-1])
            if held > FLUSH or len(docs) > FLUSH_DOCS:
                yield from flush()
                keys.clear()
                sizes, found, held, docs = [], [], 0, []
        if docs:
            yield from flush()
    return run


def _own(threshold: Threshold, id_type: pa.DataType):
    pairs_schema, schema = pa.schema(PAIRS), _found(id_type)

    def pairs_of(value, key, size, flagged) -> Iterator[pa.RecordBatch]:
        """Candidate pairs (sig null) and members of large buckets (b null) among entries."""
        deleted = (value & np.uint64(1)).astype(bool)
        bucket = value >> np.uint64(1)
        order = np.lexsort((key, size, bucket))
        bucket, key, size, deleted, flagged = bucket[order], key[order], size[order], deleted[order], flagged[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        exact = np.bincount(group, ~deleted) > 0  # a set may meet a bucket as a whole and by a deletion
        flagged = np.bincount(group, flagged) > 0
        bucket, key, size = bucket[new], key[new], size[new]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        count = np.diff(np.append(start, len(bucket)))
        run = np.repeat(np.arange(len(start)), count)
        large = (count > LIGHT) | ((np.add.reduceat(flagged.astype(np.int64), start) > 0) & (count > 0)) if len(start) else np.zeros(0, bool)
        left, right = [], []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            ok = threshold.fits(size[i], size[j]) & (exact[i] | exact[j])
            left.append(np.minimum(key[i], key[j])[ok])
            right.append(np.maximum(key[i], key[j])[ok])

        for d in range(1, LIGHT):
            i = np.flatnonzero((run[d:] == run[:-d]) & ~large[run[d:]]) if len(run) > d else np.zeros(0, np.int64)
            if len(i):
                add(i, i + d)
        if large.any():
            member = np.flatnonzero(large[run])
            yield batch(pairs_schema, [bucket[member].astype(np.int64), key[member], pa.nulls(len(member), pa.int64()), size[member]])
        if left:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            n = len(both)
            yield batch(pairs_schema, [pa.nulls(n, pa.int64()), both[:, 0], both[:, 1], pa.nulls(n, pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        got, out = table.to_pylist(), []
        # a bucket lies in one slice of the values, so no more than a slice is spread out and sorted at once
        normal = [x for x in got if x["kind"] < 2]
        slices = 1
        while slices * SLICE < sum(len(x["values"]) for x in normal) // 6:
            slices *= 2
        for s in range(slices if normal else 0):
            parts = []
            for x in normal:
                value, key, size, _ = unpack(x)
                some = slice(None) if slices == 1 else (value >> np.uint64(48 - slices.bit_length() + 1)) == s
                parts.append((value[some], key[some], size[some].astype(np.int64), np.full(len(value[some]), x["kind"] == 1)))
            out += pairs_of(*(np.concatenate(c) for c in zip(*parts)))
            del parts
            if slices > 1:
                free_memory()
        for x in got:
            if x["kind"] == 2:
                value, key, size, _ = unpack(x)
                out += pairs_of(value, key, size.astype(np.int64), np.ones(len(value), bool))
        # the bucket's name is complete with its owner
        owner = got[0]["owner"]
        whole = pa.Table.from_batches(out, pairs_schema)
        whole = whole.set_column(0, "sig", pc.add(pc.multiply(whole.column("sig"), 65536), owner))
        for field in list(schema)[len(PAIRS):]:
            whole = whole.append_column(field, pa.nulls(whole.num_rows, field.type))
        parts = [whole.cast(schema)]
        for x in got:
            if x["kind"] == DOCUMENTS:
                n = len(x["ids"])
                known = [x["ids"], np.frombuffer(x["sizes"], "<i4").astype(np.int64), np.frombuffer(x["keys"], "<i8"), np.frombuffer(x["values"], "<i8")]
                parts.append(pa.Table.from_batches([batch(schema, [pa.nulls(n, f.type) for f in list(schema)[:len(PAIRS)]] + known)]))
        return pa.concat_tables(parts)
    return run


def _verify(threshold: Threshold, k: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shingles(text: bytes) -> set:
        w = text.lower().split()
        return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, own = Out(schema), None, set()
        for a, b, left, right in rows(batches, "a", "b", "left", "right"):
            if a != last:
                last, own = a, shingles(left)
            other = shingles(right)
            common = len(own & other)
            if threshold.similar(common, len(own) + len(other) - common) and out.add(a, b):
                yield out.take()
        yield out.take()
    return run, schema


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the right; a slab of the shingles at a time."""
    out = np.zeros((len(left), len(right)))
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(*(np.unique(h) for h, _ in sides))
    at = []
    for h, of in sides:
        place = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        hit = shared[place] == h if len(shared) else np.zeros(len(h), bool)
        at.append((place[hit], of[hit]))
    for a in range(0, len(shared), SLAB):
        cells = []
        for (place, of), n in zip(at, out.shape):
            some = (place >= a) & (place < a + SLAB)
            m = np.zeros((n, min(SLAB, len(shared) - a)), np.float32)
            m[of[some], place[some] - a] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return np.rint(out).astype(np.int64)


def _cross(threshold: Threshold, k: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for left, right in rows(batches, "left", "right", held=1):
            sides = [[shingle_set(m["text"], words, k) for m in side] for side in (left, right)]
            n, m = (np.array([len(x) for x in side]) for side in sides)
            common = common_counts(*sides)
            hit = threshold.den * common >= threshold.num * (n[:, None] + m[None, :] - common)
            key = np.array([x["key"] for x in left + right], np.int64)
            i, j = np.nonzero(hit)
            # at most one link for every set, they connect what all links connect
            u, v = spanning(i, j + len(left), len(key))
            if len(u):
                yield batch(schema, [key[u], key[v]])
    return run


def _placed(docs: DataFrame, threshold: Threshold, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key, h, root) of every row; ``root`` names the component of its set, null for an empty one."""
    from pyspark.sql.pandas.types import to_arrow_type

    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"), _text_hash(text_col).alias("h"))
    linked, sets = links(named, to_arrow_type(named.schema["doc_id"].dataType), threshold, k)
    roots = components(linked, "a", "b").toDF("key", "root")
    root = F.when(F.col("n") > 0, F.coalesce("root", "key"))
    return cut_lineage(sets.join(roots, "key", "left").withColumn("root", root))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def similar_documents(docs: DataFrame, threshold: Threshold = Threshold(85, 100), k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Two documents link when their sets of ``k``-word shingles have the Jaccard similarity; a text with fewer words is one shingle, a text without
    words or null has none and links with nothing.  The component id is the smallest id in reach (null ids count as larger than any
    other; a component of null ids only has a null id).  Documents with equal sets are compared once.
    """
    placed = _placed(docs, threshold, k, id_col, text_col)
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    # most components are one document: they need no join
    several = first.where("members > 1").select("root", "component_id")
    return placed.join(several, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, threshold: Threshold = Threshold(85, 100), k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that with the smallest id (of its rows, that with the smallest text hash); columns unchanged.

    Rows without words stay, but for repeats of the same row.  Columns may have any names.
    """
    placed = _placed(docs, threshold, k, id_col, text_col)
    own_id, own_h = unused(docs, "own_id", "own_h")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best")
    keep = placed.where("root IS NOT NULL").groupBy("root").agg(best).select(F.col("best.doc_id").alias(own_id), F.col("best.h").alias(own_h))
    keep = cut_lineage(keep.unionByName(placed.where("root IS NULL").select(F.col("doc_id").alias(own_id), F.col("h").alias(own_h)).distinct()))
    keyed = docs.withColumn(own_id, F.col(id_col)).withColumn(own_h, _text_hash(text_col))
    same = keyed[own_id].eqNullSafe(keep[own_id]) & (keyed[own_h] == keep[own_h])
    return keyed.join(keep, same, "left_semi").dropDuplicates([own_id, own_h]).select(docs.columns)


def links(named: DataFrame, id_type: pa.DataType, threshold: Threshold, k: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links between set keys that connect whatever is similar; (doc_id, n, key, h): the set of every row of ``named`` (doc_id, text, h)."""
    total = named.count()
    bits = min(16, owner_bits(total, OWNER_DOCS))
    texts = named.select("text", "h")
    every = max(1, total // SAMPLE_DOCS)
    run, schema = _sampled(k)
    common = texts.where(F.pmod("h", F.lit(every)) == 0).mapInArrow(run, spark_schema(schema)).distinct().groupBy("shingle").count()
    common = common.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(FREQUENT_MOST).select("shingle").toPandas()
    frequent = np.sort(common["shingle"].to_numpy(np.int64).view(np.uint64))

    blobs = named.mapInArrow(_send(bits, k, threshold, frequent, id_type), spark_schema(_blobs(id_type)))
    found = cut_lineage(blobs.groupBy("owner").applyInArrow(_own(threshold, id_type), spark_schema(_found(id_type))))
    sets = found.where("key IS NOT NULL").select("doc_id", "n", "key", "h")
    pairs = cut_lineage(found.where("b IS NOT NULL").select("a", "b").distinct())

    # texts of the sets that are in any pair or large bucket, each once
    members = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(found.where("a IS NOT NULL AND b IS NULL").select(F.col("a").alias("key"))).distinct()
    names = cut_lineage(sets.groupBy("key").agg(F.min("h").alias("h")).join(members, "key"))
    held = cut_lineage(likely(texts, "h", names.select("h")).join(names, "h").dropDuplicates(["key"]).select("key", "text"))

    run, schema = _verify(threshold, k)

    def verified(of: DataFrame) -> DataFrame:
        both = of.join(held.toDF("a", "left"), "a").join(held.toDF("b", "right"), "b")
        return cut_lineage(both.mapInArrow(run, spark_schema(schema)))

    # first one partner for every set, which connects most small groups, and the centres of large buckets
    tested = cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    linked = verified(tested)
    crowds = found.where("a IS NOT NULL AND b IS NULL").select("sig", F.col("a").alias("key"), "size").distinct()
    crowds = cut_lineage(crowds.join(crowds.groupBy("key").agg(F.count(F.lit(1)).alias("degree")), "key"))
    centre = crowds.groupBy("sig").agg(F.max_by(F.struct("key", "size"), F.struct("degree", "key")).alias("x"))
    centre = centre.select("sig", F.col("x.key").alias("x"), F.col("x.size").alias("x_size"))
    star = crowds.join(centre, "sig").where((F.col("key") != F.col("x")) & (
        F.least("size", "x_size") * threshold.den >= F.greatest("size", "x_size") * threshold.num))
    star = star.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    linked = linked.unionByName(verified(star))

    # then whatever is still apart: listed pairs one by one, large buckets by blocks
    roots = cut_lineage(components(linked, "a", "b"))
    root = lambda df, c: df.join(roots.toDF(c, f"{c}_root"), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    rest = root(root(pairs, "a"), "b").where("a_root != b_root").select("a", "b").join(tested, ["a", "b"], "left_anti")
    now = root(crowds, "key")
    several = now.groupBy("sig").agg(F.min("key_root").alias("x"), F.max("key_root").alias("y")).where("x != y").select("sig")
    open_ = cut_lineage(now.join(several, "sig").select("sig", "key", F.min("sig").over(Window.partitionBy("key")).alias("home")))
    homes = open_.groupBy("home").agg(F.count_distinct("key").alias("n"))
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("long")
    open_ = open_.join(homes, "home").select("sig", "key", F.xxhash64("home", chunk).alias("block"))
    payload = open_.select("key", "block").distinct().join(held, "key").groupBy("block").agg(F.collect_list(F.struct("key", "text")).alias("members"))
    in_sig = open_.select("sig", "block").distinct()
    met = in_sig.join(in_sig.withColumnRenamed("block", "other"), "sig").where("block <= other").select("block", "other").distinct()
    blocks = met.join(payload.withColumnRenamed("members", "left"), "block").join(payload.toDF("other", "right"), "other").select("left", "right")
    crossed = cut_lineage(blocks.mapInArrow(_cross(threshold, k), spark_schema(schema)))
    return linked.unionByName(verified(rest)).unionByName(crossed), sets
