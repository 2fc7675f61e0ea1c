"""Exact top-k dot products between two sets of vectors, without emitting all pairs.

Scores are computed in NumPy on bounded blocks, and only the best ``k`` of every row and block leave a
task.  A small item side (its size is counted first) is broadcast; a larger one is written once
in cells of near vectors, and tasks read the cells that their queries can gain from.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shelfwise.operators.keyed import global_rank, top_per_key
from shelfwise.session import cut_lineage, durable_path, row_count_within

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096
CELLS = 1_000_000  # scores held at once in one task
BROADCAST_ROWS = 1 << 15  # beyond, cells that are skipped save more than a broadcast
PART_BYTES = 96 << 20  # items that a task reads at once
BATCH_BYTES = 48 << 20  # queries with their best items that a task holds at once
MAX_PIVOTS = 4096
PARTNERS = 64  # blocks that a block of products meets in one go
UNPRICED = -(2 ** 40)  # price bucket of products without a usable price


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the ``k`` best finite cells per row; the lower column wins a tie."""
    n = scores.shape[1]
    if n == 0 or scores.shape[0] == 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    if k < n:
        # rounding cannot move a score by more than 1e-9, so only these cells need it
        limit = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= np.where(np.isfinite(limit), limit - 1e-9, limit)[:, None])
    else:
        rows, cols = np.nonzero(np.ones(scores.shape, bool))
    vals = np.round(scores[rows, cols], 9)
    usable = np.isfinite(vals)
    rows, cols, vals = rows[usable], cols[usable], vals[usable]
    order = np.lexsort((cols, -vals, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    starts = np.searchsorted(rows, rows)
    inside = np.arange(len(rows)) - starts < k
    return rows[inside], cols[inside], vals[inside]


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64, copy=False)


def _mask_owned(scores: np.ndarray, owned: pa.Array, ids: np.ndarray) -> None:
    """Set the cells of owned items to -inf; ``ids`` is sorted."""
    sizes = np.asarray([0 if x is None else x for x in owned.value_lengths().to_pylist()], int)
    flat = np.asarray(owned.flatten().to_pylist(), dtype=object)
    if len(flat) == 0 or len(ids) == 0:
        return
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    same = ids[at] == flat
    scores[rows[same], at[same]] = -np.inf


def _score_rows(qids: list, q: np.ndarray, owned: pa.Array | None, ids: np.ndarray, items: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, len(ids)))
    for a in range(0, len(qids), step):
        scores = q[a:a + step] @ items.T
        if owned is not None:
            _mask_owned(scores, owned.slice(a, step), ids)
        rows, cols, vals = best_columns(scores, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([qids[a + r] for r in rows], pa.string()), pa.array(ids[cols].tolist(), pa.string()), pa.array(vals, pa.float64())],
            names=["qid", "iid", "score"])


def top_matches(queries: DataFrame, items: DataFrame, k: int, dims: int | None, exclude: DataFrame | None = None,
                broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS, grouped: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """(qid, iid, score, rank): the ``k`` items with the largest dot product for every query.

    ``queries`` holds (qid, vec), ``items`` (iid, vec) with string ids and ``dims`` numbers per
    vector; ``exclude`` holds distinct (qid, iid) pairs that must not be returned.  With ``grouped`` both sides
    have a column ``grp``, only rows of one group meet, and an id belongs to one group.
    """
    schema = "qid string, iid string, score double"
    spark = queries.sparkSession
    if grouped:
        return _grouped(queries, cut_lineage(items.select("grp", "iid", "vec")), k, exclude, block_rows, part_bytes, schema)
    items = cut_lineage(items.select("iid", "vec"))  # counted, then read again
    fits = row_count_within(items, min(BROADCAST_ROWS, broadcast_bytes // (8 * (dims + 8))))
    if fits is not None:
        rows = sorted((r.iid, r.vec) for r in items.collect())  # size checked above
        shared = spark.sparkContext.broadcast((
            np.asarray([r[0] for r in rows], dtype=object),
            np.asarray([r[1] for r in rows], dtype=np.float64).reshape(-1, dims)))
        queries = queries.repartition(even_tasks(spark), "qid")
        if exclude is not None:
            # at most one entry per item, and the items were just counted
            owned = exclude.groupBy("qid").agg(F.collect_list("iid").alias("owned"))
            queries = queries.join(owned, "qid", "left")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for b in batches:
                own = b.column(b.schema.get_field_index("owned")) if "owned" in b.schema.names else None
                yield from _score_rows(b.column(0).to_pylist(), matrix(b.column(1), dims), own, ids, m, k)

        cols = ["qid", "vec"] + (["owned"] if exclude is not None else [])
        scored = queries.select(*cols).mapInArrow(score, schema)
    else:
        scored = _blocked(queries, items, k, dims, exclude, part_bytes, schema)
    return top_per_key(scored, ["qid"], [F.col("score").desc(), F.col("iid")], k)


def _grouped(queries: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None, block_rows: int, part_bytes: int, schema: str) -> DataFrame:
    """Blocks of queries meet the blocks of items of their group; vectors of different groups may differ in length.

    A group with more than BROADCAST_ROWS items gets cells of its own instead, so its queries are not copied to every block.
    """
    queries = cut_lineage(queries.select("grp", "qid", "vec"))
    large = items.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).where(
        F.col("n") > BROADCAST_ROWS).orderBy("grp").collect()  # one in BROADCAST_ROWS items at most
    scored = [_blocked(queries.where(F.col("grp") == g.grp), items.where(F.col("grp") == g.grp), k, g.dims, exclude, part_bytes, schema) for g in large]
    if large:
        rest = ~F.col("grp").isin([g.grp for g in large])
        queries, items = queries.where(rest), items.where(rest)
    sizes = items.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).alias("i_blocks")).join(
        queries.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).alias("q_blocks")), "grp")
    sizes = cut_lineage(sizes)  # a row a group, so Spark knows whether it is small
    left = queries.join(sizes, "grp").select("grp", "qid", "vec", F.pmod(F.xxhash64("qid"), "q_blocks").alias("qb"),
                                             F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("i_blocks") - 1)).alias("ib"))
    block = F.pmod(F.xxhash64("iid"), "i_blocks")
    right = items.join(sizes, "grp").select(F.col("grp").alias("igrp"), "iid", F.col("vec").alias("ivec"), block.alias("iib"),
                                            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_blocks") - 1)).alias("iqb"))
    if exclude is not None:
        # grouped per query and item block: never longer than one block
        placed = exclude.select("qid", "iid").join(items.join(sizes, "grp").select("iid", block.alias("ib")), "iid")
        left = left.join(placed.groupBy("qid", "ib").agg(F.collect_list("iid").alias("owned")), ["qid", "ib"], "left")
    else:
        left = left.withColumn("owned", F.lit(None).cast("array<string>"))
    tasks = even_tasks(queries.sparkSession)
    left, right = left.repartition(tasks, "grp", "qb", "ib"), right.repartition(tasks, "igrp", "iqb", "iib")
    scored.append(left.groupBy("grp", "qb", "ib").cogroup(right.groupBy("igrp", "iqb", "iib")).applyInArrow(_score_blocks(k), schema))
    return top_per_key(reduce(DataFrame.unionByName, scored), ["qid"], [F.col("score").desc(), F.col("iid")], k)


def _score_blocks(k: int):
    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.schema([("qid", pa.string()), ("iid", pa.string()), ("score", pa.float64())]).empty_table()
        if a.num_rows == 0 or b.num_rows == 0:
            return empty
        dims = len(b.column("ivec")[0])
        ids = np.asarray(b.column("iid").to_pylist(), dtype=object)
        order = np.argsort(ids, kind="stable")
        out = list(_score_rows(a.column("qid").to_pylist(), matrix(a.column("vec"), dims), a.column("owned").combine_chunks(),
                               ids[order], matrix(b.column("ivec"), dims)[order], k))
        return pa.Table.from_batches(out) if out else empty
    return score


def even_tasks(spark: SparkSession) -> int:
    """Task count for work whose cost does not show in its bytes.

    An explicit count keeps adaptive execution from merging small but expensive partitions.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _blocked(queries, items, k, dims, exclude, part_bytes, schema) -> DataFrame:
    """The best ``k`` of every query when the items are too many for a broadcast; no pair of blocks is shuffled.

    Items are dealt to cells around pivots (items themselves) and written once in the order of the cells.  A task takes a batch of
    queries, compares them with the pivots and then reads the parts one after another; a cell is scored for those queries only
    whose ``k``-th best score it can reach: no score in it exceeds q.pivot + |q| radius.  The pivots steer cost, not results.
    """
    spark = queries.sparkSession
    usable = (F.size("vec") == dims) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    # positions in the order of the ids break ties
    placed = cut_lineage(global_rank(items.where(usable).select("iid", F.col("vec").cast("array<double>").alias("vec")), [F.col("iid")], "at"))
    n = placed.count()
    count = int(min(max(math.sqrt(n), 64), MAX_PIVOTS))
    first = placed.orderBy("at").limit(count // 8)  # where all scores tie, these win
    rows = first.unionByName(placed.orderBy(F.xxhash64("at"), "at").limit(count)).dropDuplicates(["at"]).collect()  # MAX_PIVOTS vectors
    rows.sort(key=lambda r: r.at)
    pivots = np.asarray([r.vec for r in rows], np.float64).reshape(-1, dims)
    pivot_at = np.asarray([r.at for r in rows], np.int64)
    shared = spark.sparkContext.broadcast((pivots, pivot_at, np.einsum("ij,ij->i", pivots, pivots)))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at_, size = shared.value
        for b in batches:
            x = matrix(b.column(2), dims)
            cell, far = np.empty(len(x), np.int32), np.empty(len(x))
            step = max(1, CELLS // len(p))
            for a in range(0, len(x), step):
                y = x[a:a + step]
                cell[a:a + step] = np.argmin(size - 2 * (y @ p.T), axis=1)
                d = y - p[cell[a:a + step]]
                far[a:a + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
            known = np.isin(b.column(1).to_numpy(), at_)
            cell[known] = -1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(far)], names=["iid", "at", "vec", "cell", "far"])

    celled = placed.select("iid", F.col("at").cast("bigint").alias("at"), "vec").mapInArrow(
        to_cells, "iid string, at long, vec array<double>, cell int, far double")
    celled = cut_lineage(celled)
    about = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("at").alias("low"))
    about = {r.cell: r for r in about.collect()}  # a row a pivot
    # whole cells in parts of about part_bytes; a larger cell is a part of its own and read batch by batch
    most = max(1, part_bytes // (8 * (dims + 8)))
    part_of, part, held = {}, 0, 0
    for c in sorted(about):
        if held and held + about[c].n > most:
            part, held = part + 1, 0
        part_of[c], held = part, held + about[c].n
    folder = durable_path(spark, "cells")
    chosen = spark.createDataFrame(sorted(part_of.items()), "cell int, part int")
    celled.join(F.broadcast(chosen), "cell").repartition(part + 1, "part").sortWithinPartitions("part", "cell", "at").write.option(
        "parquet.block.size", str(32 << 20)).partitionBy("part").parquet(folder)
    cells = spark.sparkContext.broadcast({c: (r.far * (1 + 1e-12) + 1e-12, r.low) for c, r in about.items()})
    parts = sorted(set(part_of.values()))

    queries = queries.select("qid", "vec")
    if exclude is not None:
        # as many numbers as the query has excluded items
        owned = exclude.join(placed.select("iid", F.col("at").cast("bigint").alias("at")), "iid").groupBy("qid").agg(F.collect_list("at").alias("owned"))
        queries = queries.join(owned, "qid", "left")
    else:
        queries = queries.withColumn("owned", F.lit(None).cast("array<bigint>"))
    batch = int(max(64, min(BATCH_BYTES // (8 * (dims + 24 * k)), BATCH_BYTES // (8 * len(pivots)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _PartReader(folder, parts, dims)
        for held in _batches_of(batches, batch):
            yield from _scan_cells(held, shared.value, cells.value, reader, k, dims)

    return queries.repartition(even_tasks(spark), "qid").select("qid", "vec", "owned").mapInArrow(score, schema)


def _batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        for a in range(0, b.num_rows, rows):
            piece = b.slice(a, rows)
            if n + piece.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held)


class _PartReader:
    """Reads the parts of a table that was written by part and cell; the only part of a small table is kept."""

    def __init__(self, folder: str, parts: list[int], dims: int):
        from pyarrow import fs

        self.system, at = _file_system(folder)
        self.files = []
        for p in parts:
            found = self.system.get_file_info(fs.FileSelector(f"{at}/part={p}"))
            self.files.append(sorted(f.path for f in found if f.path.endswith(".parquet")))
        self.dims, self.kept = dims, None

    def __iter__(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(iid, at, cell, vectors), sorted by cell within each."""
        if self.kept is not None:
            yield from self.kept
            return
        whole = [] if len(self.files) == 1 else None
        for files in self.files:
            for path in files:
                with self.system.open_input_file(path) as f:
                    from pyarrow import parquet

                    for b in parquet.ParquetFile(f).iter_batches(max(1024, min(1 << 18, PART_BYTES // (8 * self.dims))), columns=["iid", "at", "cell", "vec"]):
                        names = b.schema.names
                        get = {c: b.column(names.index(c)) for c in ("iid", "at", "cell", "vec")}
                        piece = get["iid"], get["at"].to_numpy(), get["cell"].to_numpy(), matrix(get["vec"], self.dims)
                        if whole is not None:
                            whole.append(piece)
                        yield piece
        self.kept = whole


class _Best:
    """The best ``k`` items of every query so far: by rounded score, then by position."""

    def __init__(self, rows: int, k: int):
        self.val, self.at = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.iid = np.full((rows, k), None, dtype=object)
        self.k = k

    def add(self, rows: np.ndarray, at: np.ndarray, val: np.ndarray, iid: pa.Array, place: np.ndarray) -> None:
        last, edge = self.val[rows, -1], self.at[rows, -1]
        better = (val > last) | ((val == last) & (at < edge))
        rows, at, val, place = rows[better], at[better], val[better], place[better]
        if len(rows) == 0:
            return
        order = np.lexsort((at, -val, rows))
        rows, at, val, place = rows[order], at[order], val[order], place[order]
        inside = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        rows, at, val, place = rows[inside], at[inside], val[inside], place[inside]
        u, own = np.unique(rows, return_inverse=True)
        names = np.asarray(iid.take(pa.array(place)).to_pylist(), dtype=object)
        old = len(u) * self.k
        all_rows = np.concatenate([np.repeat(np.arange(len(u)), self.k), own])
        all_val, all_at = np.concatenate([self.val[u].ravel(), val]), np.concatenate([self.at[u].ravel(), at])
        order = np.lexsort((all_at, -all_val, all_rows))
        starts = np.searchsorted(all_rows[order], np.arange(len(u)))
        keep = order[starts[:, None] + np.arange(self.k)]
        all_iid = np.concatenate([self.iid[u].ravel(), names])
        self.val[u], self.at[u], self.iid[u] = all_val[keep], all_at[keep], all_iid[keep]

    def add_named(self, rows: np.ndarray, val: np.ndarray, iid: np.ndarray) -> None:
        """The same where ties are broken by the ids themselves."""
        u, own = np.unique(rows, return_inverse=True)
        old = self.iid[u].ravel()
        names = np.concatenate([old, iid])
        filled = np.asarray([x is not None for x in names])
        place = np.full(len(names), np.iinfo(np.int64).max)
        place[filled] = np.unique(names[filled], return_inverse=True)[1]
        all_rows, all_val = np.concatenate([np.repeat(np.arange(len(u)), self.k), own]), np.concatenate([self.val[u].ravel(), val])
        order = np.lexsort((place, -all_val, all_rows))
        keep = order[np.searchsorted(all_rows[order], np.arange(len(u)))[:, None] + np.arange(self.k)]
        self.val[u], self.iid[u] = all_val[keep], names[keep]


def _score_into(best: _Best, need: np.ndarray, q: np.ndarray, x: np.ndarray, at: np.ndarray, iid: pa.Array, first: int, keys: np.ndarray, span: int) -> None:
    """Offer the items ``x`` (rows ``first`` on of ``iid``) to the queries ``need``; ``keys`` are the excluded (query, position) pairs."""
    step = max(1, CELLS // max(1, len(x)))
    for a in range(0, len(need), step):
        some = need[a:a + step]
        s = q[some] @ x.T
        r, c = np.nonzero(s >= np.maximum(best.val[some, -1] - 1e-9, -np.finfo(float).max)[:, None])
        if len(keys) and len(r):
            pair = some[r] * span + at[c]
            free = keys[np.minimum(np.searchsorted(keys, pair), len(keys) - 1)] != pair
            r, c = r[free], c[free]
        if len(r):
            v = np.round(s[r, c], 9)
            finite = np.isfinite(v)
            best.add(some[r[finite]], at[c[finite]], v[finite], iid, c[finite] + first)


def _scan_cells(held: pa.Table, pivots: tuple, cells: dict, reader: _PartReader, k: int, dims: int) -> Iterator[pa.RecordBatch]:
    q = matrix(held.column("vec"), dims)
    owned = held.column("owned").combine_chunks()
    sizes = np.asarray(owned.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), int)
    points, pivot_at, _ = pivots
    span = int(1 << 40)
    keys = np.sort(np.repeat(np.arange(len(q)), sizes) * span + owned.flatten().to_numpy(zero_copy_only=False)) if sizes.sum() else np.empty(0, np.int64)
    best = _Best(len(q), k)
    length = np.sqrt(np.einsum("ij,ij->i", q, q))
    # the pivots come first; their ids are read with the parts, under cell -1
    for done in (False, True):
        for iid, at, cell, x in reader:
            starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
            ends = np.append(starts[1:], len(cell))
            spans = [(int(cell[a]), a, z) for a, z in zip(starts, ends) if (cell[a] >= 0) == done]
            if not done:
                if not spans:
                    break  # the pivots lie at the beginning
                for _, a, z in spans:
                    _score_into(best, np.arange(len(q)), q, x[a:z], at[a:z], iid, a, keys, span)
                continue
            if not spans:
                continue
            far = np.asarray([cells[c][0] for c, _, _ in spans])
            low = np.asarray([cells[c][1] for c, _, _ in spans])
            reach = q @ points[[c for c, _, _ in spans]].T + length[:, None] * far
            # rounding errors of both sides of the bound lie far below this
            reach += 1e-12 * length[:, None] * (1 + far)
            near = np.argmax(reach, axis=1)
            for first in (True, False):  # the closest cell of every query, then what can still do better
                for i, (_, a, z) in enumerate(spans):
                    last = best.val[:, -1]
                    can = (reach[:, i] >= last + 4e-10) | ((reach[:, i] >= last - 6e-10) & (low[i] < best.at[:, -1]))
                    need = np.flatnonzero(can & ((near == i) == first))
                    if len(need):
                        _score_into(best, need, q, x[a:z], at[a:z], iid, a, keys, span)
    ids = held.column("qid").to_pylist()
    r, c = np.nonzero(np.isfinite(best.val))
    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r], pa.string()), pa.array(best.iid[r, c].tolist(), pa.string()),
                                      pa.array(best.val[r, c], pa.float64())], names=["qid", "iid", "score"])


# ---- products against products -----------------------------------------------------------------

def similar_products(products: DataFrame, k: int, ratio: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """(product_id, other_id, score, rank): the ``k`` most similar products inside each ``grp``.

    ``products`` holds (product_id, grp, price, feats array<string>, vals array<double>) with unit
    vectors; a product without a group is compared with all products.  Blocks are cut by group and by
    price on a log scale of the allowed ratio: partners of a priced product lie in its own price block,
    the two next to it, or the unpriced one, so all other block pairs are skipped.  Large blocks are split by a hash.
    Every block is written once; tasks get numbers of blocks and read them, so no product is shuffled per block pair.
    """
    spark = products.sparkSession
    width = math.log(ratio) * (1 + 1e-6) if ratio > 1 else 0.0
    bucket = F.when(F.col("price") > 0, F.floor(F.log("price") / width)).cast("bigint") if width else F.lit(None).cast("bigint")
    # read twice below: for the block sizes and the blocks
    rows = cut_lineage(products.withColumns({"grp": F.coalesce("grp", F.lit("")), "pb": F.coalesce(bucket, F.lit(UNPRICED))}))
    parts = rows.groupBy("grp", "pb").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    blocks = parts.select("grp", "pb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("sub"))
    blocks = cut_lineage(global_rank(blocks, [F.col(c) for c in ("grp", "pb", "sub")], "block"))
    rows = rows.join(parts, ["grp", "pb"]).withColumn("sub", F.pmod(F.xxhash64("product_id"), F.col("parts"))).drop("parts")
    folder, tasks = durable_path(spark, "blocks"), even_tasks(spark)
    rows.join(blocks, ["grp", "pb", "sub"]).select(
        "block", "product_id", F.col("price").cast("double").alias("price"), "feats", F.col("vals").cast("array<double>").alias("vals")
    ).repartition(tasks, "block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder)
    key = ["grp", "qpb", "qsub", "igrp", "ipb", "isub"]
    pairs = _block_pairs(blocks.drop("block"), key)
    left = blocks.withColumnsRenamed({"pb": "qpb", "sub": "qsub", "block": "x"})
    right = blocks.withColumnsRenamed({"grp": "igrp", "pb": "ipb", "sub": "isub", "block": "y"})
    work = pairs.join(left, ["grp", "qpb", "qsub"]).join(right, ["igrp", "ipb", "isub"]).select("x", "y")
    # a block meets its partners in turns of at most PARTNERS, so a block with many of them is spread over tasks
    work = work.withColumn("turn", F.floor(F.row_number().over(W.partitionBy("x").orderBy("y")) / PARTNERS))
    work = work.groupBy("x", "turn").agg(F.sort_array(F.collect_list("y")).alias("ys"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, ys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _score_partners(folder, x, ys, ratio, k)

    scored = work.repartition(tasks, "x", "turn").select("x", "ys").mapInArrow(score, "product_id string, other_id string, score double")
    return top_per_key(scored, ["product_id"], [F.col("score").desc(), F.col("other_id")], k)


def _score_partners(folder: str, x: int, ys: list[int], ratio: float, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of every product of block ``x`` among those of the blocks ``ys``."""
    own = _read_block(folder, x)
    if own is None:
        return
    xid, px, fx, vx = own
    names, mx = _dense_block(fx, vx, None)
    best = _Best(len(xid), k)
    for y in ys:
        other = _read_block(folder, y)
        if other is None:
            continue
        yid, py, fy, vy = other
        order = np.argsort(yid, kind="stable")
        my = _dense_block(fy, vy, names)[1][order]
        yid, py = yid[order], py[order]
        step = max(1, CELLS // len(yid))
        for i in range(0, len(xid), step):
            s = mx[i:i + step] @ my.T
            if ratio > 0:
                t = px[i:i + step, None]
                ok = (t <= 0) | (py <= 0) | ((py >= t / ratio) & (py <= t * ratio))
                s[~ok] = -np.inf
            s[xid[i:i + step, None] == yid[None, :]] = -np.inf
            # a cell that ties with the last one may still win by its id
            s[s < np.maximum(best.val[i:i + step, -1] - 1e-9, -np.finfo(float).max)[:, None]] = -np.inf
            r, c = np.nonzero(np.isfinite(s))
            if len(r) > 4 * k * len(s):
                r, c, v = best_columns(s, k)
            else:
                v = np.round(s[r, c], 9)
            if len(r):
                best.add_named(i + r, v, yid[c])
    r, c = np.nonzero(np.isfinite(best.val))
    yield pa.RecordBatch.from_arrays([pa.array(xid[r].tolist(), pa.string()), pa.array(best.iid[r, c].tolist(), pa.string()), pa.array(best.val[r, c], pa.float64())],
                                     names=["product_id", "other_id", "score"])


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1)) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def write_array(path: str, x: np.ndarray) -> None:
    """A file below the shared folder with the plain numbers of ``x``; a repeated task writes the same ones again."""
    system, at = _file_system(path)
    system.create_dir(at.rsplit("/", 1)[0])
    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(x).data.cast("B") if x.size else b"")
    system.move(part, at)


def read_array(path: str, kind: type = np.float64) -> np.ndarray:
    system, at = _file_system(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), kind)


def forget(*folders: str) -> None:
    """Remove what later files have replaced, so that disk does not grow with the steps."""
    for folder in folders:
        system, at = _file_system(folder)
        system.delete_dir(at)


def _read_block(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray] | None:
    """(ids, prices, features, values) of a block; ``None`` where the hash gave it no product."""
    from pyarrow import fs, parquet

    system, at = _file_system(folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{at}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet"))
    if not files:
        return None
    tables = []
    for path in files:
        with system.open_input_file(path) as f:
            tables.append(parquet.ParquetFile(f).read(columns=["product_id", "price", "feats", "vals"]))
    t = pa.concat_tables(tables)
    ids = np.asarray(t.column("product_id").to_pylist(), dtype=object)
    return ids, _prices(t), t.column("feats").combine_chunks(), t.column("vals").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _block_pairs(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of blocks (never of products) that can hold partners of each other."""
    right = blocks.withColumnsRenamed({"grp": "igrp", "pb": "ipb", "sub": "isub"})
    left = blocks.withColumnsRenamed({"pb": "qpb", "sub": "qsub"})
    priced = left.where(F.col("qpb") != UNPRICED).select(
        "*", F.explode(F.array(F.col("qpb") - 1, F.col("qpb"), F.col("qpb") + 1, F.lit(UNPRICED))).alias("ipb"))
    unpriced = left.where(F.col("qpb") == UNPRICED)
    own, anyone = F.col("grp") != "", F.col("grp") == ""
    # one entry per group and price step: a product with neither is compared with all of them
    places = right.agg(F.collect_set(F.struct("igrp", "ipb")).alias("places"))
    return (
        priced.where(own).withColumn("igrp", F.col("grp")).join(right, ["igrp", "ipb"]).select(*key)
        .unionByName(priced.where(anyone).join(right, "ipb").select(*key))
        .unionByName(unpriced.where(own).withColumn("igrp", F.col("grp")).join(right, "igrp").select(*key))
        .unionByName(unpriced.where(anyone).select("*", F.inline(places.scalar())).join(right, ["igrp", "ipb"]).select(*key))
    )


def _prices(t: pa.Table) -> np.ndarray:
    p = t.column("price").to_numpy().astype(np.float64)
    return np.where(np.isnan(p), 0.0, p)


def _dense_block(feats: pa.Array, vals: np.ndarray, names: dict[str, int] | None) -> tuple[dict[str, int], np.ndarray]:
    """A block as a dense matrix over the features ``names``, by default its own; each different name is looked up once."""
    flat = feats.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    if names is None:
        names = {name: i for i, name in enumerate(words)}
    column = np.asarray([names.get(w, -1) for w in words], int)
    cols = column[flat.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, int)
    rows = np.repeat(np.arange(len(feats)), feats.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    m = np.zeros((len(feats), max(1, len(names))))
    known = cols >= 0
    m[rows[known], cols[known]] = vals[known]
    return names, m
