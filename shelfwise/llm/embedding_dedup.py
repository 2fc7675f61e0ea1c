"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to eight dimensions (or several times eight)
and decoded to the nearest point of the E8 lattice, its home cell; the cells of the lattice neighbours
nearest to it are probed too.  Vectors that share the home cell of the first table are a group; two
groups meet when some vector of one probes the home cell of one of the other in any table.  Every pair
of groups that meet is compared once, block by block, with the exact cosine, and a block reports counts
per vector and a spanning set of links, so a large cluster never lists its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import batch, mix, spark_schema
from shelfwise.llm.graph import components, spanning
from shelfwise.session import cut_lineage

MISSED = 1e-6  # share of pairs at the threshold that no table finds
UNIT = 256  # vectors of a group that are compared as one block


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, halves[(halves < 0).sum(axis=1) % 2 == 0]])


NEIGHBOURS = _minimal_vectors()


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: the nearer of the nearest points of D8 and of D8 + 1/2."""

    def nearest_d8(z: np.ndarray) -> np.ndarray:
        r = np.rint(z)
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        e = z[odd] - r[odd]
        worst = np.abs(e).argmax(axis=1)
        r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1))[:, None], whole, half)


@dataclass(frozen=True)
class Lattice:
    """``blocks`` E8 codes make a cell; ``probes`` neighbours are probed in each block."""

    blocks: int
    scale: float
    probes: int
    tables: int
    seed: int = 17

    def codes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(home, probed) cell numbers of unit vectors: n, and n x (blocks * probes)."""
        n, dims = x.shape
        rng = np.random.default_rng([self.seed, table, dims])
        homes, changes = np.zeros(n, np.uint64), []
        for block in range(self.blocks):
            y = self.scale * (x @ rng.normal(size=(dims, 8)))
            point = nearest_e8(y)
            odd = (rng.integers(1, 2 ** 62, 8) * 2 + 1).astype(np.uint64)
            number = lambda p: ((2 * p).astype(np.int64).astype(np.uint64) * odd).sum(axis=-1, dtype=np.uint64)
            homes += number(point)
            order = np.argpartition(-((y - point) @ NEIGHBOURS.T), self.probes, axis=1)[:, :self.probes]
            changes.append(number(NEIGHBOURS)[order])  # the number is linear in the point
        return homes, homes[:, None] + np.concatenate(changes, axis=1)


def meeting_share(lattice: Lattice, cosine: float = 0.98, trials: int = 20_000) -> float:
    """How often two vectors of this cosine meet in one table: home cells are equal, or a probe of one is the other's home."""
    rng = np.random.default_rng(lattice.seed)
    x, other = rng.normal(size=(2, trials, 8)) * lattice.scale  # projections of unit vectors at random
    z = cosine * x + np.sqrt(1 - cosine ** 2) * other
    points = nearest_e8(x), nearest_e8(z)
    same = (points[0] == points[1]).all(axis=1)
    probed = np.zeros(trials, bool)
    for y, own, wanted in ((x, *points), (z, *points[::-1])):
        order = np.argpartition(-((y - own) @ NEIGHBOURS.T), lattice.probes, axis=1)[:, :lattice.probes]
        probed |= (own[:, None] + NEIGHBOURS[order] == wanted[:, None]).all(axis=2).any(axis=1)
    home, near = same.mean(), (probed & ~same).mean()
    return float(home ** lattice.blocks + lattice.blocks * home ** (lattice.blocks - 1) * near)


def lattice_for(rows: int) -> Lattice:
    """Cells small enough for so many rows; two vectors of cosine 0.98 miss each other in all tables about once in a million times.

    A block of the coarser lattice tells about 2^14 cells apart, so their number grows with the logarithm of the rows, and the
    number of tables follows from how rarely all blocks agree.
    """
    if rows <= 1_000_000:
        return Lattice(blocks=1, scale=1.2, probes=8, tables=7)
    one = Lattice(blocks=max(2, -(-(rows - 1).bit_length() // 14)), scale=0.8, probes=8, tables=1)
    return replace(one, tables=int(np.ceil(np.log(MISSED) / np.log(1 - meeting_share(one)))))


GROUPS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("group", pa.int64()), ("vector", pa.binary())])
CELLS = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("group", pa.int64())])
FOUND = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _units(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors, salt) of the rows of each dimension; labels and dimensions do not mix."""
    lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    labels = b.column("label_hash").to_numpy(zero_copy_only=False).view(np.uint64)
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        x = b.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        x /= np.abs(x).max(axis=1)[:, None]  # squares of very large or small components stay finite
        yield at, x / np.linalg.norm(x, axis=1)[:, None], mix(labels[at] + np.uint64(dims))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _group(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, salt in _units(b):
                home, _ = lattice.codes(x, 0)
                take = pa.array(at)
                yield batch(GROUPS, [b.column("key").take(take), b.column("n").take(take), _signed(mix(home + salt)), [v.tobytes() for v in x]])
    return run


def _meet(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                for _, x, salt in _units(whole.slice(a, 4000)):
                    group = mix(lattice.codes(x, 0)[0] + salt)
                    for table in range(lattice.tables):
                        home, probed = lattice.codes(x, table)
                        key = mix(salt + np.uint64(table + 1))
                        for is_home, cells in ((True, home[:, None]), (False, probed)):
                            both = np.unique(np.stack([mix(cells + key[:, None]).ravel(), np.repeat(group, cells.shape[1])], axis=1), axis=0)
                            yield batch(CELLS, [_signed(both[:, 0]), np.full(len(both), is_home), _signed(both[:, 1])])
    return run


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                same = row["same"]
                left = row["left"]
                right = left if same else row["right"]
                x = np.frombuffer(b"".join(m["vector"] for m in left), np.float64).reshape(len(left), -1)
                y = x if same else np.frombuffer(b"".join(m["vector"] for m in right), np.float64).reshape(len(right), -1)
                if x.shape[1] != y.shape[1]:  # groups of different dimensions met by a chance hash
                    continue
                hit = x @ y.T >= least
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                keys = np.array([m["key"] for m in left] + ([] if same else [m["key"] for m in right]))
                times = np.array([m["n"] for m in right])
                links = hit @ times
                if not same:
                    links = np.concatenate([links, hit.T @ np.array([m["n"] for m in left])])
                i, j = np.nonzero(hit)
                u, v = spanning(i, j if same else j + len(left), len(keys))
                some = np.flatnonzero(links)
                n, m = len(some), len(u)
                yield batch(FOUND, [np.concatenate([keys[some], keys[u]]), pa.array(links[some].tolist() + [None] * m, pa.int64()),
                                    pa.array([None] * n + keys[v].tolist(), pa.int64())])
    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, lattice: Lattice | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows link when their labels are equal and their cosine is ``least`` or more.  A vector that is null, empty or
    zero, or has a null or non-finite component, and one without a label, links with nothing.  Equal vectors are
    compared once and counted as often as they occur; repeated ids are separate rows.  The component id is the smallest id in reach.
    """
    v = F.col("v")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    usable = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    distinct = named.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    reps = cut_lineage(distinct.withColumn("key", F.monotonically_increasing_id()).withColumnRenamed("v", "embedding"))
    lattice = lattice or lattice_for(reps.count())

    source = reps.select("key", "n", F.xxhash64("label").alias("label_hash"), "embedding")
    grouped = cut_lineage(source.mapInArrow(_group(lattice), spark_schema(GROUPS)))
    cells = source.mapInArrow(_meet(lattice), spark_schema(CELLS)).distinct()
    homes = cells.where("home").select("cell", F.col("group").alias("a"))
    probes = cells.where("NOT home").select("cell", F.col("group").alias("b"))
    home_too = cells.where("home").select("cell", F.col("group").alias("b"))
    met = homes.join(probes.unionByName(home_too), "cell").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sizes = grouped.groupBy("group").agg(F.expr(f"CAST(ceil(count(1) / {UNIT}) AS INT)").alias("parts"))
    units = grouped.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).groupBy("group", "part").agg(
        F.collect_list(F.struct("key", "n", "vector")).alias("members"))
    parts = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    across = met.join(sizes.toDF("a", "pa"), "a").join(sizes.toDF("b", "pb"), "b").withColumn("i", parts("pa")).withColumn("j", parts("pb"))
    within = sizes.select(F.col("group").alias("a"), F.col("group").alias("b"), F.col("parts").alias("pa")).withColumn("i", parts("pa")).withColumn(
        "j", F.explode(F.sequence(F.col("i"), F.col("pa") - 1)))
    pairs = across.select("a", "i", "b", "j").unionByName(within.select("a", "i", "b", "j"))
    blocks = pairs.join(units.toDF("a", "i", "left"), ["a", "i"]).join(units.toDF("b", "j", "right"), ["b", "j"]).select(
        ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("same"), "left", "right")
    single = (F.col("same")) & (F.size("left") == 1)
    found = cut_lineage(blocks.where(~single).mapInArrow(_compare(least), spark_schema(FOUND)))

    counts = found.where("links IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL"), "key", "other").toDF("key", "root")
    known = reps.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(counts, "key", "left")
    firsts = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(firsts, "root").select("label", F.col("embedding").alias("v"), "component_id",
                                              (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    component = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return named.join(known, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
