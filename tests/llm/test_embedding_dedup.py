import math

import numpy as np
import pytest

from shelfwise.llm import embedding_dedup as ed
from shelfwise.llm.graph import components


def brute(rows, least=0.98):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = rows[i][1], rows[j][1]
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root = min(rows[j][0] for j in seen)
        out.append((vec_id, len(links[i]), root, vec_id == root))
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, kept string, cell int"


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "UNIT", 7)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range([40, 9, 3, 2][c % 4]):
            rows.append([centre + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14]), int(c % 3)])
    rows += [[rng.normal(size=64), 1] for _ in range(100)]
    rows += [[rows[0][0], 0]] * 5 + [[rows[0][0] * 3, 0]] * 2 + [[rows[0][0], 1], [rows[0][0], None]]
    chain = rng.normal(size=64)
    for _ in range(30):  # neighbours link, ends do not
        rows.append([chain / np.linalg.norm(chain), 2])
        step = rng.normal(size=64)
        chain = chain / np.linalg.norm(chain) + 0.15 * step / np.linalg.norm(step)
    rows = [(i * 3 % 1009, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 64, 1), (5003, [float("nan")] * 64, 1), (5004, [None] * 64, 1), (5005, [float("inf")] + [1.0] * 63, 1),
             (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (5008, [1e-30] * 64, 1), (5009, [1e30] * 64, 1)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in ed.near_vectors(df).collect())
    assert got == brute(rows)
    two = sorted(tuple(r) for r in ed.near_vectors(df.repartition(5), lattice=ed.Lattice(2, 0.8, 8, 14)).collect())
    assert two == got
    finer = sorted(tuple(r) for r in ed.near_vectors(df, lattice=ed.lattice_for(10 ** 9)).collect())
    assert finer == got


def test_empty(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lattice_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 3
    p = ed.nearest_e8(y)
    assert ((np.rint(2 * p) == 2 * p).all() and (p.sum(axis=1) % 2 == 0).all())
    d = ((y - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    assert (((y - p)[:, None] - ed.NEIGHBOURS) ** 2).sum(axis=2).min(axis=1).min() >= d.min() - 1e-9
    assert all(((y - p)[:, None] - ed.NEIGHBOURS).__pow__(2).sum(axis=2).min(axis=1) >= d - 1e-9)


@pytest.mark.parametrize("rows", [1000, 10 ** 8, 10 ** 9, 10 ** 13])
def test_recall_at_the_threshold(rows):
    lattice = ed.lattice_for(rows)
    rng = np.random.default_rng(1)
    n = 3000
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rng.normal(size=(n, 64)))
    o = rng.normal(size=(n, 64))
    z = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * unit(o - (o * x).sum(axis=1)[:, None] * x)
    missed = np.ones(n)
    for t in range(lattice.tables):
        hx, px = lattice.codes(x, t)
        hz, pz = lattice.codes(z, t)
        met = (hx == hz) | (px == hz[:, None]).any(axis=1) | (pz == hx[:, None]).any(axis=1)
        missed *= 1 - met.mean()
    assert missed[0] < 5e-6
    assert ed.meeting_share(lattice) == pytest.approx(1 - missed[0] ** (1 / lattice.tables), abs=0.03)


def test_lattice_grows_with_the_rows():
    got = [ed.lattice_for(2 ** b) for b in range(10, 60, 4)]
    assert [x.blocks for x in got] == sorted(x.blocks for x in got) and got[0].blocks == 1 and got[-1].blocks == 5
    assert all(x.tables == ed.lattice_for(2 ** 30).tables for x in got if x.blocks == 3)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in root}
