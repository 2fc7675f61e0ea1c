from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from shelfwise.llm import mixing as mx
from shelfwise.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1001])
def test_permutation_and_inverse(n):
    p = mx.permute(np.arange(n), n, 99)
    assert sorted(p.tolist()) == list(range(n))
    assert mx.permute(p, n, 99, inverse=True).tolist() == list(range(n))


def test_water_fill():
    assert mx.water_fill([100, 100, 100], [5, 2, 1], 300, 3) == pytest.approx([187.5, 75, 37.5])
    got = mx.water_fill([10, 500, 100, 0], [5, 2, 1, 5], 610, 3)
    assert got == pytest.approx([30, 580 * 2 / 3, 580 / 3, 0])
    assert mx.water_fill([], [], 0, 3) == []


def test_draws_meet_the_quota():
    quota = np.array([500, 0, 90, 7])
    parts = [mx.draw_counts(quota, 6, s, 100, 1) for s in range(6)]
    assert sum(c for _, c in parts).tolist() == quota.tolist()
    assert [int(c.sum()) for _, c in parts] == [100] * 5 + [97]
    before = np.zeros(4, int)
    for first, counts in parts:
        assert first.tolist() == before.tolist()
        before += counts
    assert len({c[2] for _, c in parts}) > 1


@pytest.mark.parametrize("good,bad,take", [(7, 9, 6), (3, 0, 2), (0, 5, 4), (40, 3, 41), (1, 1, 1), (5, 5, 0)])
def test_inverted_draw_has_the_distribution(monkeypatch, good, bad, take):
    """Ranges beyond MAX_DRAW: shares of 20,000 draws against the exact probabilities."""
    monkeypatch.setattr(mx, "MAX_DRAW", -1)
    rng = np.random.default_rng(8)
    got = Counter(mx.drawn(good, bad, take, rng) for _ in range(20_000))
    exact = {k: comb(good, k) * comb(bad, take - k) / comb(good + bad, take) for k in range(max(0, take - bad), min(good, take) + 1)}
    assert set(got) <= set(exact)
    assert all(abs(got[k] / 20_000 - p) <= 5 * (p * (1 - p) / 20_000) ** 0.5 + 1e-9 for k, p in exact.items())


def test_large_draws_vary_as_they_should():
    good, bad, take = 6_000_000_000, 3_000_000_000, 4_500_000_000
    draws = np.array([mx.drawn(good, bad, take, np.random.default_rng([3, i])) for i in range(300)], float)
    spread = (take * (2 / 3) * (1 / 3) * (good + bad - take) / (good + bad - 1)) ** 0.5
    assert abs(draws.mean() - take * 2 / 3) < 5 * spread / 300 ** 0.5
    assert 0.8 < draws.std() / spread < 1.2


def test_large_plans_meet_the_quota(monkeypatch):
    """Halving far beyond MAX_DRAW: shards follow each other, fill up, and remembered draws change nothing."""
    quota, shards = np.array([2_000_000_000, 0, 700_000_000, 1]), 2_636_719
    kept = {}
    for shard in (0, 1, 1_318_358, 1_318_359, shards - 2, shards - 1):
        first, counts = mx.draw_counts(quota, shards, shard, 1024, 5, kept)
        alone = mx.draw_counts(quota, shards, shard, 1024, 5)
        assert (first.tolist(), counts.tolist()) == (alone[0].tolist(), alone[1].tolist())
        assert first.sum() == shard * 1024 and counts.sum() == min(1024, quota.sum() - shard * 1024) and (counts >= 0).all()
        if shard == shards - 1:
            assert (first + counts).tolist() == quota.tolist()
        else:
            assert (first + counts).tolist() == mx.draw_counts(quota, shards, shard + 1, 1024, 5, kept)[0].tolist()


@pytest.mark.parametrize("size,target", [(1000, 1000.0), (1000, 1500.4), (1000, 999.6), (1000, 3000.0), (100, 30.0), (257, 256.0), (512, 700.0), (5, 0.2), (0, 0.0)])
def test_plan_takes_the_target(size, target):
    s = mx.Source(3, size, target, 5)
    slots, cut = s.plan()
    at = np.arange(slots)
    words = sum(int(s.words(mx.permute(np.array([t % s.blocks]), s.blocks, s.key(t // s.blocks)))[0]) for t in at) - cut
    assert words == round(target)
    assert slots == 0 or 0 <= cut < mx.BLOCK_WORDS


def check(rows, texts):
    """Whole contract against the plain rules."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    targets = mx.water_fill(sizes, [[5, 2, 1][i % 3] for i in range(len(order))], sum(sizes), 3)
    for s, size, target in zip(order, sizes, targets):
        for r in by[s]:
            assert r["size"] == len((texts[r.doc_id] or "").encode().split())
            assert r.source_size == size and r.target == pytest.approx(target)
            assert 0 <= r.taken <= 3 * r["size"]
        assert sum(r.taken for r in by[s]) == round(target)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op2_mixing"](spark, sf).collect()))


def test_edges(docs, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_WORDS", 8)
    monkeypatch.setattr(mx, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mx, "BUCKET_ROWS", 20)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 37)), None, ["a", "b", None, "é"][i % 4]) for i in range(100)]
    rows += [(100, None, None, "a"), (101, "", None, "only empty"), (102, "x " * 3000, None, "a"), (103, "one", None, "tiny")]
    texts = {r[0]: r[1] for r in rows}
    df = docs(*rows, extra="y")
    mix = mx.mix_sources(df)
    got = mix.taken().join(mix.sources.drop("source"), "source_no").collect()
    check(got, texts)
    assert [sorted(map(str, mx.mix_sources(df.repartition(5)).taken().collect()))] == [sorted(map(str, mix.taken().collect()))]
    out = mx.mixed_documents(df, mix)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        piece = r.text.encode().split()
        words[r.doc_id] += len(piece)
        assert r.text in texts[r.doc_id] and (len(piece) == len(texts[r.doc_id].split()) or r.n_chars == len(r.text))
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(words)
    slots = mix.slots.collect()
    for shard, n in Counter(s.shard for s in slots).items():
        assert sorted(s.slot for s in slots if s.shard == shard) == list(range(n))


def test_empty_and_repeated(docs):
    none = docs()
    mix = mx.mix_sources(none)
    assert mix.taken().collect() == [] and mx.mixed_documents(none, mix).collect() == []
    same = docs(*[(1, "a b c", None, "s")] * 40)
    mix = mx.mix_sources(same)
    assert sum(r.taken for r in mix.taken().collect()) == 120
    assert sum(len(r.text.split()) for r in mx.mixed_documents(same, mix).collect()) == 120
