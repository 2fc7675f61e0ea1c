import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from shelfwise.llm import ngram_join as nj


def brute(rows, num=85, den=100, k=4):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and den * len(s & sets[j]) >= num * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (1, 2, 3, 5, 8, 9, 10, 15, 20, 30, 50, 120, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(base)
            for _ in range(rng.choice([1, 3, 6])):
                copy = list(base)
                for _ in range(max(1, round(size * rng.choice([0.01, 0.02, 0.04])))):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.3:
                    copy += [word() for _ in range(rng.randrange(1 + size // 10))]
                texts.append(copy)
    group = [word() for _ in range(100)]
    for _ in range(40):  # a large group, not all of whose members link
        copy = list(group)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(100)] = word()
        texts.append(copy)
    for _ in range(50):  # a passage that many share
        texts.append([word() for _ in range(rng.choice([5, 40, 80]))] + passage)
    return [(i, rng.choice([" ", "  ", "\n"]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,light", [(1, 12), (2, 2), (3, 4)])
def test_brute_force(docs, monkeypatch, seed, light):
    monkeypatch.setattr(nj, "LIGHT", light)
    monkeypatch.setattr(nj, "FREQUENT", 3)
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, " \n "), (903, "A B c"), (904, "a b C"), (905, "same words"), (905, "same words"), (None, "x y z w v"), (None, "x y z w v"), (906, "é\x85b c d e"),
             (907, "lo ng te xt " * 5000), (908, "lo ng te xt " * 5000 + " end")]
    got = [tuple(r) for r in nj.similar_documents(docs(*rows, extra="y").repartition(6)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_small_flushes(docs, monkeypatch):
    monkeypatch.setattr(nj, "FLUSH", 300)
    monkeypatch.setattr(nj, "LIGHT", 3)
    rows = corpus(7)
    got = [tuple(r) for r in nj.similar_documents(docs(*rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(docs):
    assert nj.similar_documents(docs()).collect() == []


def test_similar_sets_always_meet():
    """Random pairs near the threshold share a signature, whatever is frequent."""
    rng = np.random.default_rng(5)
    threshold = nj.Threshold(85, 100)
    for _ in range(400):
        n = int(rng.choice([3, 5, 6, 7, 9, 12, 13, 20, 33, 34, 60, 150, 600]))
        a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        h = threshold.difference(n)
        drop = int(rng.integers(0, min(h, n) + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2 ** 63, h - drop).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not len(b) or not threshold.similar(common, len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        frequent = np.sort(rng.choice(a, int(rng.integers(0, n + 1)), replace=False))
        x, y = (nj.signatures(s, threshold, frequent) for s in (a, b))
        whole = [set(s[s & nj._BIT == 0].tolist()) for s in (x, y)]
        every = [set((s & ~nj._BIT).tolist()) for s in (x, y)]
        assert whole[0] & every[1] or whole[1] & every[0], (n, drop)


def test_owner_sorts_a_slice_at_a_time(monkeypatch):
    """Slices of an owner's signatures give the pairs and the members of large buckets that all of them give together."""
    some = nj.Threshold(80, 100)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:d % 50] + [f"x{d}"] + base[d % 50:]) for d in range(40)] + [" ".join(f"y{d}_{i}" for i in range(30)) for d in range(40)]
    made = pa.record_batch({"doc_id": pa.array(range(80), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary()), "h": pa.array(range(80), pa.int64())})
    blobs = pa.Table.from_batches(list(nj._send(1, 4, some, np.zeros(0, np.uint64), pa.int64())(iter([made]))))
    blobs = blobs.filter(pc.equal(blobs.column("owner"), 0))
    widest, real = [], np.lexsort

    def found(slice_size):
        monkeypatch.setattr(nj, "SLICE", slice_size)
        monkeypatch.setattr(nj.np, "lexsort", lambda keys: widest.append(len(keys[0])) or real(keys))
        out = nj._own(some, pa.int64())(blobs).select(["sig", "a", "b", "size"]).to_pylist()
        monkeypatch.setattr(nj.np, "lexsort", real)
        return {tuple(r.values()) for r in out}

    whole = found(1 << 21)
    alone = max(widest)
    widest.clear()
    assert found(64) == whole and whole
    assert max(widest) < alone
