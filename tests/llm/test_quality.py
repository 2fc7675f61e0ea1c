import zlib

import numpy as np
import pytest

from shelfwise.llm import quality as qu
from shelfwise.llm.queries import QUERIES


def brute_score(model, text):
    w = model.weights
    f = [qu.Features()[t] for t in (text or "").encode().split()]
    hs = []
    for a in range(0, max(1, len(f)), qu.PASSAGE):
        part = f[a:a + qu.PASSAGE]
        x = sum((w["table"][k // qu.BUCKETS] + w["table"][k % qu.BUCKETS] for k in part), np.zeros(qu.WIDTH)) / max(1, len(part))
        hs.append(np.tanh(x + w["b"]))
    raw = [float((np.tanh(h @ w["v"]) / (1 + np.exp(-h @ w["u"]))) @ w["w"]) for h in hs]
    e = np.exp(np.array(raw) - max(raw))
    z = sum(a * h for a, h in zip(e / e.sum(), hs))
    return float(1 / (1 + np.exp(-(z @ w["c"] + w["c0"][0]))))


def test_scores_and_edges(docs, spark, monkeypatch):
    good = [(i, "plain words that stand here and there " * (i % 9 + 1)) for i in range(40)]
    bad = [(100 + i, "plain words that stand here " * (i % 9) + "BUY NOW!! $$$ ### " * 20) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, None, 0), (1, 7, 0), (None, 1, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    df = docs(*good, *bad, (200, None), (201, ""), (None, "x"), (202, "long text " * 20_000), (202, "long text " * 20_000), extra="y")
    monkeypatch.setattr(qu, "EPOCHS", 60)
    model = qu.fit(df, labels)
    got = [(r.doc_id, r.score) for r in qu.score(df, model).collect()]
    assert len(got) == 85
    texts = dict([*good, *bad, (200, None), (201, ""), (None, "x"), (202, "long text " * 20_000)])
    for k, s in got:
        assert s == pytest.approx(brute_score(model, texts[k]), abs=1e-4)
    by = dict(got)
    assert min(by[i] for i, _ in good) > 0.7 > max(by[i] for i, _ in bad)
    kept = qu.keep_scored(df, model, 0.7)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 200").collect()) == [i for i, _ in good]
    assert qu.score(docs(), model).collect() == [] and qu.keep_scored(docs(), model, 0.7).collect() == []
    untaught = qu.fit(docs(), labels)
    assert all(0 <= r.score <= 1 for r in qu.score(df, untaught).collect())


def test_gradient_moves_attention_to_the_passage_that_tells():
    rng = np.random.default_rng(0)
    words = lambda n: rng.integers(0, qu.BUCKETS // 2, n) * qu.BUCKETS + qu.BUCKETS // 2
    docs = []
    for i in range(300):
        d = words(qu.PASSAGE * 6)
        if i % 2:  # one passage of six has another shape
            a = qu.PASSAGE * rng.integers(0, 6)
            d[a:a + qu.PASSAGE] += 5
        docs.append((1 - i % 2, d))
    model = qu.train(docs)
    found, scores = [], []
    for label, d in docs:
        sums = np.add.reduceat(model.weights["table"][d // qu.BUCKETS] + model.weights["table"][d % qu.BUCKETS], qu.passages(len(d)), axis=0)
        _, _, a, _, p = model.attend(model.encode(sums, np.full(6, qu.PASSAGE)), np.array([0]))
        scores.append((label, p[0]))
        if label == 0:
            found.append(a.argmax() == np.flatnonzero(d[::qu.PASSAGE] % qu.BUCKETS > qu.BUCKETS // 2)[0])
    assert np.mean(found) > 0.95 and all((p > 0.5) == label for label, p in scores)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op6_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([[1.0 if g > b else 0.5 if g == b else 0.0 for b in bad] for g in good])
    assert auc > 0.9, (auc, np.mean([(s >= 0.7) == y for s, y in held]))


def test_long_words_count_to_their_end():
    """A text without blanks has features for every part of it, not for its first characters only."""
    start, good, bad = "語" * 200, "文" * 400, "!?" * 200
    one, two = (qu.Features().of((start + x).encode()) for x in (good, bad))
    assert len(one) == len(two) == 3 and one[0] == two[0]
    assert set(one[1:] % qu.BUCKETS) != set(two[1:] % qu.BUCKETS)
    whole = qu.Features().of(" ".join([start, good[:200], good[200:]]).encode())
    assert one.tolist() == whole.tolist()
