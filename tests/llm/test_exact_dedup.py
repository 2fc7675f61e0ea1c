import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from shelfwise.llm import exact_dedup as ed


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2 ** 40), max_size=200))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.int64)
    rice, code = ed.golomb_encode(v)
    assert ed.golomb_decode(len(v), rice, code).tolist() == v.tolist()


def test_golomb_is_short():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 30, 5000))
    assert len(ed.golomb_encode(v)[1]) * 8 / len(v) < 30 - np.log2(5000) + 2.5


def test_brute_force(docs, spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, "a", "b " * 4000, "c", f"u{i}", "A"])) for i in range(300)] + [(7, "a"), (7, "a"), (None, "a"), (None, "z")]
    got = ed.mark_copies(docs(*rows, extra="y").repartition(7)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)


def test_chance_matches_are_no_copies(docs, monkeypatch):
    monkeypatch.setattr(ed, "SPARE_BITS", -4)  # nearly every fingerprint collides
    got = ed.mark_copies(docs(*[(i, f"text {i % 90}") for i in range(100)])).collect()
    assert sorted(r.doc_id for r in got if r.group_size == 2 and r.kept) == list(range(90, 100))
    assert sum(r.kept for r in got) == 90


def test_empty_table(docs):
    assert ed.mark_copies(docs()).collect() == []
    assert ed.drop_copies(docs()).collect() == []


def test_drop_copies(docs):
    df = docs((1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), extra="y")
    out = ed.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "a"), (4, ""), (5, "b")]
