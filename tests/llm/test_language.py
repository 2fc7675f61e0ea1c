import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm import language as la
from shelfwise.llm.queries import QUERIES


def brute_model(texts):
    """Interpolated Kneser-Ney by dictionaries; returns p(char | context)."""
    top = Counter()
    for t in texts:
        for w in la.LETTERS.findall(t.lower()):
            s = la.START * (la.ORDER - 1) + w + la.END
            for i in range(la.ORDER - 1, len(s)):
                top[s[i - la.ORDER + 1:i + 1]] += 1
    levels = {la.ORDER: top}
    for n in range(la.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    total, types, d = defaultdict(int), Counter(), {}
    for n, level in levels.items():
        for g, c in level.items():
            total[n, g[:-1]] += c
            types[n, g[:-1]] += 1
        ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
        d[n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
    return levels, total, types, d


def brute_p(model, letters, context, char):
    levels, total, types, d = model
    p = max(la.UNKNOWN, d[1] * types[1, ""] / total[1, ""] / letters)
    for n in range(1, la.ORDER + 1):
        c = context[len(context) - n + 1:]
        share = max(levels[n][c + char] - d[n], 0) / total[n, c] if levels[n][c + char] else 0
        weight = (d[n] * types[n, c] / total[n, c] if types[n, c] else 1) if n > 1 else 1
        p = share + weight * p
    return p


TEXTS = {"en": ["The cat sat on the mat. It was the cat!", "that is the other thing, not this 1 thing", "thé"], "de": ["Der Hund und die Katze", "das ist nicht der Hund ß"], "xx": ["日本 語 a"]}


def test_brute_force(docs):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in TEXTS.items() for t in v)]
    model = la.fit(docs(*rows, (90, None, "en"), (91, "", "de"), (92, "no language", None), extra="y"))
    assert model.languages == ("de", "en", "xx")
    letters = len({c for v in TEXTS.values() for t in v for w in la.LETTERS.findall(t.lower()) for c in w} | {la.END})
    words = ["the", "katze", "qq", "日", "that", "hundt"]
    scores, sizes = model.word_scores(words)
    assert sizes.tolist() == [len(w) + 1 for w in words]
    for j, lang in enumerate(model.languages):
        m = brute_model(TEXTS[lang])
        for i, w in enumerate(words):
            s = la.START * (la.ORDER - 1) + w + la.END
            want = -sum(math.log(brute_p(m, letters, s[k - la.ORDER + 1:k], s[k])) for k in range(la.ORDER - 1, len(s)))
            assert scores[i, j] == pytest.approx(want, rel=1e-4)


def test_many_languages_in_parts(docs, monkeypatch):
    """60 languages: no n-gram is lost, and a model in many parts, most of them read from the shared folder, gives the same numbers."""
    rng = np.random.default_rng(7)
    texts = {f"l{i:02}": " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöü日語𝒜"), rng.integers(1, 9))) for _ in range(60)) for i in range(60)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]
    whole = la.fit(docs(*rows))
    assert whole.parts == 1 and len(whole.languages) == 60
    words = [w for t in list(texts.values())[:3] for w in t.split()] + ["zzz", "語𝒜", "q"]
    scores, sizes = whole.word_scores(words)
    letters = len(set("".join(texts.values())) - {" "}) + 1
    for j in (0, 1, 59):
        m = brute_model([texts[whole.languages[j]]])
        for i in range(0, len(words), 17):
            s = la.START * (la.ORDER - 1) + words[i] + la.END
            want = -sum(math.log(brute_p(m, letters, s[k - la.ORDER + 1:k], s[k])) for k in range(la.ORDER - 1, len(s)))
            assert scores[i, j] == pytest.approx(want, rel=1e-4)
    got = {r.doc_id: r for r in la.identify(docs(*rows), whole).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    for name, value in (("PART_ENTRIES", 3000), ("PIECE_ENTRIES", 700), ("SCORE_CELLS", 900), ("CACHE_CELLS", 600), ("HELD_BYTES", 100)):
        monkeypatch.setattr(la, name, value)
    split = la.fit(docs(*rows))
    assert split.parts > 5 and len(split.held) == la.HELD_PARTS
    again, more = split.word_scores(words)
    assert np.allclose(again, scores, rtol=1e-6) and more.tolist() == sizes.tolist()
    for r in la.identify(docs(*rows), split).collect():
        assert (r.lang_pred, r.score) == (got[r.doc_id].lang_pred, pytest.approx(got[r.doc_id].score))


def test_probabilities_sum_to_one(docs):
    model = la.fit(docs(*[(i, t, "en") for i, t in enumerate(TEXTS["en"])]))
    letters = sorted({c for t in TEXTS["en"] for w in la.LETTERS.findall(t.lower()) for c in w} | {la.END})
    m = brute_model(TEXTS["en"])
    assert sum(brute_p(m, len(letters), "\x02th", c) for c in letters) == pytest.approx(1, abs=0.01)
    assert model.languages == ("en",)


def test_edges(docs, monkeypatch):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in TEXTS.items() for t in v)]
    model = la.fit(docs(*rows))
    odd = docs((1, None), (2, ""), (3, "123 !!! _"), (4, "the cat " * 30000), (4, "the cat " * 30000), (None, "der Hund"), extra="y")
    got = la.identify(odd, model).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and by[4].score > 0.99
    monkeypatch.setattr(la, "CACHE_WORDS", 1)
    monkeypatch.setattr(la, "FLUSH_WORDS", 1)
    again = la.identify(odd, la.fit(docs(*rows))).collect()
    assert [(r.doc_id, r.lang_pred, pytest.approx(r.score)) for r in again] == [(r.doc_id, r.lang_pred, r.score) for r in got]
    nothing = la.fit(docs((1, "text")))
    assert {r.lang_pred for r in la.identify(odd, nothing).collect()} == {"und"}
    assert la.identify(docs(), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    right = np.mean([r.lang_pred == truth[r.doc_id].lang for r in held])
    assert right > 0.97, right
    assert np.mean([r.rejected for r in held]) < 0.05


def test_rejection(docs, spark):
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = la.fit(truth)
    odd = docs((-1, "zzqx xkcd wvvk qqzz jjxq pfft kkkx wwqz " * 8), (-2, "Журнал писем и другие тексты"))
    scored = la.identify(truth.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), model)
    got = la.reject(scored, scored.doc_id >= 0).where("doc_id < 0").collect()
    assert [r.rejected for r in got] == [True, True]
