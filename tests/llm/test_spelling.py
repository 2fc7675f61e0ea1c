import random
import re
import zlib
from collections import Counter

import pytest

from shelfwise.llm import queries, spelling


def brute_words(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def brute(words):
    """All words by their deletions; two words that share one are compared."""
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]

    buckets = {}
    for w in words:
        for d in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            buckets.setdefault(d, []).append(w)
    neighbours = {w: set() for w in words}
    for bucket in buckets.values():
        for a in bucket:
            neighbours[a].update(b for b in bucket if near(a, b))
    form = {}
    for w, others in neighbours.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(neighbours[w]), words.get(form.get(w))) for w, n in words.items()), key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def variants(spark, words):
    return got(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))


@pytest.mark.parametrize("letters,sizes", [("ab", (5, 9)), ("aé", (5, 7)), ("abcdefgh", (5, 6)), ("ab", (1, 5))])
def test_random_words(spark, letters, sizes):
    """Few letters, so most words have neighbours of all three kinds, also runs of equal letters and words within words."""
    draw = random.Random(len(letters) + sizes[1])
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(*sizes))): 3 * 2 ** draw.randint(0, 6) for _ in range(300)}
    assert variants(spark, words) == brute(words)


def test_long_and_nested_words(spark):
    base = "abcdefghij" * 400
    words = {base: 100, base[:-1]: 40, base[1:]: 10, base[:2000] + "x" + base[2001:]: 7, base + "q": 3, base[:2000] + base[2001:]: 5}
    words |= {"a" * n: 3 * n for n in range(5, 25)}
    assert variants(spark, words) == brute(words)


def test_hot_prefix(spark, monkeypatch):
    """A third of all words with one beginning, and one node that is hot for every join."""
    from shelfwise.operators import keyed

    monkeypatch.setattr(keyed, "HOT_SHARE", 20)
    monkeypatch.setattr(keyed, "HOT_ROWS", 1)
    draw = random.Random(5)
    words = {("unter" if i % 3 == 0 else "") + "".join(draw.choice("abcd") for _ in range(5)): draw.randint(3, 50) for i in range(900)}
    assert variants(spark, words) == brute(words)


def test_empty(spark):
    assert got(spelling.spelling_variants(spark.createDataFrame([], "word string, n long"))) == []


DOCS = [(i, "Strasse strasse STRAßE élève Élève éleve x 12 strạsse naïve-naive") for i in range(120)] + [(None, "strasse " * 5), (None, None), (7, None), (7, ""), (8, "wort " * 200_000),
        (9, "zzz" * 100_000 + " " + "zzz" * 100_000 + " " + "zzz" * 100_000)]


def test_words(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS id", "'y' AS run")
    assert {r.word: r.n for r in spelling.vocabulary(spelling.observed(df)).collect()} == brute_words(DOCS)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_spelling_variants(spark, sf)) == brute(brute_words(docs))
