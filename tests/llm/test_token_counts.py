import random

import public_tokenizers
import pytest
import regex

from shelfwise.llm import queries, token_counts as tc
from shelfwise.llm.queries import tokenizer_file

RANKS, PATTERN = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return tc.Tokenizer(RANKS, PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_random_edits(tokenizer, monkeypatch, leaf):
    monkeypatch.setattr(tc, "LEAF", leaf)
    rng = random.Random(5)
    parts = ["the ", "it's", "  ", "\n", " \n ", "x1", "22", "'", "'ll ", "é", "日本", "!!", " ", "\t", "word", "   end", " "]
    for case in range(150):
        text = "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 40, 200])))
        tree = tc.Tree(text, tokenizer.leaves(tokenizer.split.findall(text)))
        for _ in range(15):
            a = rng.randint(0, len(text) + 2)
            n = rng.choice([0, 0, 1, 2, 5, 30, 10 ** 6])
            new = "".join(rng.choices(parts, k=rng.choice([0, 0, 1, 2, 60])))
            tree.edit(a, n, new)
            text = text[:a] + new + text[a + n:]
            assert tree.text == text
            if rng.random() < 0.5:
                continue
            tree.settle(tokenizer)
            assert tree.text == text
            assert [s[1] for s in tree.sums] == [len(text), len(regex.findall(PATTERN, text)), len(tokenizer.encoding.encode_ordinary(text))]


def test_edits_touch_little(tokenizer):
    text = "some words that stand here " * 20_000
    tree = tc.Tree(text, tokenizer.leaves(tokenizer.split.findall(text)))
    tree.edit(300_000, 4, "other")
    tree.settle(tokenizer)
    assert tree.encoded < 200


def test_frames(docs, spark, tokenizer):
    texts = {1: "mail me@x.org now", 2: None, 3: "a " * 50_000 + "555 123 4567", 4: ""}
    trees = tc.build_trees(docs(*texts.items(), (None, "no id"), extra="y"), RANKS, PATTERN)
    edits = spark.createDataFrame([(1, 0, 5, 8, "X"), (1, 1, 0, 0, None), (2, 0, 0, 5, "new text"), (2, 1, 3, 100, " end"), (9, 0, 0, 1, "z"), (None, 0, 0, 1, "z"),
                                   (3, 0, None, None, "b ")], "doc_id long, edit_no int, start int, length int, replacement string")
    got = {r.doc_id: r for r in tc.apply_edits(trees, edits, RANKS, PATTERN).collect()}
    want = {1: "mail X now", 2: "new end", 3: "b " + texts[3], 4: "", None: "no id"}
    assert {k: r.text for k, r in got.items()} == want
    for k, t in want.items():
        assert got[k].tokens == len(tokenizer.encoding.encode_ordinary(t))
        assert got[k].tokens_before == len(tokenizer.encoding.encode_ordinary(texts.get(k, "no id") or ""))
    again = tc.apply_edits(tc.apply_edits(trees, edits, RANKS, PATTERN), edits.limit(0), RANKS, PATTERN)
    assert {r.doc_id: r.tokens for r in again.collect()} == {k: r.tokens for k, r in got.items()}
    assert tc.apply_edits(trees.limit(0), edits, RANKS, PATTERN).collect() == []


def test_repeated_rows_and_ids(docs, tokenizer):
    """One id with two texts, one of them twice: every row gets the edits of its own text, once."""
    one, two = "write me@x.org and you@y.org, call 555 123 4567 now", "555 123 4567 is my number"
    table = docs((1, one), (1, one), (1, two), (2, one), (None, one), (None, one), (3, None), (3, None))
    got = sorted((r.doc_id or 0, r.tokens, r.text) for r in tc.apply_edits(
        tc.build_trees(table, RANKS, PATTERN), tc.redactions(table, queries.REDACTIONS), RANKS, PATTERN).collect())
    count = lambda t: len(tokenizer.encoding.encode_ordinary(t))
    clean = "write [mail] and [mail], call [number] now"
    want = [(1, clean), (1, clean), (1, "[number] is my number"), (2, clean), (0, one), (0, one), (3, ""), (3, "")]
    assert got == sorted((d, count(t), t) for d, t in want)


def test_query(spark, sf, tokenizer):
    rules = queries.REDACTIONS
    pattern = regex.compile("|".join(f"({p})" for p, _, _ in rules))
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.edits for r in got.values())
    for d in docs:
        new = pattern.sub(lambda m: rules[m.lastindex - 1][2], d.text or "")
        r = got[d.doc_id]
        assert (r.tokens_before, r.tokens) == (len(tokenizer.encoding.encode_ordinary(d.text or "")), len(tokenizer.encoding.encode_ordinary(new)))
