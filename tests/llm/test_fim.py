import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from shelfwise.llm import fim, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """Plain version over code points."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    name = f"42:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    same = hashlib.sha256(text.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, same, same
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), hashlib.sha256(output.encode()).hexdigest(), same


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0\x08\x0e\x1f!aéß中😀\x00 "), max_size=60), st.integers(1, 3))
def test_units(text, block):
    fim.BLOCK, before = block, fim.BLOCK  # texts that lie in several blocks
    try:
        units = fim.Units(text.encode())
    finally:
        fim.BLOCK = before
    tokens = TOKEN.findall(text)
    assert len(units) == len(tokens)
    assert [units.cut(k) for k in range(len(tokens) + 1)] == [len("".join(tokens[:k]).encode()) for k in range(len(tokens) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text("<>PSM ab", max_size=30), st.data(), st.sampled_from(["psm", "spm"]))
def test_marks_near_cuts(text, data, form):
    if re.search("<[PSM]>", text):
        return
    raw = text.encode()
    a, b = sorted((data.draw(st.integers(0, len(raw))), data.draw(st.integers(0, len(raw)))))
    assert fim.restore(form, fim.assemble(form, raw, a, b)) == raw


ROWS = ([(i, f"word{i}  zwei\tdrei é{i} 中文 \n" * (i % 9)) for i in range(300)] + [(1, "again the same id"), (1, "again the same id"), (None, "no id here"), (None, None),
        (7001, None), (7002, ""), (7003, " \t"), (7004, "has <P> inside"), (7005, "<M>"), (7006, "x" * 3_000_000), (7007, "a b " * 500_000)])


def checked(df):
    out = fim.restored(df).selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) AS o", "sha2(restored, 256) AS r")
    return sorted(map(tuple, out.collect()), key=str)


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS output", "1 AS n", "'y' AS form", "'z' AS restored")
    assert checked(fim.fill_in_middle(df)) == sorted((brute(*r) for r in ROWS), key=str)


def test_empty_and_invalid(spark):
    assert checked(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))) == []
    bad = spark.sql("SELECT id AS doc_id, CAST(X'41FF2042' AS STRING) AS text FROM range(50)")
    for r in fim.restored(fim.fill_in_middle(bad)).collect():
        assert r.restored == b"A\xff B" and r.n == 2


@pytest.mark.parametrize("rate,spm,forms", [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(spark, rate, spm, forms):
    df = spark.range(40).selectExpr("id AS doc_id", "'a b c' AS text")
    assert {r.form for r in fim.fill_in_middle(df, rate=rate, spm_rate=spm).collect()} == forms


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_fill_in_middle(spark, sf).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute(*r) for r in docs), key=str)
