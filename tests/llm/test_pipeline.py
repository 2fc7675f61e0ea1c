"""Every stage of the pipeline against plain Python on the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_mixing import check
from test_ngram_join import brute

import corpus_pipeline as cp
from shelfwise.llm import mixing, quality
from shelfwise.llm.common import held_out, table
from shelfwise.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        df = stage(spark, docs, sf)
        rows = df.collect()
        out.append(rows)
        if stage is not cp.STAGES[-1][1]:
            assert df.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality(spark, sf, stages):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels").where(~held_out()))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    assert stages[1] and {r.doc_id for r in stages[1]} == good and set(stages[1]) <= set(stages[0])


def test_exact(stages):
    best = {}
    for r in stages[1]:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(best.values())


def test_near(stages):
    want = brute([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == sorted(d for d, _, c in want if d == c)


def test_mix(spark, stages):
    docs = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.mix_sources(docs, cp.WEIGHTS)
    taken = mix.taken().join(mix.sources.drop("source"), "source_no").collect()
    check(taken, {r.doc_id: r.text for r in stages[3]})
    words = defaultdict(int)
    texts = {r.doc_id: r.text for r in stages[3]}
    for r in stages[4]:
        assert r.text in texts[r.doc_id]
        words[r.doc_id] += len(r.text.encode().split())
    assert words == {r.doc_id: r.taken for r in taken if r.taken}


def test_pack(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, got, by = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in stages[4]:
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        for a in range(0, len(ids), 4096):
            want[r.doc_id, a, zlib.crc32(ids[a:a + 4096].tobytes())] += 1
    for r in stages[5]:
        got[r.doc_id, r.start, r.ids_crc32] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in by.values():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1]) and sum(n for _, n in pieces) <= 4096


def test_run(spark, sf, stages):
    assert sorted(r.ids_crc32 for r in cp.run(spark, sf).collect()) == sorted(r.ids_crc32 for r in stages[5])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_near_is_five_words_and_four_fifths(spark, sf):
    """The stage drops near copies at a similarity of 0.8 on five words, here texts with 18 to 30 % more text at the end."""
    rows = []
    for i, more in enumerate((18, 20, 22, 24, 25, 26, 28, 30)):
        base = [f"w{i}_{j}" for j in range(104)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [f"m{i}_{j}" for j in range(more)]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect())
    assert got == sorted(d for d, _, c in brute(rows, 80, 100, 5) if d == c) and len(got) == 11


HELPERS = ["__h", "__id", "__text_sha256", "__keep_id", "__in_group", "__size", "__start", "__words", "own_id", "own_h", "text_sha256", "in_group",
           "keep_id", "of_id", "h", "start", "words", "size", "key", "root", "n", "a", "b", "kept", "score", "run", "first"]


@pytest.fixture(scope="module")
def odd(spark):
    """Bytes that are no UTF-8, nulls in every column, repeated rows, clashing ids, and columns with the names of helpers."""
    text = "CAST(concat(CAST('a fine sentence about nothing much ' AS BINARY), X'FF41C3', CAST(repeat(' some words', id % 4) AS BINARY)) AS STRING)"
    rows = spark.range(12).selectExpr("IF(id = 3, NULL, id % 9) AS doc_id", f"CASE WHEN id = 4 THEN NULL WHEN id = 5 THEN '' ELSE {text} END AS text",
                                      "IF(id % 2 = 0, 'en', NULL) AS lang", "IF(id % 3 = 0, 's', NULL) AS source", "IF(id = 6, NULL, id) AS n_chars")
    rows = rows.unionByName(rows.where("doc_id = 1"))
    return rows.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in HELPERS])


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, sf, odd, stage):
    """Stages end, keep all columns as they were, and drop no text but repeated ones."""
    name, run = cp.STAGES[stage]
    if stage == 0:
        model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels").where(~held_out()))
        got = quality.keep_scored(odd, model, 0.0)
    else:
        got = run(spark, odd, sf)
    rows = got.selectExpr("*", "hex(text) AS raw").collect() if stage < 4 else got.collect()
    if stage == 4:
        assert len(rows) >= odd.count()
        return
    assert got.columns == odd.columns
    for r in rows:
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in HELPERS)
    given = {r.raw or "" for r in odd.selectExpr("hex(text) AS raw").collect()}
    if stage == 0:
        assert len(rows) == odd.count()
    elif stage == 1:
        assert sorted(r.raw or "" for r in rows) == sorted(given)
    elif stage == 3:
        assert rows and all(any(r.raw in g for g in given) for r in rows)


def test_task_functions_travel_by_value(tmp_path):
    """Executors need no copy of the package: pickled task functions load in a process that cannot import it."""
    import os
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark.cloudpickle import cloudpickle

    from shelfwise.llm import exact_dedup, fim, ngram_join, spelling, warc

    some = ngram_join.Threshold(85, 100)
    some.plan(12)
    ids = pa.int64()
    functions = [ngram_join._send(4, 4, some, np.zeros(0, np.uint64), ids), ngram_join._own(some, ids), ngram_join._verify(some, 4)[0], ngram_join._cross(some, 4),
                 mixing._slice(pa.schema([("text", pa.string())]), -1, 0), exact_dedup._send(3), spelling._prefixes, warc._frames, warc._read(True), warc._write("x", 3, "d"),
                 fim._transform(pa.schema([("n", pa.int64())]), 1, 50, 50)]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(functions))
    code = "import sys, pickle; from pyspark.cloudpickle import cloudpickle; print(len(pickle.load(open('f', 'rb'))), 'shelfwise' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(functions)), "False"], out.stderr
