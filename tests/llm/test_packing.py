import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import packing
from shelfwise.llm.queries import tokenizer_file


def sequences(rows, length="length"):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r[length]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    return by


def test_limits_hold():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.random(900) * 0.4, np.full(900, 1 / 16), rng.random(900) * 0.3], axis=1)
    demand[3] = [1.7, 0.1, 0.1]
    bins = packing.fill_bins(demand)
    assert sorted(i for b in bins for i in b) == list(range(900))
    assert all((demand[b].sum(axis=0) <= 1 + 1e-9).all() for b in bins if b != [3])
    assert len(bins) < 1.06 * demand.sum(axis=0).max() + 2


@pytest.mark.parametrize("buffer", [64, 4096])
def test_instruction_data(spark, sf, monkeypatch, buffer):
    """Conversations under three limits at once: words, segments (turns) and words of the assistant."""
    monkeypatch.setattr(packing, "BUFFER", buffer)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id", "regexp_count(text, '[^ ]+') n", "CASE WHEN role = 'assistant' THEN regexp_count(text, '[^ ]+') ELSE 0 END own")
    items = turns.groupBy("conv_id").agg(F.sum("n").alias("length"), F.sum("own").alias("own"), F.count("n").alias("segments"))
    limits = {"length": 1024, "segments": 12, "own": 500}
    got = packing.pack(items, limits, "length", ["conv_id"]).collect()
    assert len(got) == items.count()
    by = defaultdict(lambda: np.zeros(3))
    size = defaultdict(int)
    for r in got:
        by[r.sequence_id] += [r.length, r.segments, r.own]
        size[r.sequence_id] += 1
    assert all((v <= list(limits.values())).all() or size[k] == 1 for k, v in by.items())
    sequences(got)


def test_documents_whole(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = ["", None, "Hello,  world's\tend\n\n of'the <|endoftext|> x<|startoftext|>y", "Ünïcode é é   ﬁ İ ΑΣ Σ", "w" * 9000, "a b " * 9000,
             "x\x1cy \x85 z q", "it's 'twas '' '", "ab" * 700 + " short"] + ["tail words here"] * 50
    got = packing.pack_documents(docs(*enumerate(texts), extra="y"), path, with_ids=True).collect()
    sequences(got)
    tokenizer = Tokenizer.from_file(path)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.length <= 4096) == (at, len(ids), True)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes()) and bytes(r.ids) == ids[at:at + r.length].tobytes()
            at += r.length
        assert at == len(ids)


def test_repeated_rows_and_no_rows(docs):
    path = tokenizer_file("word_bpe_49k.json")
    assert packing.pack_documents(docs(), path).collect() == []
    got = packing.pack_documents(docs(*[(None, "same text")] * 300), path).collect()
    assert len(got) == 300
    sequences(got)


def test_little_padding(spark, sf):
    got = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_file("word_bpe_49k.json")).collect()
    by = sequences(got)
    assert sum(r.length for r in got) / (4096 * len(by)) > 0.97
