import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 97, 1000, 1009])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 97 or got != list(range(n))


@pytest.mark.parametrize("n", [10 ** 9 + 7, 3 * 10 ** 10 + 1])
def test_domain_is_tight(n):
    a, b, walks = sharding.domain(n)
    assert a * b >= n and walks == a * b - n + 1 and walks < 40


def test_layout_does_not_matter(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = [(i % 150 if i % 3 else None, f"t{i % 7}") for i in range(300)] + [(5, None)] * 40
    df = docs(*rows).select("doc_id", "text")
    a = sorted(map(str, sharding.shard(df, 16).collect()))
    assert a == sorted(map(str, sharding.shard(df.repartition(9), 16).collect()))
    got = sharding.shard(df, 16).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.row_number for r in got) == list(range(len(rows)))


def test_empty(docs):
    assert sharding.shard(docs().select("doc_id"), 4).collect() == []


def test_query(spark, sf):
    import pyarrow.parquet as pq

    got = {r.doc_id: r for r in queries.op7_sharding(spark, sf).collect()}
    for d, t in zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))):
        raw = (t or "").encode()
        assert (got[d]["size"], got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
