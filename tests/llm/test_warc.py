import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def build(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, least=0):
    """Plain version: {(page_id, record_type, refers_to, bytes, digest)} as a sorted list."""
    first = {}
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    ranked = sorted(range(len(rows)), key=lambda i: order(rows[i]))
    out = []
    for i in ranked:
        page, _, html = rows[i]
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= least and data in first:
            out.append((page, "revisit", first[data], len(data), digest))
        else:
            first.setdefault(data, page)
            out.append((page, "response", None, len(data), digest))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()), key=str)


ROWS = ([(i, f"http://a.example/{i}", f"<p>page {i % 7} é</p>" * (1 + i % 5)) for i in range(200)]
        + [(500, None, None), (501, "u", ""), (502, "x\r\ny z", "same"), (400, "b", "same"), (400, "b", "same"), (None, "n", "same"), (None, None, None)]
        + [(600 + i, "long", "läng " * 400_000 + str(i)) for i in range(2)])


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, tmp_path, least):
    pages = build(spark, ROWS).repartition(3).selectExpr("*", "'x' AS key", "1 AS row", "2 AS n", "'y' AS record_id", "3 AS first")
    index = warc.write_archives(pages, f"file:{tmp_path}", least_bytes=least)
    records = warc.read_archives(spark, index)
    assert got(records) == brute(ROWS, least)
    assert index.select("record_id").distinct().count() == len(ROWS)
    stored = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
    assert all(stored[p].decode() == (h or "") for p, _, h in ROWS if p is not None and p in stored)


def test_small_frames_and_fetch(spark, tmp_path):
    index = warc.write_archives(build(spark, ROWS).coalesce(1), str(tmp_path))
    assert warc.frames(index).groupBy("bundle").agg(F.max("frame").alias("n")).where("n >= 1").count() == 1
    ids = build(spark, [(3, "", ""), (601, "", ""), (400, "", ""), (999, "", "")])
    found = warc.fetch(index, ids)
    assert sorted(r.page_id for r in found.collect()) == [3, 400, 400, 601]
    assert found.where("page_id = 601").first().payload.decode() == ROWS[-1][2]


def test_bundle_is_a_zstandard_file(spark, tmp_path):
    """Any decoder reads a bundle as a whole, and its last bytes are the seek table."""
    import zstandard

    warc.write_archives(build(spark, ROWS[:50]).coalesce(1), str(tmp_path))
    (path,) = tmp_path.glob("*.warc.zst")
    raw = path.read_bytes()
    frames, _, magic = struct.unpack("<IBI", raw[-9:])
    assert (frames, magic) == (1, 0x8F92EAB1)
    data = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    place, n = 0, 0
    while place < len(data):
        _, _, place = warc.parse(data, place)
        n += 1
    assert n == 50


def test_damage_is_seen(spark, tmp_path):
    index = warc.write_archives(build(spark, [(1, "a", "some text")]), str(tmp_path))
    (path,) = tmp_path.glob("*.warc.zst")
    raw = bytearray(path.read_bytes())
    raw[40] ^= 255
    path.write_bytes(bytes(raw))
    for crc in tmp_path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        warc.read_archives(spark, index).collect()


def test_empty_and_invalid(spark, tmp_path):
    assert warc.read_archives(spark, warc.write_archives(build(spark, []), str(tmp_path))).count() == 0
    bad = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(X'41FF42' AS STRING) AS html")
    assert warc.read_archives(spark, warc.write_archives(bad, str(tmp_path))).first().payload == b"A\xffB"


def test_hot_payload(spark, tmp_path, monkeypatch):
    """One payload on a third of the rows: they stay in their tasks and all refer to the smallest id."""
    from shelfwise.operators import keyed

    monkeypatch.setattr(keyed, "HOT_ROWS", 1000)
    pages = spark.range(30_000).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 = 0, 'x', concat('x', id)) AS html").repartition(4)
    out = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path)), with_payload=False)
    assert out.where("record_type = 'revisit' AND refers_to = 0 AND page_id % 3 = 0").count() == 9_999
    assert out.where("record_type = 'response'").count() == 20_001


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(queries.op13_warc(spark, sf)) == brute(rows)
