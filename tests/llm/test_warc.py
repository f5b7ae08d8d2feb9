import base64
import gzip
import hashlib

import pytest

from casebraid.llm import warc
from casebraid.llm.queries import op2_warc

SCHEMA = "page_id long, url string, html string, key string, type string"
PAGES = [
    (1, "http://Www.Example.com:80/a?x=1#f", "<p>é\r\n\r\n</p>"), (2, "http://www.example.com/a?x=1", "<p>é\r\n\r\n</p>"), (3, "https://b.org", None), (4, None, ""), (5, "http://b.org/\nx y%", "one"),
    (6, "not a url", "two"), (6, "not a url", "two"), (None, "http://b.org/", "one"), (7, "http://b.org/big", "y" * 3_000_000), (8, "http://b.org/big", "y" * 3_000_000), *((k, f"http://h{k % 7}.example.net/p{k}", f"text {k % 30}") for k in range(10, 90)),
]


def expected(rows, least=0):
    heads = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            heads[h or ""] = max(heads.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        head = heads.get(h or "")
        revisit = p is not None and head is not None and p < head
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def archive(spark, tmp_path, monkeypatch):
    def make(rows, least=0):
        root = f"file://{tmp_path}/archive"
        pages = spark.createDataFrame([(*r, "k", "t") for r in rows], SCHEMA).repartition(3)
        captures = warc.write_archives(pages, root, least)
        captures.write.mode("overwrite").parquet(f"{tmp_path}/captures")
        directory = warc.build_index(spark.read.parquet(f"{tmp_path}/captures"), root)
        directory.write.mode("overwrite").parquet(f"{tmp_path}/directory")
        return root, spark.read.parquet(f"{tmp_path}/directory")

    return make


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(archive, least):
    root, directory = archive(PAGES, least)
    records = warc.read_records(warc.all_captures(directory, root), root).cache()
    assert sorted((tuple(r) for r in warc.summary(records).collect()), key=str) == expected(PAGES, least)
    texts = {(r.page_id, r.url): r.payload for r in records.collect() if r.payload is not None}
    assert texts[5, "http://b.org/\nx y%"] == b"one" and len(texts[8, "http://b.org/big"]) == 3_000_000


@pytest.mark.parametrize("slice_blocks", [500_000, 1])
def test_lookup_by_url(spark, archive, slice_blocks, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    cloudpickle.register_pickle_by_value(warc)
    try:
        root, directory = archive(PAGES)
        assert directory.count() >= len(PAGES) // 4
        asked = ["http://www.example.com/a?x=1", "http://h3.example.net/p10", "http://nowhere.net/", "not a url", None]
        got = warc.lookup(spark.createDataFrame([(u,) for u in asked], "url string"), directory, root, slice_blocks)
        want = sorted(str(p) for p, u, _ in set(PAGES) if any(warc.url_key(a) == warc.url_key(u) for a in asked))
        assert sorted({str(r.page_id) for r in got.collect()}) == want
    finally:
        cloudpickle.unregister_pickle_by_value(warc)


def test_records_are_plain_warc():
    member = warc.record(3, "http://a.b/c", b"body", warc.sha1_base32(b"body"), None, "2024-01-01T00:00:00Z")
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest.endswith(b"body\r\n\r\n")
    assert int(head.split(b"Content-Length: ")[1]) == len(rest) - 4
    assert warc.url_key("https://User@A.B.com:8/x#y") == "com,b,a)/x" and warc.url_key("http://h") == "h)/" and warc.url_key(None) == ""


def test_no_rows_and_the_query(spark, archive):
    root, directory = archive([])
    assert warc.read_records(warc.all_captures(directory, root), root).count() == 0
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op2_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(pages)
