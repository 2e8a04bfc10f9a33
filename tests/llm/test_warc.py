import gzip
import hashlib
import random

import pytest

from tests.compare import assert_same
from verbascope.llm import common, warc


def test_query(spark, small, oracle):
    assert_same(warc.op9_warc(spark, small), oracle, warc.ORACLE_SQL)


BIG = "<p>" + "x" * 1000
PAGES = [
    (1, "http://a/ b", BIG), (2, None, BIG), (5, "u", BIG), (5, "u", BIG), (None, "u", BIG), (3, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", None),
    (8, "u", "é" * 500), (9, "u", "é" * 499 + "a"), (10, "u", "é" * 500), (11, "line\nbreak", "z" * 300000),
]


def pages(spark):
    return spark.createDataFrame([(*p, "q", "r") for p in PAGES], "page_id long, url string, html string, digest string, refers_to string")


@pytest.mark.parametrize("split", [1, 97, 1 << 20])
def test_edges_at_any_split(spark, split):
    files = common.stored(warc.write(warc.with_revisits(pages(spark)), common.fresh_dir(spark, "w")), "files")
    if split == 1:
        files = files.where("length < 3000")
    rows = warc.read(files, split).collect()
    if split > 1:
        assert len(rows) == len(PAGES)
        got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
        expected = [(str(i), "revisit", 5) if h == BIG and i != 5 else (str(i), "revisit", 10) if i == 8 else (str(i), "response", None) for i, _, h in PAGES]
        assert got == sorted(expected, key=lambda x: x[:2])
    for r in rows:
        html = next((h or "").encode() for i, _, h in PAGES if i == r["page_id"] and (len((h or "").encode()) == r["payload_bytes"]))
        assert r["payload_digest"] == hashlib.sha1(html).hexdigest() and (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == html


def test_empty(spark):
    files = common.stored(warc.write(warc.with_revisits(pages(spark).limit(0)), common.fresh_dir(spark, "w")), "files")
    assert files.collect() == [] and warc.read(files).collect() == []


def test_magic_inside_members(tmp_path):
    """Payloads of stored gzip members and bare magic, at every split: each record is owned once."""
    rng = random.Random(4)
    inner = gzip.compress(b"WARC/1.0\r\nnot a record")
    payloads = [rng.randbytes(300) + warc.MAGIC + inner + rng.randbytes(200) for _ in range(6)]
    data = b"".join(warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    for split in (50, 333, len(data)):
        found = []
        for start in range(0, len(data), split):
            with open(path, "rb") as f:
                found += [warc.parse(x)["payload"] for x in warc.owned(warc.Source(f, len(data), 64), start, min(len(data), start + split))]
        assert found == payloads


def test_a_header_block_of_any_length(tmp_path):
    url = "data:;base64," + "".join(random.Random(6).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    data = warc.record(1, "u", b"a", "d", None) + warc.record(2, url, b"b", "d", None) + warc.record(3, "u", b"c", "d", None)
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        assert [warc.parse(x)["payload"] for x in warc.owned(warc.Source(f, len(data)), 0, len(data))] == [b"a", b"b", b"c"]


def test_broken_members(tmp_path):
    one = warc.record(1, "u", b"payload", "d", None)
    path = tmp_path / "a.gz"
    path.write_bytes(b"junk" + warc.MAGIC + b"junk" + gzip.compress(b"other") + one + one[: len(one) // 2])
    with open(path, "rb") as f:
        size = path.stat().st_size
        assert [warc.parse(x)["payload"] for x in warc.owned(warc.Source(f, size), 0, size)] == [b"payload"]


def test_a_member_is_plain_gzip():
    text = gzip.decompress(warc.record(1, "u", b"<p>", "d", 9)).decode()
    assert text.startswith("WARC/1.0\r\nWARC-Type: revisit") and "WARC-Refers-To: <urn:page:9>" in text and "<p>" not in text


def packed(text: bytes) -> bytes:
    return gzip.compress(text)


def test_records_of_other_writers(spark, tmp_path):
    info = packed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n")
    page = packed(b"WARC/1.1\r\nwarc-type:response\r\nWARC-RECORD-ID:<urn:page:7>\r\nwarc-target-uri: http://a\r\n /b\r\ncontent-type:application/http;msgtype=response\r\nCONTENT-LENGTH:  25\r\n\r\nHTTP/1.1 200\r\nbroken\r\n\r\nx\r\n\r\n")
    bare = packed(b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(info + page + bare + warc.record(9, "u", b"mine", "d", None))
    files = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, length long")
    rows = {r["record_type"] + str(r["page_id"]): r for r in warc.read(files).collect()}
    assert set(rows) == {"warcinfoNone", "response7", "revisitNone", "response9"}
    assert rows["warcinfoNone"]["url"] is None and bytes(rows["warcinfoNone"]["payload"]) == b"a: b\r\n"
    assert rows["response7"]["url"] == "http://a /b" and bytes(rows["response7"]["payload"]) == b"x"
    assert (rows["revisitNone"]["payload_bytes"], rows["revisitNone"]["payload_digest"], rows["revisitNone"]["payload"]) == (None, None, None)


def test_no_page_of_a_long_url_is_lost(spark):
    urls = ["data:;base64," + "".join(random.Random(n).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)) for n in (80_000, 133_000, 266_000)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'<p>' AS html")
    files = common.stored(warc.write(warc.with_revisits(rows), common.fresh_dir(spark, "w")), "files")
    assert {r["page_id"]: r["url"] for r in warc.read(files).collect()} == dict(enumerate(urls))
