import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbascope.llm import tiff


def back(data):
    return b"".join(p.samples.tobytes() for p in tiff.pages(data))


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [tiff.PLAIN, tiff.HORIZONTAL])
@pytest.mark.parametrize("tiled", [False, True])
def test_round_trip(compression, predictor, tiled):
    rng = random.Random(compression + predictor + tiled)
    for rows in (1, 2, 31, 33, 128, 129, tiff.PAGE_ROWS + 1):
        payload = bytes(rng.choices(range(rng.choice([2, 5, 256])), k=64 * rows))
        data = tiff.written(payload, tiff.Layout(compression, predictor, tiled))
        assert back(data) == payload and len(list(tiff.pages(data))) == -(-rows // tiff.PAGE_ROWS)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a" * 130, b"ab", b"\0" * 3, b"xyz"]), max_size=60).map(b"".join))
def test_codecs(data):
    assert tiff.unpacked_bits(tiff.packed_bits(data), len(data)) == data if data else True
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_past_the_last_code():
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(40000)) + b"abc" * 9000
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_packbits_as_published():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpacked_bits(packed, len(plain)) == plain


def big_endian(samples):
    """Motorola order, short fields, three samples a pixel, one strip, differenced."""
    height, width, depth = samples.shape
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1].astype(np.int16)
    data = zlib.compress(diff.astype(np.uint8).tobytes())
    fields = [(256, width), (257, height), (258, 8), (259, 8), (262, 2), (273, 8), (277, depth), (278, height), (279, len(data)), (317, 2)]
    at = 8 + len(data)
    entries = b"".join(struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in fields)
    entries = entries.replace(struct.pack(">HHIHH", 258, 3, 1, 8, 0), struct.pack(">HHII", 258, 3, 3, at + 2 + 12 * len(fields) + 4))
    return b"MM\0*" + struct.pack(">I", at) + data + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0" + struct.pack(">HHH", 8, 8, 8)


def test_other_byte_order_and_depth():
    samples = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (page,) = tiff.pages(big_endian(samples))
    assert (page.samples == samples).all()


def test_broken_files():
    good = tiff.written(bytes(64), tiff.Layout(tiff.DEFLATE, 1, False))
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    loop = bytearray(good)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    for data in (b"", b"PNG", good[:-10], bytes(loop), good[:8] + b"\xff" * 10 + good[18:], b"II*\0\xff\xff\0\0"):
        with pytest.raises(ValueError):
            list(tiff.pages(data))


TEXTS = [None, "", "a", "é" * 64, "x" * 64, "long " * 40000, "long " * 40000]


def test_frames(spark):
    docs = spark.createDataFrame([(None if i == 2 else i, t, "z", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, page int")
    stored = tiff.media(docs)
    pages = tiff.image_pages(stored).orderBy("doc_id", "page").collect()
    for i, t in enumerate(TEXTS):
        got = b"".join(bytes(p["samples"]) for p in pages if p["doc_id"] == (None if i == 2 else i))
        assert got == tiff.payload_of(t) and len(got) % 64 == 0 and got
    assert len([p for p in pages if p["doc_id"] == 5]) == -(-200000 // 64 // tiff.PAGE_ROWS)
    assert tiff.image_pages(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).collect() == [] and tiff.media(docs.limit(0)).collect() == []


def test_query(spark, small):
    rows = {r["doc_id"]: r for r in tiff.op6_tiff_pages(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        data, r = d["text"].encode(), rows[d["doc_id"]]
        payload = data + b"\0" * (-len(data) % 64)
        media = tiff.written(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert {tiff.layout_of(tiff.payload_of(str(i))).compression for i in range(200)} == {tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}


def test_a_published_lzw_stream():
    """The example of the format's specification: 7 7 7 8 8 7 7 6 6 as codes of nine bits."""
    bits = "".join(f"{code:09b}" for code in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unlzw(stream, 9) == data and tiff.lzw(data) == stream


def test_pages_are_told_apart_by_file(spark):
    """Rows of one id, files of several pages and batches that end within a file."""
    long = ["x" * (64 * tiff.PAGE_ROWS * 3 + i) for i in range(40)]
    docs = spark.createDataFrame([(1, t) for t in [*long, "", "a"]], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tiff.features(tiff.image_pages(tiff.media(docs))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    assert [r["n_bytes"] for r in got] == [len(t) for t in [*long, "", "a"]]
    assert [r["payload_sha256"] for r in got] == [hashlib.sha256(tiff.payload_of(t)).hexdigest() for t in [*long, "", "a"]]
    assert got[1]["feature"].startswith("pages=4 rows=6145 ")
