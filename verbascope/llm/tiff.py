"""Media columns: TIFF files written, walked and decoded.

The reader takes either byte order, follows the chain of image directories,
decodes strips or tiles (raw, PackBits, LZW, deflate), undoes horizontal
differencing and yields one page for each directory, of 8-bit samples. The
writer stores a payload, padded to rows of 64 samples, as pages of at most
``PAGE_ROWS`` rows; the layout of a payload (compression, predictor, strips or
tiles) follows from its checksum, so that equal payloads are stored alike.

LZW is written and read byte by byte in Python, at thirty times the cost of the
other compressions; so the writer deals it to one payload in sixteen, which is
enough to meet it in every table, and deflate to most.

Defined cases: a null text is the empty text; an empty text is one row of
zeros; a very long text has as many pages as it needs. Null media have no
pages. Equal texts have equal files, repeated rows included; an empty table
gives no rows. Columns other than those named are dropped, whatever their
names. Broken files raise ValueError: a directory chain that loops, tags that
point outside, streams that end early or hold too little.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verbascope.llm.common import over_batches, table

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 2048, 128, 32

# Fixed values of the format: compressions, predictors, tags, and sizes of field types.
RAW, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
PLAIN, HORIZONTAL = 1, 2
COLUMNS, ROWS, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
CLEAR, END, FIRST = 256, 257, 258


class Page(NamedTuple):
    number: int
    width: int
    height: int
    samples: np.ndarray  # height x width x samples of a pixel


class Layout(NamedTuple):
    compression: int
    predictor: int
    tiled: bool


def packed_bits(data: bytes) -> bytes:
    """PackBits: runs of three and more, literals between them."""
    out = bytearray()
    values = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    lengths = np.diff(edges)
    at = 0

    def literal(start: int, stop: int) -> None:
        for i in range(start, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, length in zip(edges[:-1][lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(at, start)
        left = length
        while left >= 2:
            n = min(left, 128)
            out += bytes((257 - n, data[start]))
            left -= n
        at = start + length - left
    literal(at, len(data))
    return bytes(out)


def unpacked_bits(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; widths grow one code early."""
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    known: dict[tuple[int, int], int] = {}
    following, width, prefix = FIRST, 9, -1
    put(CLEAR, width)
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = known.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix, width)
        known[prefix, byte] = following
        following += 1
        if following == 4095:
            put(CLEAR, width)
            known.clear()
            following, width = FIRST, 9
        elif following >= 1 << width and width < 12:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix, width)
        if following >= (1 << width) - 1 and width < 12:
            width += 1
    put(END, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, width, before = list(single), 9, b""
    held = bits = 0
    out = bytearray()
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            known, width, before = list(single), 9, b""
            continue
        if code == END or len(out) >= size:
            break
        if not before:
            entry = known[code] if code < 256 else None
        elif code < len(known):
            entry = known[code]
            known.append(before + entry[:1])
        else:
            entry = before + before[:1] if code == len(known) else None
            known.append(entry or b"")
        if entry is None:
            raise ValueError("an LZW code that isn't known yet")
        out += entry
        before = entry
        if len(known) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def packed(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {RAW: bytes, PACKBITS: packed_bits, LZW: lzw}[compression](data)


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    """The first ``size`` bytes of a strip or tile."""
    if compression == RAW:
        out = data
    elif compression == PACKBITS:
        out = unpacked_bits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    elif compression in (DEFLATE, 32946):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(f"a broken deflate stream: {e}") from e
    else:
        raise ValueError(f"compression {compression} isn't known")
    if len(out) < size:
        raise ValueError("a strip or tile holds too little")
    return out[:size]


def layout_of(payload: bytes) -> Layout:
    """Mostly deflate; a share of each other compression, of predictors and of tiles, by checksum."""
    code = zlib.crc32(payload)
    compression = (LZW, PACKBITS, PACKBITS, PACKBITS, RAW, *[DEFLATE] * 11)[code % 16]
    return Layout(compression, HORIZONTAL if code >> 4 & 1 else PLAIN, bool(code >> 5 & 1))


def written(payload: bytes, layout: Layout | None = None, width: int = WIDTH) -> bytes:
    """A TIFF of ``payload``, whose length is a positive multiple of ``width``."""
    layout = layout or layout_of(payload)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), PAGE_ROWS):
        page = rows[top : top + PAGE_ROWS]
        offsets, counts = [], []
        for block in _blocks(page, layout.tiled):
            if layout.predictor == HORIZONTAL:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = packed(block.tobytes(), layout.compression)
            offsets.append(len(body))
            counts.append(len(data))
            body += data
        fields = {COLUMNS: [width], ROWS: [len(page)], BITS: [8], COMPRESSION: [layout.compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [layout.predictor]}
        fields |= {TILE_WIDTH: [TILE], TILE_LENGTH: [TILE], TILE_OFFSETS: offsets, TILE_BYTES: counts} if layout.tiled else {ROWS_PER_STRIP: [STRIP_ROWS], STRIP_OFFSETS: offsets, STRIP_BYTES: counts}
        entries = []
        for tag, values in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                at = len(body)
                body += data
                data = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + data)
        body += b"\0" * (len(body) % 2)
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def _blocks(page: np.ndarray, tiled: bool) -> Iterator[np.ndarray]:
    if not tiled:
        for at in range(0, len(page), STRIP_ROWS):
            yield page[at : at + STRIP_ROWS]
        return
    for top in range(0, len(page), TILE):
        for left in range(0, page.shape[1], TILE):
            part = page[top : top + TILE, left : left + TILE]
            yield np.pad(part, ((0, TILE - part.shape[0]), (0, TILE - part.shape[1])))


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """Tags and values of each image directory, along the chain."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen = set()
        while at:
            if at in seen:
                raise ValueError("the directories loop")
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}H", data, at)
            fields = {}
            for i in range(n):
                entry = at + 2 + 12 * i
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
                if kind not in FIELD:
                    continue
                size = struct.calcsize(FIELD[kind]) * count
                place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
                fields[tag] = list(struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place))
            yield fields
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise ValueError(f"a directory points outside: {e}") from e


def pages(data: bytes) -> Iterator[Page]:
    """The decoded page of each directory."""
    for number, fields in enumerate(directories(data)):
        one = lambda tag, default=None: fields.get(tag, [default])[0]  # noqa: E731, B023
        width, height, depth = one(COLUMNS), one(ROWS), one(SAMPLES, 1)
        if not width or not height or set(fields.get(BITS, [1])) != {8} or one(PLANAR, 1) != 1:
            raise ValueError("only chunky 8-bit samples are read")
        if TILE_OFFSETS in fields:
            across, down, places, sizes = one(TILE_WIDTH), one(TILE_LENGTH), fields[TILE_OFFSETS], fields[TILE_BYTES]
        else:
            across, down, places, sizes = width, min(one(ROWS_PER_STRIP, height), height), fields[STRIP_OFFSETS], fields[STRIP_BYTES]
        columns = -(-width // across)
        if len(places) < columns * -(-height // down) or len(places) != len(sizes):
            raise ValueError("strips or tiles are missing")
        image = np.zeros((height, width, depth), np.uint8)
        for i in range(columns * -(-height // down)):
            top, left = i // columns * down, i % columns * across
            tall = down if TILE_OFFSETS in fields else min(down, height - top)
            raw = unpacked(data[places[i] : places[i] + sizes[i]], one(COMPRESSION, RAW), tall * across * depth)
            block = np.frombuffer(raw, np.uint8).reshape(tall, across, depth)
            if one(PREDICTOR, PLAIN) == HORIZONTAL:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            part = image[top : top + tall, left : left + across]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield Page(number, width, height, image)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row of ``docs``."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch["text"].to_pylist()
            return {"doc_id": batch["doc_id"], "n_bytes": [len((x or "").encode()) for x in texts], "media": [written(payload_of(x)) for x in texts]}

        return step

    return over_batches(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), "doc_id long, n_bytes long, media binary", make)


PAGES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pages int, page int, width int, height int, samples binary"


def image_pages(stored: DataFrame) -> DataFrame:
    """``PAGES``: one row for each page of each row's media (doc_id, n_bytes, media), a file's pages together and in order."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {x.split()[0]: [] for x in PAGES.split(", ")}
            for doc_id, n, data in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                found = list(pages(data)) if data is not None else []
                for page in found:
                    row = (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), len(found), page.number, page.width, page.height, page.samples.tobytes())
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            return out

        return step

    return over_batches(stored.select("doc_id", "n_bytes", "media"), PAGES, make)


def features(found: DataFrame) -> DataFrame:
    """What ``image_pages`` read of each file: its payload's length and digests, those of the file, and what the samples are like.

    A file's pages follow each other in a task, so no shuffle brings them together.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        held: list[bytes] = []
        rows = 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal rows
            out: dict = {x.split()[0]: [] for x in schema.split(", ")}
            for row in batch.to_pylist():
                held.append(row["samples"])
                rows += row["height"]
                if row["page"] < row["pages"] - 1:
                    continue
                payload = b"".join(held)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                kinds = np.flatnonzero(counts)
                feature = f"pages={len(held)} rows={rows} least={kinds[0]} most={kinds[-1]} kinds={len(kinds)} sum={int(counts @ np.arange(256))}"
                made = (row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), row["media_bytes"], row["media_sha256"], feature)
                for k, v in zip(out, made, strict=True):
                    out[k].append(v)
                held.clear()
                rows = 0
            return out

        return step

    return over_batches(found, schema, make)


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back, a row a page, from each text's media."""
    return features(image_pages(media(table(spark, sf_dir, "documents"))))
