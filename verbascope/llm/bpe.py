"""Byte-level BPE encoding and decoding.

A piece is merged on a segment tree over its byte positions. A leaf holds the
rank of the pair that starts at that live position; an inner node holds the
smallest rank below it, the left child on ties, so the root names the leftmost
pair of minimum rank. A merge changes the pair at its own position and at the
live neighbour before it and removes the position after it: three point
updates of logarithmic cost, so a run of n bytes costs O(n log n).

Defined cases: a null text is the empty text; an empty text has no ids and
decodes to no bytes; texts of any length are encoded whole. Pairs of equal rank
are merged from the left. Repeated rows are encoded as often as they occur; an
empty table gives no rows. Results have columns of their own only, whatever
other columns are named.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from verbascope.llm.common import over_batches, shared

#: The characters of Unicode's White_Space property, which is what \s means to the tokenizer's own regex engine.
WHITE = r"\t-\r\x20\x85\xa0  -     　"

#: Above all ranks.
NO_PAIR = 1 << 40

#: A worker remembers so many pieces of late and as many from before them, for speed only.
MEMORY = 350_000
#: Longer pieces are not remembered.
MEMORY_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, merged by rank, leftmost first among equal ranks."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    size = 1 << max(0, n - 2).bit_length()  # one leaf for each pair
    tree = [NO_PAIR] * (2 * size)
    tree[size : size + n - 1] = [rank(piece[i : i + 2], NO_PAIR) for i in range(n - 1)]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # of the token that starts at a live position
    before = list(range(-1, n))  # the live position before

    while (least := tree[1]) != NO_PAIR:
        at = 1
        while at < size:
            at *= 2
            if tree[at] != least:
                at += 1
        left = at - size
        gone = end[left]
        stop = end[left] = end[gone]
        before[stop] = left
        # leaves change first, then what stands above them, level by level, each node once
        one, two, three = left + size, gone + size, before[left] + size
        tree[one] = rank(piece[left : end[stop]], NO_PAIR) if stop < n else NO_PAIR
        if gone < size:
            tree[two] = NO_PAIR
        else:
            two = one
        if three >= size:
            tree[three] = rank(piece[three - size : stop], NO_PAIR)
        else:
            three = one
        while one > 1:
            one >>= 1
            two >>= 1
            three >>= 1
            a, b = tree[2 * one], tree[2 * one + 1]
            tree[one] = a if a <= b else b
            if two != one:
                a, b = tree[2 * two], tree[2 * two + 1]
                tree[two] = a if a <= b else b
            if three != one and three != two:
                a, b = tree[2 * three], tree[2 * three + 1]
                tree[three] = a if a <= b else b
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Recent(dict):
    """A bounded memory in two generations: what is used again outlives the older one."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMORY_CHARS:
                return value
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Bytes:
    """The bytes that stand for ids, gathered for many ids at once."""

    def __init__(self, items: dict[int, bytes]):
        self.lengths = np.zeros(max(items, default=-1) + 1, np.int64)
        for i, x in items.items():
            self.lengths[i] = len(x)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(items[i] for i in sorted(items)), np.uint8)

    def __call__(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        if not lengths.all():
            raise ValueError("an id that isn't known")
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ids) else 0)
        return self.blob[places].tobytes()


class Codec:
    """Encodes and decodes texts by ``ranks``, each match of ``pattern`` on its own, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        #: What ids decode to, and their decimal names with a blank behind each.
        self.decode = Bytes({v: k for k, v in ranks.items()})
        self.names = Bytes({v: b"%d " % v for v in ranks.values()})
        #: A single blank between two characters that no engine calls white always starts a match, so texts can be cut there.
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.uneven = regex.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] |\A | \Z")
        self.chunks = Recent(self.chunk)
        # bytes, which the garbage collector needn't visit
        self.pieces = Recent(lambda piece: array("I", merge(piece.encode(), ranks)).tobytes())

    def chunk(self, text: str) -> bytes:
        """The ids of a stretch of text as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.uneven.search(text):
            first, *rest = self.cut.split(text)
        else:
            first, *rest = text.split(" ")
        ids = map(self.chunks.__getitem__, [f" {x}" for x in rest])
        return np.frombuffer(self.chunks[first] + b"".join(ids), "<u4")


def with_codec(df: DataFrame, schema: str, path: str, pattern: str, row: Callable[[Codec, pa.RecordBatch], dict]) -> DataFrame:
    """``row`` over the batches of ``df``, with a codec that a worker's tasks share. The ranks, a file of fixed size, are broadcast."""
    ranks = load_ranks(path)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)
    name = "bpe-" + hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def make():
        codec = shared(name, lambda: Codec(shipped.value, pattern))
        return lambda batch: row(codec, batch)

    return over_batches(df, schema, make, name)


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids array<int>, n_tokens of every row's text."""

    def row(codec: Codec, batch: pa.RecordBatch) -> dict:
        ids = [codec.encode(x) for x in batch["text"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
        flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype("int32")
        return {"doc_id": batch["doc_id"], "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": [len(x) for x in ids]}

    return with_codec(df.select(df.doc_id.cast("long").alias("doc_id"), df.text), "doc_id long, token_ids array<int>, n_tokens long", path, pattern, row)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content binary of every row's token_ids; null ids count as none."""
    return with_codec(
        df.select(df.doc_id.cast("long").alias("doc_id"), "token_ids"), "doc_id long, content binary", path, pattern,
        lambda codec, batch: {"doc_id": batch["doc_id"], "content": [codec.decode(x or []) for x in batch["token_ids"].to_pylist()]},
    )


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids, and of the bytes that the ids decode to."""

    def row(codec: Codec, batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"].to_pylist():
            ids = codec.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(codec.names(ids)[:-1]).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    return with_codec(
        df.select(df.doc_id.cast("long").alias("doc_id"), df.text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, row
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from verbascope.llm.common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
