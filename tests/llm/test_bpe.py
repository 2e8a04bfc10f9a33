import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from verbascope.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "\x1c \x1f x\x85y", "don't we'll 'S", "  two  three \n\n x ", "日本語 😀😀  é́", "　wide line", "<|endoftext|>", "a\tb\r\nc"]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(codec, known, text):
    ids = codec.encode(text).tolist()
    assert ids == known.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_random_texts(codec, known):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(" \n\t  'sré1²x\x1c\x85　-aB​😀日") for _ in range(rng.randrange(50)))
        assert codec.encode(text).tolist() == known.encode_ordinary(text)


def slow(piece, ranks):
    """The rule itself: merge the leftmost pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_the_rule():
    rng = random.Random(1)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    for _ in range(40):
        ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), len(ranks))
    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        expected = [ranks[piece]] if piece in ranks else slow(piece, ranks)
        assert bpe.merge(piece, ranks) == expected


def test_memory_is_bounded(monkeypatch, known):
    monkeypatch.setattr(bpe, "MEMORY", 7)
    codec = bpe.Codec(bpe.load_ranks(PATH), PATTERN)
    text = " ".join(f"w{i % 20}" for i in range(300))
    assert codec.encode(text).tolist() == known.encode_ordinary(text)
    assert max(len(x) for m in (codec.chunks, codec.pieces) for x in (m, m.older)) <= 7


def test_frames(spark, known):
    texts = [None, "", "hello world", "hello world", *ODD]
    docs = spark.createDataFrame([(None if i == 2 else i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, token_ids string")
    ids = bpe.encode(docs, PATH, PATTERN)
    assert sorted(r["n_tokens"] for r in ids.collect()) == sorted(len(known.encode_ordinary(t or "")) for t in texts)
    back = {r["doc_id"]: bytes(r["content"]) for r in bpe.decode(ids, PATH, PATTERN).collect()}
    assert back[0] == b"" and back[3] == b"hello world" and back[None] == b"hello world"
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, PATTERN).collect()}
    for i, t in enumerate(texts):
        row, ids = rows[None if i == 2 else i], known.encode_ordinary(t or "")
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_query(spark, small, known):
    rows = {r["doc_id"]: r for r in bpe.op4_byte_bpe(spark, small).collect()}
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = known.encode_ordinary(text)
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["decoded_sha256"]) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert rows[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_a_worker_gives_up_what_another_operator_left():
    from verbascope.llm import common

    made = []
    first = common.shared("one", lambda: made.append(1) or object())
    assert common.shared("one", lambda: made.append(1) or object()) is first and made == [1]
    common.shared("two", lambda: made.append(2) or object())
    assert set(common._shared) == {"two"}
    common.give_up("two")
    assert set(common._shared) == {"two"}
    common.give_up()
    assert common._shared == {} and common.shared("one", lambda: made.append(3)) is None and made == [1, 2, 3]
    common.give_up()
