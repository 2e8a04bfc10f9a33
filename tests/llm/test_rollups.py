import base64
import threading
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from verbascope.llm import common, rollups

SCHEMA = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long"


def changes(spark, rows, sign):
    return rollups.signed(spark.createDataFrame(rows, SCHEMA), sign)


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}


def test_deltas(spark):
    rollup = rollups.Rollup(spark, common.fresh_dir(spark, "r"))
    assert totals(rollup) == {}
    rows = [(1, "a", "en", "t1", 10, 40), (2, "a", "en", "t1", 5, 20), (3, None, None, "t1", 7, 28), (3, None, None, "t1", 7, 28)]
    assert rollup.commit("one", changes(spark, rows, 1)) and rollup.committed("one") and not rollup.committed("two")
    first = {("a", "en", "t1"): (2, 15, 60), (None, None, "t1"): (2, 14, 56)}
    assert totals(rollup) == first
    # sent again, even with other rows, a batch changes nothing
    assert not rollup.commit("one", changes(spark, rows * 3, 1)) and totals(rollup) == first
    revised = rollups.revised(spark.createDataFrame(rows[:1], SCHEMA), spark.createDataFrame([(1, "a", "en", "t2", 12, 40)], SCHEMA))
    assert rollup.commit("two/..", revised)
    assert totals(rollup) == {("a", "en", "t1"): (1, 5, 20), ("a", "en", "t2"): (1, 12, 40), (None, None, "t1"): (2, 14, 56)}
    assert rollup.commit("three", changes(spark, rows[1:], -1)) and totals(rollup) == {("a", "en", "t2"): (1, 12, 40)}
    assert rollup.commit("empty", changes(spark, [], 1)) and rollup.committed("empty") and totals(rollup) == {("a", "en", "t2"): (1, 12, 40)}
    assert rollup.commit("never there", changes(spark, [(9, "z", "de", "t1", 4, 9)], -1)) and totals(rollup)["z", "de", "t1"] == (-1, -4, -9)
    # another handle on the folder sees the same
    assert totals(rollups.Rollup(spark, rollup.folder)) == totals(rollup)


def test_order_of_batches_does_not_matter(spark):
    parts = {f"b{i}": ([(i, "a", "en", "t", i, 2 * i)], 1 if i % 3 else -1) for i in range(1, 6)}
    found = []
    for names in (sorted(parts), sorted(parts, reverse=True)):
        rollup = rollups.Rollup(spark, common.fresh_dir(spark, "r"))
        for name in names:
            rollup.commit(name, changes(spark, *parts[name]))
        found.append(totals(rollup))
    assert found[0] == found[1]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", 5), (None, "", None, None, 6), (2, "two words", "s", "en", 7), (2, "two words", "s", "en", 7)], "doc_id long, text string, source string, lang string, tokens int")
    rows = [tuple(r)[1:] for r in rollups.word_counts(docs).collect()]
    assert sorted(rows, key=str) == sorted([("s", "en", "words-1", 0, 0), (None, None, "words-1", 0, 0), ("s", "en", "words-1", 2, 9), ("s", "en", "words-1", 2, 9)], key=str)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert sorted(r["tokens"] for r in rollups.bpe_counts(docs, path, pattern).collect()) == [0, 0, 2, 2]
    assert rollups.bpe_counts(docs.limit(0), path, pattern).collect() == []


def test_query(spark, small):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = defaultdict(lambda: [0, 0, 0])
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        for tokenizer, n in ((rollups.WORDS, len(d["text"].split())), (rollups.BPE, len(known.encode_ordinary(d["text"])))):
            entry = expected[d["source"], d["lang"], tokenizer]
            entry[0], entry[1], entry[2] = entry[0] + 1, entry[1] + n, entry[2] + len(d["text"])
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"], r["chars"]] for r in rollups.op5_token_rollup(spark, small).collect()}
    assert got == expected


def test_of_racing_committers_one_commits(spark):
    for turn in range(5):
        rollup, barrier, did = rollups.Rollup(spark, common.fresh_dir(spark, "r")), threading.Barrier(3), []

        class Late(rollups.Rollup):
            def claim(self, path, lines):
                barrier.wait()  # all have found the batch missing and written their sums
                return super().claim(path, lines)

        def commit(n):
            did.append((Late(spark, rollup.folder).commit("same", changes(spark, [(1, "a", "en", "t", n, n)], 1)), n))

        threads = [threading.Thread(target=commit, args=(n,)) for n in (1, 2, 3)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        won = [n for yes, n in did if yes]
        assert len(won) == 1 and len(did) == 3
        assert totals(rollup) == {("a", "en", "t"): (1, won[0], won[0])} and not rollup.commit("same", changes(spark, [], 1))


def test_a_lost_writer_leaves_no_batch(spark, monkeypatch):
    rollup = rollups.Rollup(spark, common.fresh_dir(spark, "r"))
    rollup.commit("one", changes(spark, [(1, "a", "en", "t", 3, 9)], 1))
    # sums and a claim without a marker
    rollup.put(spark.createDataFrame([("a", "en", "t", 7, 7, 7)], rollups.SCHEMA))
    monkeypatch.setattr(rollup, "linked", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rollup.commit("two", changes(spark, [(2, "a", "en", "t", 1, 1)], 1))
    monkeypatch.undo()
    assert not rollup.committed("two") and totals(rollup) == {("a", "en", "t"): (1, 3, 9)}
    assert rollup.commit("two", changes(spark, [(2, "a", "en", "t", 1, 1)], 1)) and totals(rollup) == {("a", "en", "t"): (2, 4, 10)}


def test_compaction(spark):
    rollup = rollups.Rollup(spark, common.fresh_dir(spark, "r"))
    assert rollup.compact() and totals(rollup) == {}
    for n in range(1, 5):
        rollup.commit(f"b{n}", changes(spark, [(n, "a", "en", "t", n, n)], 1))
    before = totals(rollup)
    assert rollup.compact() and totals(rollup) == before and len(rollup.listed("sums")) == 6
    assert not rollup.commit("b2", changes(spark, [(2, "a", "en", "t", 2, 2)], 1))
    rollup.commit("b5", changes(spark, [(5, "b", "en", "t", 5, 5)], 1))
    assert totals(rollup) == before | {("b", "en", "t"): (1, 5, 5)}
    assert rollup.compact() and totals(rollup) == before | {("b", "en", "t"): (1, 5, 5)} and len(rollup.listed("sums")) == 3
    assert rollup.compact() and totals(rollup) == before | {("b", "en", "t"): (1, 5, 5)} and len(rollup.listed("sums")) == 2
    # another that works from the same state comes too late
    late, seen = rollups.Rollup(spark, rollup.folder), rollup.compacted()
    late.compacted = lambda: (seen[0] - 1, *seen[1:])
    assert not late.compact() and totals(rollup)["b", "en", "t"] == (1, 5, 5)


def test_very_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long, "s", "en", "x", 3, 4)], "doc_id long, text string, source string, lang string, tokenizer string, tokens int, sign int")
    assert [r["tokens"] for r in rollups.word_counts(docs).collect()] == [200_000]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert [(r["tokenizer"], r["chars"]) for r in rollups.bpe_counts(docs, path, pattern).collect()] == [(rollups.BPE, len(long))]
    assert rollups.word_counts(docs.limit(0)).collect() == []
