import random

import pytest

from tests.compare import assert_same
from verbascope.llm import mixing

WORDS = r"[^\x20\x09-\x0D]+"


def test_query(spark, small, oracle):
    assert_same(mixing.op7_source_mix(spark, small), oracle, mixing.ORACLE_SQL)


def filled(sizes):
    """Targets by sharing, capping and sharing again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 10**6]) for s in [*"abcdefgh"[: rng.randrange(1, 9)], None][: rng.randrange(1, 10)]}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = filled(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(expected[r["source"]], abs=1e-6) and r["target"] <= 3 * r["source_size"] + 1e-6
    assert sum(r["target"] for r in rows) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("limit", [0, 10**9])
def test_copies_meet_the_targets_however_sources_are_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", 1 + i % 5) for i in range(6000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for r in got:
        assert taken[r["source"]] == pytest.approx(r["target"], rel=0.15)


def test_edges(spark):
    texts = [(1, "a b", "x"), (1, "a b", "x"), (None, " a\tb\x0bc\n", None), (2, None, "x"), (3, "", ""), (4, "\xa0 \x1c", "y"), (5, "w " * 50000, "y")]
    docs = spark.createDataFrame([(*t, 1, 2.0, 3) for t in texts], "doc_id long, text string, source string, size int, target double, copies int")
    sizes = [r[0] for r in docs.select(mixing.word_count(docs.text)).collect()]
    assert sizes == [2, 2, 3, 0, 0, 2, 50000]
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mix(docs.where("text IS NULL")).collect() == []
    repeats = [r for r in out.collect() if r["doc_id"] == 1]
    assert len(repeats) % 2 == 0


def test_clashing_columns_and_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(1, long, "a"), (2, "one two", "a"), (2, "one two", "a"), (3, None, None), (None, "x", "b")]
    docs = spark.createDataFrame([(*r, 1, 2.0, 3, "k", True) for r in rows], "doc_id long, text string, source string, size int, target double, copies int, _key string, _null boolean")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    often = [r["doc_id"] for r in out.collect()]
    assert often.count(2) % 2 == 0 and all(often.count(r[0]) <= 6 for r in rows)
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    assert {r["doc_id"]: r["size"] for r in sized.collect()} == {1: 300_000, 2: 2, 3: 0, None: 1}
    assert mixing.mix(docs.limit(0)).collect() == []


def test_sources_that_stop_at_the_same_level(spark):
    """Equal quotients of size and weight: ranks decide the order, and targets are what loops give."""
    sizes = {"a": 50, "b": 20, "c": 10, "d": 50, "e": 20, "f": 10_000}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(filled(sizes))
