import random

import pytest

from verbascope.operators import indices, ordering
from verbascope.plans import catalog

HITS = "row_no long, essay_id string, phrase string, is_poly string, sense string, cefr string, pos string, total_score double"
PV = "phrasal verb"


def hits(spark):
    """The worked example: levels, phrasal verbs, polysemy, an unresolved hit in two essays."""
    rows = [
        ("S1_A1", "a", "否", None, "A1", PV, 30.0), ("S1_A1", "b", "否", None, "A2", "noun", 30.0), ("S1_A1", " poly ", "是", "1", "A1", PV, 30.0),
        ("S1_A1", "c", "否", None, " C1 ", "noun", 30.0), ("S1_A1", "poly", "是", "not_applied", "B1", "noun", 30.0),
        ("S1_A2", "d", "否", None, "B1", "noun", 30.0), ("S1_A2", "e", "否", None, "C2", PV, 30.0), ("S2_A1", "poly", "是", "9", None, "noun", 20.0),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], HITS)


def levels(spark):
    rows = [(1, "poly", 1, "A1"), (2, "poly", 1, "B2"), (3, "poly", 2, ""), (4, "", 1, "C1"), (5, "x", None, "C1")]
    return indices.sense_levels(spark.createDataFrame(rows, "row_no long, term string, sense_no int, level string"))


def test_last_level_holds(spark):
    assert {tuple(r) for r in levels(spark).collect()} == {("poly", "1", "B2"), ("poly", "2", "")}


def test_answers(spark):
    resolved = indices.resolved(hits(spark), levels(spark))
    rows = {r["essay_id"]: r.asDict() for r in indices.phrase_indices(resolved).collect()}
    assert set(rows) == {"S1_A1", "S1_A2"}
    first, second = rows["S1_A1"], rows["S1_A2"]
    ratio = lambda r, *names: [r[f"PH_ratio_{n}"] for n in names]
    assert ratio(first, "A1", "A2", "B1", "B2", "C1", "C2") == [0.25, 0.25, 0, 0.25, 0.25, 0]
    assert ratio(first, "A", "B", "C", "AboveB1", "AboveB2") == [0.5, 0.25, 0.25, 0.5, 0.5]
    assert [first[k] for k in ("PH_mean_score", "PH_high_low_ratio", "PH_score_var", "PH_pv_ratio", "PH_multi_ratio", "PH_level_coverage", "n_phrases")] == [3.0, 1.0, 2.5, 0.4, 0.4, 0.8, 5]
    assert ratio(second, "A", "B", "C", "AboveB1", "AboveB2") == [0, 0.5, 0.5, 1, 0.5]
    assert [second[k] for k in ("PH_mean_score", "PH_high_low_ratio", "PH_score_var", "PH_pv_ratio", "PH_multi_ratio")] == [4.5, None, 2.25, 0.5, 0]
    assert indices.unresolved(resolved).first()[0] == 2


def test_scripts_merge_hits_first(spark):
    row = indices.phrase_indices(indices.resolved(hits(spark), levels(spark)), "script").first()
    assert row["essay_id"] == "S1" and row["n_phrases"] == 7
    assert [row[f"PH_ratio_{n}"] for n in ("A1", "A2", "B1", "B2", "C1", "C2")] == [1 / 6] * 6
    assert [row[k] for k in ("PH_mean_score", "PH_high_low_ratio", "PH_score_var", "PH_pv_ratio", "PH_multi_ratio", "PH_level_coverage")] == [3.5, 2.0, 2.9166666666666665, 3 / 7, 2 / 7, 6 / 7]


@pytest.mark.parametrize(("scores", "kept"), [([5.0, None], 0), ([None, 5.0], 1), ([5.0, 0.0], 0), ([5.0, -1.0], 0), ([0.0, 5.0], 1)])
def test_the_last_score_decides(spark, scores, kept):
    rows = [(i, "x", "p", "否", None, "A1", "noun", s) for i, s in enumerate(scores)]
    resolved = indices.resolved(spark.createDataFrame(rows, HITS), levels(spark))
    assert indices.phrase_indices(resolved).count() == kept


def test_properties_hold_in_any_order(spark, small):
    from verbascope.plans.views import view

    resolved = indices.resolved(view(spark, small, "hits"), indices.sense_levels(view(spark, small, "inventory"))).cache()
    rows = {r["essay_id"]: r.asDict() for r in indices.phrase_indices(resolved).collect()}
    again = {r["essay_id"]: r.asDict() for r in indices.phrase_indices(resolved.repartition(7)).collect()}
    assert rows == again and rows
    for r in random.Random(0).sample(sorted(rows.values(), key=lambda r: r["essay_id"]), 50):
        assert sum(r[f"PH_ratio_{k}"] for k in ("A1", "A2", "B1", "B2", "C1", "C2")) == pytest.approx(1)
        assert r["PH_ratio_A"] + r["PH_ratio_B"] + r["PH_ratio_C"] == pytest.approx(1)
        assert r["PH_ratio_AboveB1"] == pytest.approx(1 - r["PH_ratio_A"]) and 0 < r["PH_level_coverage"] <= 1


def test_word_levels(spark):
    dictionary = spark.createDataFrame([("go", "A1"), ("went", "B1"), ("bad", "?"), ("worse", "C1"), ("", "A1"), (None, "A1"), ("well", "C2")], "word string, min_level string")
    tokens = spark.createDataFrame([("e", "went", "go"), ("e", "worse", "bad"), ("e", "well", "x"), ("e", "zzz", "zzz"), ("e", "", "")], "essay_id string, word string, lemma string")
    got = indices.dictionary_levels(tokens, dictionary)
    assert {(r["word"], r["level"]) for r in got.collect()} == {("went", "A1"), ("well", "C2")}


@pytest.mark.parametrize(("n", "kept"), [(4, 0), (5, 1)])
def test_word_indices_need_five(spark, n, kept):
    rows = spark.createDataFrame([("e", "A1")] * n, "essay_id string, level string")
    got = indices.word_indices(rows)
    assert got.count() == kept
    if kept:
        assert got.first().asDict() == {"essay_id": "e", "W_ratio_A1": 1, "W_ratio_A": 1, "W_ratio_B": 0, "W_ratio_C": 0, "W_ratio_AboveB1": 0, "W_mean_score": 1, "W_n": 5}


def test_first_and_last(spark):
    rows = spark.createDataFrame([(2, "k", "b"), (1, "k", "a"), (3, "k", None)], "row_no long, k string, v string")
    assert ordering.first_wins(rows, ["k"]).first()["v"] == "a"
    assert ordering.last_wins(rows, ["k"]).first()["v"] is None


def test_empty_tables(spark):
    resolved = indices.resolved(spark.createDataFrame([], HITS), levels(spark))
    assert indices.phrase_indices(resolved).collect() == [] and indices.unresolved(resolved).first()[0] == 0


def test_common_words_are_not_shuffled(spark, monkeypatch):
    """Words above the bound meet a broadcast of their levels, others are joined by a shuffle, and both are counted as single look-ups count them."""
    monkeypatch.setattr(indices, "COMMON", 10)
    rows = [(f"e{i % 7}", w, w) for i in range(100) for w in ("the", "the", "of", f"w{i % 40}")] + [("e1", "go", "went"), ("e2", None, "the"), ("e3", "x", None)]
    tokens = spark.createDataFrame(rows, "essay_id string, lemma string, word string")
    dictionary = spark.createDataFrame([("the", "A1"), ("go", "B1"), ("went", "C1"), ("of", "X9"), *((f"w{i}", indices.LEVELS[i % 6]) for i in range(0, 40, 2))], "word string, min_level string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = indices.counted_levels(tokens, dictionary)
        assert "BroadcastHashJoin [lemma" in got._jdf.queryExecution().executedPlan().toString()
        total = {tuple(r) for r in got.groupBy("essay_id", "level").agg({"n": "sum"}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    known = tokens.where("lemma IS NOT NULL AND word IS NOT NULL")
    assert total == {tuple(r) for r in indices.dictionary_levels(known, dictionary).groupBy("essay_id", "level").count().collect()}


def test_the_dictionary_sorts_no_tokens(spark, small):
    """The words of all texts are counted by hash before the greatest level of each is taken."""
    lines = catalog.word_indices(spark, small)._jdf.queryExecution().executedPlan().toString().splitlines()
    for i in (i for i, x in enumerate(lines) if "Generate explode" in x):
        last = max(k for k in range(i) if "Exchange" in lines[k])
        assert "SortAggregate" not in "".join(lines[last:i])
