import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbascope.functions import vectors
from verbascope.functions.spans import lemma_span
from verbascope.functions.text import keywords
from verbascope.operators import encoders, wsd
from verbascope.plans import cli, reports
from verbascope.sources import workbooks

INVENTORY = "row_no long, term string, sense_no int, definition string, dict_example string, learner_example string, level string"
ROWS = [
    (1, "go on", 1, "to continue", "Please go on with it.\nGo on [x] now", "We went on [sic] and go on", "A2"),
    (2, "go on", 1, "again", "other", "other", "C1"),
    (3, "go on", 2, "to happen", None, "What is going on here", "B1"),
    (4, "single", 1, "one", None, "said", "A1"),
    (5, "half", 1, "one", None, "said", "A1"),
    (6, "half", 2, "two", None, "[note]", "A1"),
    (7, "make up", 2, "invent a story", "make it up; they make up lies", "he will make up a story", "B2"),
    (8, "make up", 1, "become friends", "kiss and make up", "they make up at last", "B1"),
]


@pytest.fixture
def senses(spark):
    return wsd.evaluable(wsd.sense_inventory(spark.createDataFrame(ROWS, INVENTORY)))


def test_inventory(spark, senses):
    kept = wsd.sense_inventory(spark.createDataFrame(ROWS, INVENTORY)).where("term = 'go on' AND sense_no = 1").first()
    assert kept["definition"] == "to continue" and kept["clean_learner"] == "We went on and go on"
    assert {(r["term"], r["sense_no"]) for r in senses.collect()} == {("go on", 1), ("go on", 2), ("make up", 1), ("make up", 2)}
    assert wsd.pairs(senses).count() == 8


def tfidf(texts):
    """The formula itself: smoothed idf over the texts, unit length, the last against the others."""
    words = [Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in texts]
    df = Counter(w for c in words for w in c)
    made = [{w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for c in words]
    size = [math.sqrt(sum(x * x for x in m.values())) for m in made]
    return [sum(x * made[-1].get(w, 0) for w, x in m.items()) / (s * size[-1]) if s and size[-1] else 0.0 for m, s in zip(made[:-1], size, strict=False)]


@pytest.mark.parametrize("strategy", ["def", "def+ex"])
def test_tfidf(spark, senses, strategy):
    texts = wsd.sense_texts(senses, strategy)
    targets = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("target"))
    got = {(r["term"], r["gold_no"]): r for r in wsd.predicted(wsd.tfidf_similarities(texts, targets)).collect()}
    by_term = {}
    for r in sorted(texts.collect(), key=lambda r: r["sense_no"]):
        by_term.setdefault(r["term"], []).append(r["text"])
    for r in targets.collect():
        expected = tfidf([*by_term[r["term"]], r["target"]])
        row = got[r["term"], r["gold_no"]]
        assert row["sims"] == pytest.approx(expected, abs=1e-12)
        assert row["pred_no"] == 1 + int(np.argmax(expected)) and row["is_correct"] == (row["pred_no"] == r["gold_no"])


def test_ties_and_single_senses(spark):
    rows = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 1, 0.5), ("b", 1, 1, 0.2), ("c", 1, 1, 0.50001), ("c", 1, 2, 0.50005)], "term string, gold_no int, sense_no int, sim double")
    got = {r["term"]: r for r in wsd.predicted(rows).collect()}
    assert got["a"]["pred_no"] == 1 and got["a"]["is_tie"] and got["b"]["sim_gap"] == 1.0 and not got["b"]["is_tie"]
    assert got["c"]["pred_no"] == 2 and got["c"]["is_tie"]


def test_cosine_and_pooling(spark):
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0], [0, 0, 0])], "a array<float>, b array<float>, z array<float>, v array<array<float>>, m array<int>, n array<int>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.pooled(F.col("v"), F.col("m")), vectors.pooled(F.col("v"), F.col("n")), vectors.pooled(F.col("v"))).first()
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] == [2.0, 4.0] and got[3] is None and got[4] == pytest.approx([13 / 3, 17 / 3])


def test_summary_of_nothing(spark):
    rows = spark.createDataFrame([], "is_correct boolean, is_tie boolean, target_matched boolean, n_senses int")
    assert tuple(wsd.summary(rows).first()) == (0, 0, 0.0, 0) and wsd.ablation(rows).collect() == [] and wsd.match_rate(rows).first()[0] == 0


def test_ablation_rounds(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (True, False), (False, False), (None, True)], "target_matched boolean, is_correct boolean")
    assert {tuple(r) for r in wsd.ablation(rows).collect()} == {("matched", 3, 1, 0.3333), ("fallback", 1, 0, 0.0)}
    assert wsd.match_rate(rows).first()[0] == 0.6


def test_match_stats_count_examples_once_a_target(spark):
    rows = spark.createDataFrame([("go on", "target", "x", 1, 1), ("go on", "sense_ex", "y" * 90, 0, 2), ("to go on", "sense_ex", "z", 2, 2)], "term string, label string, text string, n_tokens int, weight int")
    log = wsd.match_log(rows)
    assert {r["phrase"] for r in log.collect()} == {"go on"} and max(len(r["text"]) for r in log.collect()) == 80
    got = {(r["by"], r["value"]): (r["total"], r["matched"], r["fallback"], r["match_rate"]) for r in wsd.match_stats(log).collect()}
    assert got == {
        ("overall", ""): (5, 3, 2, 0.6), ("label", "target"): (1, 1, 0, 1.0), ("label", "sense_ex"): (4, 2, 2, 0.5), ("phrase", "go on"): (5, 3, 2, 0.6),
        ("method", "exact"): (3, 3, 0, 1.0), ("method", "fallback"): (2, 0, 2, 0.0),
    }
    assert {r["match_method"] for r in wsd.match_log(rows, has_lemmas=True).collect()} == {"lemma", "fallback"}
    assert wsd.match_stats(log.limit(0)).collect() == []


def test_phrase_vectors(spark):
    rows = spark.createDataFrame([("make up", "we make it up now"), ("make up", "nothing here")], "term string, text string")
    encoder = encoders.HashingEncoder()
    got = encoders.phrase_vectors(encoders.token_vectors(rows, encoders.HashingEncoder)).orderBy(F.desc("n_tokens")).collect()
    assert [r["n_tokens"] for r in got] == [3, 0]
    mean = lambda words: np.mean([encoder.word(w) for w in words], axis=0)
    assert np.allclose(got[0]["vec"], mean(["make", "it", "up"]), atol=1e-6) and np.allclose(got[1]["vec"], mean(["nothing", "here"]), atol=1e-6)
    whole = encoders.sentence_vectors(encoders.token_vectors(rows, encoders.HashingEncoder)).where("text = 'nothing here'").first()["vec"]
    assert np.allclose(whole, (encoder.word("nothing") + encoder.word("here")) / 4, atol=1e-6)


@pytest.mark.parametrize("encoder", ["tfidf", "bert", "bert_sentence", "bert_phrase"])
def test_encoders_end_to_end(spark, senses, encoder):
    found, matches, log = cli.similarities(senses, encoder, "def+ex", encoders.HashingEncoder, encoders.HashingEncoder, encoders.PlainAnalyzer)
    details = wsd.detailed(wsd.predicted(found), senses, matches).cache()
    assert details.count() == 4 and (encoder == "bert_phrase") == (details.where("target_matched").count() > 0)
    book = reports.evaluation_workbook(details, "e", "s")
    lines = list(workbooks.rows(book))
    assert len(lines) == 4 and set(lines[0]) == set(reports.DETAIL_HEADERS) and {x["是否正确"] for x in lines} <= {"✓", "✗"}
    shown = reports.evaluation_console(details, "e", "s", log)
    assert "Accuracy" in shown and ("[匹配方式]" in shown) == (encoder == "bert_phrase") == (log is not None)
    if log is not None:
        stats = {(r["by"], r["value"]): r["total"] for r in wsd.match_stats(log).collect()}
        assert stats["label", "target"] == 4 and "match_method_actual" in log.columns


def test_the_true_method_beside_the_named_one(spark):
    """With lemmas every match is called one by lemma; the true method tells those by characters apart."""
    rows = spark.createDataFrame([("make up", "He made up"), ("make up", "remake it upward"), ("make up", "no")], "term string, text string")
    lemmas = F.when(F.col("text").startswith("He"), F.array(*[F.struct(F.lit(a).alias("lemma"), F.lit(b).alias("orig"), F.lit(c).alias("cs"), F.lit(d).alias("ce")) for a, b, c, d in (("he", "he", 0, 2), ("make", "made", 3, 7), ("up", "up", 8, 10))]))
    tokens = encoders.token_vectors(rows, encoders.HashingEncoder).withColumn("lemmas", F.coalesce(lemmas, F.array().cast("array<struct<lemma:string,orig:string,cs:int,ce:int>>")))
    found = encoders.phrase_vectors(tokens, lemmas="lemmas").withColumns({"label": F.lit("target"), "weight": F.lit(1)})
    log = {r["text"]: (r["match_method"], r["match_method_actual"]) for r in wsd.match_log(found, has_lemmas=True).collect()}
    assert log == {"He made up": ("lemma", "lemma"), "remake it upward": ("lemma", "exact"), "no": ("fallback", "fallback")}
    assert [tuple(r) for r in wsd.by_method(wsd.match_stats(wsd.match_log(found, True))).collect()] == [("fallback", 0), ("lemma", 2)]


def test_senses_numbered_by_text(spark):
    """Sense numbers as text sort as numbers where they are, and text after them; ties go to the first."""
    rows = spark.createDataFrame([("a", "1", "10", 0.5), ("a", "1", "9", 0.5), ("a", "1", "2a", 0.1), ("b", "x", "x", 0.2), ("b", "x", "y", 0.9)], "term string, gold_no string, sense_no string, sim double")
    got = {r["term"]: r for r in wsd.predicted(rows).collect()}
    assert got["a"]["pred_no"] == "9" and got["a"]["sims"] == [0.5, 0.5, 0.1] and got["b"]["pred_no"] == "y" and not got["b"]["is_correct"]
    senses = spark.createDataFrame([("a", "10", "x"), ("a", "2", "y"), ("a", "2a", "z"), ("a", None, "n")], "term string, sense_no string, definition string")
    assert [s["sense_no"] for s in wsd.senses_in_order(senses.where("sense_no IS NOT NULL")).first()["senses"]] == ["2", "10", "2a"]
    assert reports.plain("12") == 12 and reports.plain("2a") == "2a" and reports.plain(3) == 3


def test_content_words(spark):
    rows = spark.createDataFrame([("e", ["One Two", "three"]), ("f", [])], "essay_id string, paragraphs array<string>")
    assert sorted(tuple(r) for r in encoders.content_words(rows, encoders.PlainAnalyzer).collect()) == [("e", "one", "one"), ("e", "three", "three"), ("e", "two", "two")]


def test_keywords_give_the_span_that_all_words_give(spark):
    """Words that aren't keywords leave no lemmas behind, and the spans by lemma are those of all words."""
    texts = ["up we make it up", "make a made up make", "Make UP", "", None, "up", "on and on it went on"]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate((t, p) for t in texts for p in ("make up", "up make up", "on", "to be"))], "i long, text string, term string").withColumn("keys", keywords(F.col("term")))
    few, every = (encoders.lemma_tokens(rows, encoders.PlainAnalyzer, among=x) for x in ("keys", None))
    assert all(t["lemma"] in r["keys"] for r in few.collect() for t in r["lemmas"])
    got, want = ({r[0]: r[1] for r in x.select("i", lemma_span(F.col("lemmas"), F.col("keys"))).collect()} for x in (few, every))
    assert got == want and sum(x is not None for x in want.values()) > 5
