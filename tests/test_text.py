import random
import re

import pytest
from pyspark.sql import functions as F

from verbascope.functions import spans, text


def one(spark, column, **values):
    """The value of a column over one row of strings and arrays."""
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(x) for x in value]).cast("array<string>"))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("given", "clean"), [("I  go [went] home\n now ", "I go home now"), ("a[b\nc]d", "a[b c]d"), (None, ""), ("", ""), ("[x]", ""), ("a\x1cb c\xa0", "a b c")])
def test_clean(spark, given, clean):
    assert one(spark, text.clean(F.col("t")), t=given) == clean


def test_space_is_that_of_python(spark):
    points = [i for i in range(0x3001) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points], "i int, t string").select("i", F.col("t").rlike(f"a{text.SPACE}b")).collect()
    assert {i for i, x in rows if x} == {i for i in points if chr(i).isspace()}


@pytest.mark.parametrize(("phrase", "words"), [("make up for sth", ["make", "up", "for"]), ("be in sb's shoes", ["in", "s", "shoes"]), ("to be the one", []), ("", []), ("Well-Known", ["well", "known"])])
def test_keywords(spark, phrase, words):
    assert one(spark, text.keywords(F.col("p")), p=phrase) == words


@pytest.mark.parametrize(("given", "sentences"), [("A x.；B y;\n", ["A x.", "B y"]), (None, []), ("see [a;b] now", ["see [a", "b] now"]), (";;", [])])
def test_examples(spark, given, sentences):
    assert one(spark, text.examples(F.col("t")), t=given) == sentences


@pytest.mark.parametrize(("essay", "script"), [("TR3*0100*2000*02_A1", "TR3*0100*2000*02"), ("noscore", "noscore"), ("a_b_c", "a_b"), ("_x", ""), ("a_\n", "a"), ("x_", "x")])
def test_script(spark, essay, script):
    assert one(spark, text.script_id(F.col("e")), e=essay) == script == essay.rsplit("_", 1)[0]


@pytest.mark.parametrize(("given", "genre"), [
    ("Dear Sir", "letter"), ("Report on x", "report"), ("to:john", "report"), ("to: john", "essay"), ("Well i was once here", "narrative"), ("Hello", "essay"),
    ("  report", "report"), ("introduction " + "x" * 500 + " conclusion", "report"), ("x" * 400 + "dear", "essay"), ("x" * 500 + "Yours Truly", "letter"), ("once upon", "essay"), ("", "essay"),
])
def test_genre(spark, given, genre):
    assert one(spark, text.genre(F.split("t", "\n")), t=given) == genre


def test_pos_and_coercion(spark):
    assert [one(spark, text.pos_class(F.col("t")), t=x) for x in ("NNS", "VBD", "JJ", "RP", "DT", "")] == ["n", "v", "a", "r", None, None]
    assert [one(spark, text.as_text(F.lit(x))) for x in (1.0, 1, " a\xa0", "1.5")] == ["1", "1", "a", "1.5"]


def test_terms_are_those_of_python(spark):
    samples = ["Über-cool naïve x y2 _z éa 日本 a'b", "one1 two_2  ! A", ""]
    rows = spark.createDataFrame([(x,) for x in samples], "t string").select(text.terms(F.col("t"))).collect()
    assert [r[0] for r in rows] == [re.findall(r"\b\w\w+\b", x.lower()) for x in samples]


def exact(sentence, words):
    low, found, at = sentence.lower(), [], 0
    for w in words:
        pos = low.find(w, at)
        pos = low.find(w) if pos < 0 else pos
        if pos < 0:
            return None
        found.append((pos, pos + len(w)))
        at = pos + 1
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def test_exact_span(spark):
    rng = random.Random(1)
    cases = [("make it up", ["make", "up"]), ("up we make", ["make", "up"]), ("made up", ["make", "up"]), ("x", [])]
    cases += [("".join(rng.choice("aAb ") for _ in range(rng.randrange(14))), ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4))]) for _ in range(300)]
    rows = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(cases)], "i int, s string, k array<string>").select("i", spans.exact_span(F.col("s"), F.col("k")).alias("x")).collect()
    assert {i: x and tuple(x) for i, x in rows} == {i: exact(*c) for i, c in enumerate(cases)}


def test_lemma_span_and_tokens(spark):
    tokens = [("she", "she", 0, 3), ("make", "made", 4, 8), ("it", "it", 9, 11), ("up", "up", 12, 14)]
    row = spark.createDataFrame([([dict(zip(("lemma", "orig", "cs", "ce"), t, strict=True)) for t in tokens], ["make", "up"], ["up", "make"], ["go"])], "t array<struct<lemma:string,orig:string,cs:int,ce:int>>, a array<string>, b array<string>, c array<string>")
    got = row.select(*[spans.lemma_span(F.col("t"), F.col(x)) for x in "abc"]).first()
    assert tuple(got[0]) == (4, 14) and tuple(got[1]) == (4, 14) and got[2] is None
    places = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 0), (0, 3), (4, 8), (9, 11), (0, 0))])
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    got = spark.range(1).select(spans.covered_tokens(places, span(4, 9)), spans.covered_tokens(places, span(3, 10)), spans.covered_tokens(places, F.lit(None).cast("struct<start:int,end:int>"))).first()
    assert list(got) == [[2], [2, 3], []]
