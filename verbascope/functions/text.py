"""Text expressions, all of them columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the analyses define it: wider than the regex engine's own class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# Words of a phrase that don't locate it.
PLACEHOLDERS = ("sb", "sth", "swh", "do", "doing", "be", "have", "not", "to", "a", "an", "the", "your", "yourself", "one")
# What marks a genre.
CLOSINGS = ("yours faithfully", "yours sincerely", "best wishes", "yours truly")
HEAD_CHARS = 400
ADDRESSED = r"(?U)\bto:\b|\bsubject:\b"
TOLD = r"(?U)\bonce\b|\bsuddenly\b|that day|last (summer|year|week|night)|when i was"
LETTER, REPORT, NARRATIVE, ESSAY = "letter", "report", "narrative", "essay"
GENRES = (LETTER, ESSAY, NARRATIVE, REPORT)
# Part-of-speech tags by first letter.
POS = {"N": "n", "V": "v", "J": "a", "R": "r"}


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def as_text(value: Column) -> Column:
    """Stripped text of a value, whole numbers without a fraction; null stays null."""
    return stripped(F.regexp_replace(value.cast("string"), r"\A(-?\d+)\.0\z", "$1"))


def number_order(value: Column) -> Column:
    """What sorts numbers by size, given as numbers or as text, and before other text."""
    return F.struct(F.coalesce(value.cast("string").try_cast("double"), F.lit(float("inf"))).alias("number"), value.cast("string").alias("text"))


def clean(text: Column) -> Column:
    """Without bracketed notes, which don't cross a line's end, and with single blanks; null becomes empty."""
    without = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\n]*?\]", "")
    return stripped(F.regexp_replace(without, f"{SPACE}+", " "))


def script_id(essay_id: Column) -> Column:
    """The id up to its last underscore."""
    return F.regexp_replace(essay_id.cast("string"), r"_[^_]*\z", "")


def sense_text(definition: Column, example: Column | None = None) -> Column:
    """The cleaned definition, and the cleaned example if one is asked for, without empty parts."""
    parts = [F.nullif(clean(definition), F.lit(""))]
    if example is not None:
        parts.append(F.nullif(clean(example), F.lit("")))
    return F.concat_ws(" ", *parts)


def keywords(phrase: Column) -> Column:
    """The words that locate a phrase, in order."""
    words = F.split(F.regexp_replace(F.lower(phrase), r"['\-]", " "), f"{SPACE}+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*PLACEHOLDERS))


def examples(text: Column) -> Column:
    """Example sentences, split before they are cleaned."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n;；]+"), clean), lambda x: x != "")


def genre(paragraphs: Column) -> Column:
    """Letter, report, narrative or essay, by the first rule that holds."""
    text = F.concat_ws("\n", paragraphs)
    full, head = F.lower(text), F.lower(F.substring(text, 1, HEAD_CHARS))
    letter = head.contains("dear")
    for closing in CLOSINGS:
        letter = letter | full.contains(closing)
    report = stripped(head).startswith("report") | (head.contains("introduction") & full.contains("conclusion")) | head.rlike(ADDRESSED)
    narrative = head.rlike(TOLD) & head.contains(" i ")
    return F.when(letter, LETTER).when(report, REPORT).when(narrative, NARRATIVE).otherwise(ESSAY)


def pos_class(tag: Column) -> Column:
    """Noun, verb, adjective or adverb as n, v, a, r; null for other tags."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in POS.items() for x in pair]), F.coalesce(F.substring(tag, 1, 1), F.lit("")))


def terms(text: Column) -> Column:
    """Lower-case words of two and more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters: the native tokenizer, for where no analyzer is plugged in."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
