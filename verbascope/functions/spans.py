"""Where a phrase stands in a sentence: character spans and the tokens they cover.

Keywords are looked for one after the other from where the last one began; one
that isn't found there is looked for in the whole sentence. One that isn't
found at all means no span. The span covers all that lies between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "struct<low:int,high:int,next:int,found:boolean>"


def _found(state: Column) -> Column:
    return F.when(state["found"] & state["low"].isNotNull(), F.struct(state["low"].alias("start"), state["high"].alias("end")))


def _start(next_at: int) -> Column:
    return F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(next_at).alias("next"), F.lit(True).alias("found")).cast(_SPAN)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_span(text: Column, keywords: Column) -> Column:
    """struct<start, end> of keywords as substrings of the lowered text, half open, from 0; null without a match."""
    low = F.lower(text)

    def step(state: Column, word: Column) -> Column:
        onward = F.call_function("locate", word, low, state["next"])
        at = F.when(onward > 0, onward).otherwise(F.call_function("locate", word, low)) - 1
        ok = state["found"] & (at >= 0)
        return F.struct(
            F.when(ok, F.least(at, F.coalesce(state["low"], at))).alias("low"),
            F.when(ok, F.greatest(at + F.length(word), F.coalesce(state["high"], F.lit(0)))).alias("high"),
            F.when(ok, at + 2).otherwise(state["next"]).alias("next"),
            ok.alias("found"),
        ).cast(_SPAN)

    return F.aggregate(keywords, _start(1), step, _found)


def lemma_span(tokens: Column, keywords: Column) -> Column:
    """The same over ``tokens`` array<struct<lemma, orig, cs, ce>>, by lemma or form; a match out of order doesn't move on."""

    def step(state: Column, word: Column) -> Column:
        placed = F.transform(tokens, lambda t, i: F.struct(t["lemma"].alias("lemma"), t["orig"].alias("orig"), t["cs"].alias("cs"), t["ce"].alias("ce"), i.alias("i")))
        hits = F.filter(placed, lambda t: (t["lemma"] == word) | (t["orig"] == word))
        chosen = _bound(hits, lambda h: F.struct(F.get(F.filter(h, lambda t: t["i"] >= state["next"]), F.lit(0)).alias("onward"), F.get(h, F.lit(0)).alias("first")))
        return _bound(chosen, lambda c: moved(state, c["onward"], F.coalesce(c["onward"], c["first"])))

    def moved(state: Column, onward: Column, hit: Column) -> Column:
        ok = state["found"] & hit.isNotNull()
        return F.struct(
            F.when(ok, F.least(hit["cs"], F.coalesce(state["low"], hit["cs"]))).alias("low"),
            F.when(ok, F.greatest(hit["ce"], F.coalesce(state["high"], F.lit(0)))).alias("high"),
            F.when(onward.isNotNull(), onward["i"] + 1).otherwise(state["next"]).alias("next"),
            ok.alias("found"),
        ).cast(_SPAN)

    return F.aggregate(keywords, _start(0), step, _found)


def covered_tokens(tokens: Column, span: Column) -> Column:
    """Places of the tokens (array of structs with start, end) that a span touches; special tokens stand at (0, 0)."""
    placed = F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("i")))
    kept = F.filter(placed, lambda t: ~((t["start"] == 0) & (t["end"] == 0)) & (t["start"] < span["end"]) & (t["end"] > span["start"]))
    return F.when(span.isNull(), F.array().cast("array<int>")).otherwise(F.transform(kept, lambda t: t["i"]))


def phrase_span(text: Column, keywords: Column, lemma_tokens: Column | None = None) -> Column:
    """By lemma where tokens are given, else or failing that as substrings."""
    exact = exact_span(text, keywords)
    return exact if lemma_tokens is None else F.coalesce(lemma_span(lemma_tokens, keywords), exact)
