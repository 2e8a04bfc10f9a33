"""Where models plug in: encoders of sentences, providers of token vectors, analyzers of words.

Each is made once for each Python worker from a factory, and is fed Arrow
batches. Nothing here ships a model; the hashing encoder and the plain
analyzer are deterministic stand-ins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.functions.spans import covered_tokens, exact_span, lemma_span
from verbascope.functions.text import keywords, pos_class
from verbascope.functions.vectors import pooled


class Encoder(Protocol):
    """A sentence encoder."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TokenVectors(Protocol):
    """A contextual model: tokens of a text with their places (specials at (0, 0), first and last) and vectors."""

    name: str

    def tokens(self, texts: list[str]) -> list[list[tuple[int, int, np.ndarray]]]: ...


class Analyzer(Protocol):
    """A tagger: (word, tag, lemma, start, end) of each word of a text."""

    def analyze(self, texts: list[str]) -> list[list[tuple[str, str, str, int, int]]]: ...


class HashingEncoder:
    """Sums of hashed word vectors: no model, only something that behaves like one."""

    def __init__(self, dim: int = 16):
        self.name, self.dim = f"hashing-{dim}", dim

    def word(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(word.lower().encode()).digest()[:8], "big")
        return np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([sum((self.word(w) for w in t.split()), np.zeros(self.dim, np.float32)) for t in texts], np.float32).reshape(len(texts), self.dim)

    def tokens(self, texts: list[str]) -> list[list[tuple[int, int, np.ndarray]]]:
        special = (0, 0, np.zeros(self.dim, np.float32))
        return [[special, *((m.start(), m.end(), self.word(m[0])) for m in re.finditer(r"\S+", t)), special] for t in texts]


class PlainAnalyzer:
    """Every run of letters is a noun and its own lemma."""

    def analyze(self, texts: list[str]) -> list[list[tuple[str, str, str, int, int]]]:
        return [[(m[0], "NN", m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)] for t in texts]


def encoded(rows: DataFrame, factory: Callable[[], Encoder], text: str = "text", vec: str = "vec", batch: int = 64) -> DataFrame:
    """``rows`` with a vector for ``text``; texts of a batch are encoded together, by length."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list = [None] * len(texts)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                for i, v in zip(some, encoder.encode([texts[i] for i in some]), strict=True):
                    out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    return rows.withColumn(vec, run(F.col(text)))


TOKENS = "array<struct<start:int,end:int,vec:array<float>>>"


def token_vectors(rows: DataFrame, factory: Callable[[], TokenVectors], text: str = "text", batch: int = 32) -> DataFrame:
    """``rows`` with ``tokens``: places and vectors of each text's tokens; ``batch`` texts of like length go through the model together."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", tokens {TOKENS}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            order = part[text].fillna("").str.len().argsort(kind="stable").to_numpy()
            for at in range(0, len(part), batch):
                some = part.iloc[order[at : at + batch]]
                found = model.tokens(some[text].fillna("").tolist())
                yield some.assign(tokens=[[{"start": s, "end": e, "vec": np.asarray(v, np.float32)} for s, e, v in t] for t in found])

    return rows.mapInPandas(run, schema)


def sentence_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` (tokens) with vec: the mean over all tokens, specials included."""
    return rows.withColumn("vec", pooled(F.transform("tokens", lambda t: t["vec"])))


def _fenced(rows: DataFrame) -> DataFrame:
    """``rows`` behind a generator of one row each, so that a search isn't computed anew wherever what follows refers to it."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def phrase_vectors(rows: DataFrame, text: str = "text", phrase: str = "term", lemmas: str | None = None) -> DataFrame:
    """``rows`` (tokens) with the phrase's span and tokens and vec: their mean, or that of all but the first and last token.

    ``span_by`` tells how the phrase was found: by ``lemma``, if that covers a token, else by ``exact`` characters.
    """
    rows = _fenced(rows.withColumn("span", exact_span(F.col(text), keywords(F.col(phrase)))).withColumn("span_by", F.lit("exact")))
    if lemmas is not None:
        rows = _fenced(rows.withColumn("_lemma", lemma_span(F.col(lemmas), keywords(F.col(phrase)))))
        rows = _fenced(rows.withColumn("_found", F.size(covered_tokens(F.col("tokens"), F.col("_lemma"))) > 0))
        rows = rows.withColumns({"span": F.when(F.col("_found"), F.col("_lemma")).otherwise(F.col("span")), "span_by": F.when(F.col("_found"), "lemma").otherwise("exact")}).drop("_lemma", "_found")
    rows = _fenced(rows.withColumn("at", covered_tokens(F.col("tokens"), F.col("span"))))
    rows = rows.withColumn("span_by", F.when(F.size("at") > 0, F.col("span_by")))
    chosen = F.transform("at", lambda i: F.get("tokens", i)["vec"])
    inner = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0))), lambda t: t["vec"])
    vec = pooled(F.when(F.size("at") > 0, chosen).otherwise(inner))
    return rows.withColumns({"vec": vec, "n_tokens": F.size("at")})


LEMMAS = "array<struct<lemma:string,orig:string,cs:int,ce:int>>"


def _lemmas(words: list[tuple[str, str, str, int, int]], kept: set[str] | None) -> list[dict]:
    lowered = ((lemma.lower(), w.lower(), s, e) for w, _, lemma, s, e in words)
    return [{"lemma": lemma, "orig": w, "cs": s, "ce": e} for lemma, w, s, e in lowered if kept is None or lemma in kept or w in kept]


def lemma_tokens(rows: DataFrame, factory: Callable[[], Analyzer], text: str = "text", among: str | None = None) -> DataFrame:
    """``rows`` with ``lemmas``: lemma, lowered form and place of each word, or only of those that are, by lemma or form, in the array ``among``.

    The latter, with a phrase's keywords, give the same ``lemma_span`` as all.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", lemmas {LEMMAS}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyzer = factory()
        for part in (whole.iloc[at : at + 64] for whole in parts for at in range(0, len(whole), 64)):  # tokens of whole texts take memory
            found = analyzer.analyze(part[text].fillna("").tolist())
            kept = [None] * len(part) if among is None else [set() if x is None else set(x) for x in part[among]]
            yield part.assign(lemmas=[_lemmas(t, k) for t, k in zip(found, kept, strict=True)])

    return rows.mapInPandas(run, schema)


def content_words(essays: DataFrame, factory: Callable[[], Analyzer]) -> DataFrame:
    """essay_id, word, lemma of the nouns, verbs, adjectives and adverbs of each essay's lowered paragraphs."""
    paragraphs = essays.select("essay_id", F.explode("paragraphs").alias("text")).withColumn("text", F.lower("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyzer = factory()
        for part in parts:
            found = analyzer.analyze(part["text"].fillna("").tolist())
            rows = [(k, w, lemma, tag) for k, t in zip(part["essay_id"], found, strict=True) for w, tag, lemma, _, _ in t]
            yield pd.DataFrame(rows, columns=["essay_id", "word", "lemma", "tag"])

    tagged = paragraphs.mapInPandas(run, "essay_id string, word string, lemma string, tag string")
    return tagged.where(pos_class(F.col("tag")).isNotNull()).drop("tag")
