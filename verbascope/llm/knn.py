"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms of a text are its words, their shapes (runs of letters, capitals, digits
and signs), pairs of shapes, and whether a word repeats the one before; all
are hashed to a fixed number of columns. Log counts times inverse document
frequency are projected on the leading singular vectors of a bounded sample of
labelled documents. That sample's vectors and labels, bounded by ``SAMPLE``,
are broadcast; every document is compared with all of them by blocked exact
cosine products, and its ``NEIGHBOURS`` nearest vote with their similarity.

Defined cases: a text without terms, null or empty, has no neighbours and gets
the sample's mean label; without any label, or with an empty table, there is
nothing to learn and all scores are 0.5. Rows of the sample that are as near as
the last of the nearest, to ``PLACES`` places, vote as well, so the order of
the sample doesn't matter and equal texts score alike. An id with several
labels has the least, one with several texts that of the least digest. Texts of
any length are read whole. ``score`` returns columns of its own only and
``good`` those of its documents, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import folded, give_up, over_batches, small_batches, table

#: Labelled documents that the space and the votes come from, at most.
SAMPLE = 3000
WORD_COLUMNS, SHAPE_COLUMNS, RANK, NEIGHBOURS = 4096, 1024, 48, 25
#: Similarities that are equal to so many places tie.
PLACES = 5
#: Texts compared with the sample in one product.
BLOCK = 256
#: A worker forgets the columns of words beyond so many.
MEMORY = 200_000

SHAPES = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def shape(word: str) -> str:
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


class Terms(dict):
    """Columns of a word and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = value = (xxhash.xxh32_intdigest(word.lower()) % WORD_COLUMNS, xxhash.xxh32_intdigest(shape(word)) % SHAPE_COLUMNS)
        return value

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The columns of a text in order, and the log of their counts."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        pairs = np.array(list(map(self.__getitem__, words)), np.int64)
        own, shapes = pairs[:, 0], pairs[:, 1]
        again = np.flatnonzero((own[1:] == own[:-1]) & (shapes[1:] == shapes[:-1]))
        both = WORD_COLUMNS + SHAPE_COLUMNS + (shapes[:-1] * 31 + shapes[1:] * 17) % SHAPE_COLUMNS
        columns = np.concatenate([own, WORD_COLUMNS + shapes, both, np.full(len(again), COLUMNS - 1)])
        counts = np.bincount(columns, minlength=COLUMNS)
        found = np.flatnonzero(counts)
        return found.astype(np.int32), np.log1p(counts[found]).astype(np.float32)


COLUMNS = WORD_COLUMNS + 2 * SHAPE_COLUMNS + 1


@dataclass
class Space:
    """What is broadcast: its size is bounded by the constants above."""

    project: np.ndarray  # columns x rank, with the inverse document frequencies
    vectors: np.ndarray  # of the sample, of length 1
    labels: np.ndarray
    mean: float

    def vector(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of length 1, or zeros."""
        v = weights @ self.project[columns]
        length = np.sqrt(v @ v)
        return v / length if length > 0 else v

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.mean)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(vectors), BLOCK):
            close = (vectors[at : at + BLOCK] @ self.vectors.T).round(PLACES)
            least = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k]
            votes = np.where(close >= least, np.maximum(close, 0), 0)
            total = votes.sum(axis=1)
            some = total > 0
            out[at : at + BLOCK][some] = (votes @ self.labels)[some] / total[some]
        return np.clip(out, 0, 1)


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Space:
    """The space of a sample: leading singular vectors by a randomized range finder with power steps."""
    if not rows:
        return Space(np.zeros((COLUMNS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    seen = np.zeros(COLUMNS)
    for columns, _ in rows:
        seen[columns] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    dense = np.zeros((len(rows), COLUMNS), np.float32)
    for i, (columns, weights) in enumerate(rows):
        dense[i, columns] = weights * idf[columns]
        dense[i] /= max(np.linalg.norm(dense[i]), 1e-12)
    rank = min(RANK, len(rows), COLUMNS)
    basis = dense @ np.random.default_rng(0).standard_normal((COLUMNS, min(rank + 16, len(rows)))).astype(np.float32)
    for _ in range(3):
        basis = dense @ (dense.T @ np.linalg.qr(basis)[0])
    _, _, right = np.linalg.svd(np.linalg.qr(basis)[0].T @ dense, full_matrices=False)
    project = (right[:rank].T * idf[:, None]).astype(np.float32)
    space = Space(project, np.zeros((0, rank), np.float32), np.array(labels, float), float(np.mean(labels)))
    space.vectors = np.array([space.vector(*row) for row in rows], np.float32)
    return space


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """The space of at most ``sample`` labelled documents outside the held-out fold, the first by a hash of their id."""
    chosen = labels.where("quality IS NOT NULL").where(folded("doc_id", 3) != 1)
    chosen = chosen.groupBy(labels.doc_id.cast("long").alias("labelled")).agg(F.min(F.when(labels.quality > 0, 1).otherwise(0)).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    known = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # one row for each id that was chosen, however often it occurs: no more than ``sample`` reach the driver
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))

    def make():
        terms = Terms()

        def step(batch: pa.RecordBatch) -> dict:
            found = [terms.counts(x) for x in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "label": batch["label"], "columns": [c for c, _ in found], "weights": [w for _, w in found]}

        return step

    got = over_batches(known, "doc_id long, label int, columns array<int>, weights array<float>", make)
    rows = sorted(((r["doc_id"], r["label"], r["columns"], r["weights"]) for r in got.toArrow().to_pylist()), key=lambda r: (r[0], r[1]))
    return fitted([(np.array(c, np.int32), np.array(w, np.float32)) for _, _, c, w in rows], [x[1] for x in rows])


class Scorer:
    """Scores of texts; one for each task."""

    def __init__(self, space: Space):
        self.space, self.terms = space, Terms()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        vectors = [self.space.vector(*self.terms.counts(x)) for x in texts]
        return self.space.scores(np.array(vectors, np.float32).reshape(len(texts), -1)).round(9)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        scorer = Scorer(shipped.value)

        def step(batch: pa.RecordBatch) -> dict:
            got = scorer(batch["text"].to_pylist())
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": got, "predicted": (got >= 0.5).astype(np.int32)}

        return step

    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), (folded(docs.doc_id, 3) == 1).alias("held_out"), "text")
    return over_batches(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def good(docs: DataFrame, space: Space) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(space)
    small_batches(docs.sparkSession)

    def run(batches):
        give_up()
        scorer = Scorer(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch["text"].to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
