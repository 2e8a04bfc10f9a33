"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered; what isn't a letter becomes a gap. N-grams of one to
``LONGEST`` characters that begin with a letter or end in one are hashed to
``BINS`` columns. Counts by language come from a sample of the labelled
documents outside the held-out fold, about ``SAMPLE`` of each language. The
matrix of log-probabilities has a row for each bin and a column for each
language; it is broadcast, after a check that it has at most ``MATRIX_BYTES``,
which a thousand languages have. A batch is scored by one sparse product: the
n-grams of its texts, each a unit entry of a row, times that matrix, in blocks
of ``BLOCK`` entries; long texts are split over blocks and summed.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so are all texts if nothing can be learned, as from an empty table. Ties go to
the first language in order. Equal texts score alike, repeated rows included;
texts of any length are read whole. Null languages aren't learned from. Columns
other than doc_id, text and lang aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import Shelf, folded, over_batches, table

BINS, LONGEST = 1 << 15, 3
#: Documents learned from for each language, about.
SAMPLE = 2000
#: Bytes of the matrix that is broadcast, at most.
MATRIX_BYTES = 256 << 20
#: Numbers that a block of a product has, about.
BLOCK = 1 << 21
#: Added to each count.
SMOOTHING = 0.5
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    return _letters[0]


def bins(text: str) -> np.ndarray:
    """The hashed n-grams of a text in no particular order; none without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()
    low = points < len(known)
    is_letter = known[np.where(low, points, 0)] & low
    for point in np.unique(points[~low]):
        if chr(point).isalpha():
            is_letter |= points == point
    if not is_letter.any():
        return np.zeros(0, np.int64)
    # gaps of any length count as one
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    held = np.concatenate([[0], np.where(is_letter, points, 0)[keep], [0]]).astype(np.uint64)
    some = held != 0
    out, code = [], np.zeros(len(held), np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(held) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(0x110001) + held[n - 1 :]
        hashed = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS.bit_length() + 1)
        out.append(hashed[some[:size] | some[n - 1 :]])
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # bins x languages
    prior: np.ndarray

    def totals(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sums of the log-probabilities of each text's bins: the batch as a sparse matrix, an entry a bin, times ``log``."""
        out = np.zeros((len(texts), len(self.languages)))
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        columns = np.concatenate([np.zeros(0, np.int64), *texts])
        step = max(1, BLOCK // max(1, len(self.languages)))
        for at in range(0, len(rows), step):
            held = rows[at : at + step]
            starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            out[held[starts]] += np.add.reduceat(self.log[columns[at : at + step]], starts, axis=0)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its probability among those learned."""
        found = [bins(x) if x else np.zeros(0, np.int64) for x in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        total = self.prior + self.totals(found)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        for i, x in enumerate(found):
            if len(x):
                names[i], scores[i] = self.languages[best[i]], round(float(share[i]), 9)
        return names, scores


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(folded("doc_id", 4) != 2)
    known = known.select(docs.lang.cast("string").alias("lang"), docs.doc_id, docs.text)
    with Shelf(docs.sparkSession, "langid") as shelf:
        frequent = shelf.put(known.groupBy("lang").count(), "languages")
        if frequent.count() * BINS * 8 > MATRIX_BYTES:
            raise ValueError(f"the matrix of {frequent.count()} languages has more than {MATRIX_BYTES} bytes")
        rows = {r["lang"]: r["count"] for r in frequent.collect()}
        languages = sorted(rows)
        place = {x: i for i, x in enumerate(languages)}
        # a share of each language, by a hash of the id: no task ranks a language's rows
        chance = (F.xxhash64("doc_id", F.lit("learn")).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
        chosen = known.join(F.broadcast(frequent), "lang").where(chance < F.lit(float(sample)) / F.col("count")).select("lang", "text")

        def make():
            def step(batch: pa.RecordBatch) -> dict:
                codes = np.fromiter(map(place.__getitem__, batch["lang"].to_pylist()), np.int64, len(batch))
                found = [bins(x) for x in batch["text"].to_pylist()]
                at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[x + c * BINS for x, c in zip(found, codes.tolist(), strict=True)]]), return_counts=True)
                return {"lang": pa.array(at // BINS, pa.int32()), "bin": pa.array(at % BINS, pa.int32()), "n": n}

            return step

        # at most a row for each number of the matrix reaches the driver, as Arrow columns
        counted = over_batches(chosen, "lang int, bin int, n long", make).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BINS, len(languages)))
    counts[counted["bin"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    # a language of which the sample has no n-gram isn't learned
    learned = np.flatnonzero(counts.sum(axis=0) > 0)
    counts, languages = counts[:, learned], [languages[i] for i in learned]
    log = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BINS)
    prior = np.log(np.array([rows[x] for x in languages], float) / max(1, sum(rows.values())))
    return Model(languages, log, prior)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``; only the text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            names, scores = shipped.value(batch["text"].to_pylist())
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores}

        return step

    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), (folded(docs.doc_id, 4) == 2).alias("held_out"), "text")
    return over_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
