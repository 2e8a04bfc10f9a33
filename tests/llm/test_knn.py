import random
import zlib

import numpy as np

from verbascope.llm import knn


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    good = np.array(labels) == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = knn.op8_quality_votes(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held, strict=True)) > 0.97


def test_votes_against_brute_force():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((500, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 500).astype(float)
    space = knn.Space(np.zeros((knn.COLUMNS, 8), np.float32), vectors, labels, 0.5)
    queries = rng.standard_normal((600, 8)).astype(np.float32)
    got = space.scores(queries)
    for q, s in zip(queries, got, strict=True):
        close = vectors @ q
        close = close.round(knn.PLACES)
        best = np.flatnonzero(close >= np.sort(close)[-knn.NEIGHBOURS])
        weight = np.maximum(close[best], 0)
        assert abs(s - (weight @ labels[best]) / weight.sum()) < 1e-5


def test_ties_vote_together():
    """Of 100 equal vectors a quarter is labelled 1, wherever those stand."""
    vectors = np.tile(np.array([[0.6, 0.8]], np.float32), (100, 1))
    for labels in (np.arange(100) < 25, np.arange(100) >= 75, np.arange(100) % 4 == 0):
        space = knn.Space(np.zeros((knn.COLUMNS, 2), np.float32), vectors, labels.astype(float), 0.5)
        assert abs(space.scores(np.array([[1.0, 0.0]], np.float32))[0] - 0.25) < 1e-6


def test_fit_is_bounded_by_ids(spark):
    docs, labels = frames(spark)
    many = docs.unionAll(docs).unionAll(docs).unionAll(docs.selectExpr("doc_id", "concat(text, ' more')", "source", "score", "label"))
    space = knn.fit(many, labels.unionAll(labels.selectExpr("doc_id", "1 - quality", "toxic")), sample=20)
    assert len(space.labels) <= 20 and space.labels.sum() == 0


def test_fitted_vectors_against_numpy():
    """The space spans what an exact decomposition finds, and vectors are weights times inverse document frequencies, projected."""
    rng, terms = random.Random(5), knn.Terms()
    rows = [terms.counts(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30))) for _ in range(40)]
    space = knn.fitted(rows, [i % 2 for i in range(40)])
    seen = np.zeros(knn.COLUMNS)
    dense = np.zeros((40, knn.COLUMNS))
    for i, (columns, weights) in enumerate(rows):
        seen[columns] += 1
        dense[i, columns] = weights
    weighted = dense * (np.log(41 / (1 + seen)) + 1)
    lengths = np.linalg.norm(weighted, axis=1, keepdims=True)
    _, _, right = np.linalg.svd(weighted / lengths, full_matrices=False)
    expected = weighted @ right[: space.vectors.shape[1]].T
    expected /= np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose(space.vectors @ space.vectors.T, expected @ expected.T, atol=1e-3)


def test_space_of_few():
    terms = knn.Terms()
    for n in (1, 2, 3):
        space = knn.fitted([terms.counts(f"word{i} other") for i in range(n)], [1] * n)
        assert np.allclose(knn.Scorer(space)(["word0 other", "", None]), 1, atol=1e-6)
    assert knn.Scorer(knn.fitted([], []))(["a", None]).tolist() == [0.5, 0.5]
    # only empty texts to learn from
    assert knn.Scorer(knn.fitted([terms.counts("")] * 3, [0, 1, 1]))(["a b"]).tolist() == [round(2 / 3, 9)]


def frames(spark):
    rng = random.Random(2)
    good = lambda: " ".join(f"{rng.choice('abcdef')}{rng.choice('xyz')}ord" for _ in range(60))
    bad = lambda: " ".join(f"{rng.choice('ABC')}!!" for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(90)] + [(200, None), (201, ""), (None, good()), (202, "B!! " * 40000), (202, "B!! " * 40000)]
    docs = spark.createDataFrame([(*r, "s", 0.1, 4) for r in rows], "doc_id long, text string, source string, score double, label int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)] + [(200, 1, 0), (5, None, 0), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_edges(spark):
    docs, labels = frames(spark)
    space = knn.fit(docs, labels)
    rows = knn.score(docs, space).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 95 and all(by[i]["predicted"] == i % 2 for i in range(90)) and by[None]["predicted"] == 1 and by[202]["predicted"] == 0
    assert by[200]["score"] == by[201]["score"] == round(space.mean, 9)
    kept = knn.good(docs, space)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(90) if i % 2}
    assert 202 not in {r["doc_id"] for r in kept.collect()}
    assert knn.score(docs.limit(0), space).collect() == [] and knn.good(docs.limit(0), space).collect() == []
    nothing = knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in knn.score(docs, nothing).collect()} == {0.5} and knn.good(docs, nothing).count() == docs.count()
    assert len(knn.fit(docs, labels, sample=10).labels) <= 10


def test_only_the_text_counts(spark):
    docs, labels = frames(spark)
    space = knn.fit(docs, labels)
    again = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'other' AS source", "score", "label")
    scores = lambda df: sorted(r["score"] for r in knn.score(df, space).collect())
    assert scores(docs) == scores(again)
