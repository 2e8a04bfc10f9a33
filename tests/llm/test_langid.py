import random
import zlib

import numpy as np

from verbascope.llm import langid


def test_bins():
    assert len(langid.bins("123 !?")) == 0 and len(langid.bins("")) == 0
    # a letter: itself, and with a gap before and after
    assert len(langid.bins("a")) == 3 and sorted(langid.bins("A  1b")) == sorted(langid.bins("a b"))
    assert len(langid.bins("𝒜")) == 3 and len(langid.bins("日本")) > 0
    assert langid.bins("word " * 100).max() < langid.BINS


def test_scores_against_the_formula():
    rng = np.random.default_rng(0)
    log = np.log(rng.dirichlet(np.ones(langid.BINS), 3)).T
    model = langid.Model(["a", "b", "c"], log, np.log([0.5, 0.3, 0.2]))
    texts = ["hello there", "x", None, "", "12 !", "long text " * 500]
    names, scores = model(texts)
    for i in (0, 1, 5):
        total = model.prior + sum(log[b] for b in langid.bins(texts[i]))
        posterior = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert names[i] == model.languages[posterior.argmax()] and abs(scores[i] - posterior.max()) < 1e-8
    assert names[2:5] == ["und"] * 3 and scores[2:5].tolist() == [0, 0, 0]
    assert model([])[0] == [] and len(model([])[1]) == 0


def test_blocks_of_a_product(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BINS, 3)), np.zeros(3))
    texts = [rng.integers(0, langid.BINS, n) for n in (0, 5, 1, 0, 200, 3)]
    whole = model.totals(texts)
    assert np.allclose(whole, [model.log[x].sum(axis=0) for x in texts])
    monkeypatch.setattr(langid, "BLOCK", 21)
    assert np.allclose(model.totals(texts), whole)


def test_ties_go_to_the_first_language():
    model = langid.Model(["a", "b"], np.full((langid.BINS, 2), -3.0), np.log([0.5, 0.5]))
    names, scores = model(["some words", "x"])
    assert names == ["a", "a"] and scores.tolist() == [0.5, 0.5]


def test_fit_against_brute_force(spark, small):
    """Counts, smoothing and priors, recomputed by loops over the texts that may be learned from."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, sample=10**9)
    grams, rows = {}, {}
    for d in docs.collect():
        if d["lang"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            rows[d["lang"]] = rows.get(d["lang"], 0) + 1
            counts = grams.setdefault(d["lang"], {})
            for b in langid.bins(d["text"]).tolist():
                counts[b] = counts.get(b, 0) + 1
    assert model.languages == sorted(grams)
    for i, lang in enumerate(model.languages):
        total = sum(grams[lang].values()) + 0.5 * langid.BINS
        expected = np.log([(grams[lang].get(b, 0) + 0.5) / total for b in range(langid.BINS)])
        assert np.allclose(model.log[:, i], expected) and abs(model.prior[i] - np.log(rows[lang] / sum(rows.values()))) < 1e-12


def test_rare_languages_are_learned(spark):
    many = documents(spark, [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(300)])
    model = langid.fit(many, sample=10**9)
    learned = {f"l{i:03}" for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == learned
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(many, model).collect()}
    assert sum(got[int(x[1:])] == x for x in learned) > 0.95 * len(learned)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op2_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97


def documents(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", 0.5) for r in rows], "doc_id long, text string, lang string, source string, bin string, score double")


def test_edges(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(("haus", "und", "der") if i % 2 else ("the", "and", "house")) for _ in range(20)), "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "42 %", "de"), (None, "the house", None), (103, "der " * 30000, None), (103, "der " * 30000, None)]
    docs = documents(spark, rows + odd)
    got = langid.identify(docs, langid.fit(docs)).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 66 and [by[k] for k in (100, 101, 102, None, 103)] == ["und", "und", "und", "en", "de"]
    for some in (docs.limit(0), docs.where("lang IS NULL")):
        model = langid.fit(some)
        assert model.languages == [] and {r["lang_pred"] for r in langid.identify(some, model).collect()} <= {"und"}
    assert langid.fit(docs, sample=1).languages is not None
