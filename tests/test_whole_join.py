from verbascope.plans import catalog


def test_regression_takes_all_joined_rows(spark, small):
    overall = next(r for r in catalog.hier_f_test(spark, small).collect() if r["grp"] == "overall")
    assert 0 < overall["n"] == len({r["essay_id"] for r in catalog.word_phrase_join(spark, small).collect() if r["PH_mean_score"] is not None})


def test_the_join_grows_with_the_tables(spark, small):
    few, more = (catalog.word_phrase_join(spark, d).count() for d in (small, small.replace("0.001", "0.01")))
    assert more > 3 * few


def test_words_of_any_length_have_levels(spark, small):
    """Nearly all words have an entry, by lemma or word, but those of the letters that are left out."""
    rows = catalog.word_indices(spark, small).agg({"W_n": "sum"}).first()[0]
    words = spark.read.parquet(f"{small}/documents.parquet").selectExpr("explode(regexp_extract_all(lower(text), '[\\\\p{L}]+', 0)) AS w").where("ascii(w) % 9 <> 0 AND ascii(w) % 8 BETWEEN 1 AND 6").count()
    assert rows >= words * 0.9
