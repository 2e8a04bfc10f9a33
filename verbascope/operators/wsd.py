"""Word-sense disambiguation by similarity, its evaluation and its ablation.

Anchors of senses and vectors of targets are each made once; targets and the
senses of their phrase meet in an equi join on the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.functions.text import clean, examples, keywords, number_order, sense_text, terms
from verbascope.functions.vectors import cosine, first_best, rounded
from verbascope.operators.ordering import first_wins

TIE = 1e-4


def sense_inventory(rows: DataFrame) -> DataFrame:
    """``rows`` without repeats of (term, sense_no), of which the first holds, with the cleaned learner example."""
    return first_wins(rows, ["term", "sense_no"]).withColumn("clean_learner", clean(F.col("learner_example")))


def evaluable(inventory: DataFrame) -> DataFrame:
    """The senses of phrases that have two or more, each with a learner example; with n_senses."""
    good = inventory.groupBy("term").agg(F.count("*").alias("n_senses"), F.bool_and(F.col("clean_learner") != "").alias("all_said"))
    return inventory.join(good.where("n_senses >= 2 AND all_said").drop("all_said"), "term")


def senses_in_order(inventory: DataFrame) -> DataFrame:
    """term, senses: an array of a phrase's senses by number."""
    ordered = F.array_sort(F.collect_list(F.struct(number_order(F.col("sense_no")).alias("_order"), "sense_no", "definition")))
    return inventory.groupBy("term").agg(F.transform(ordered, lambda s: F.struct(s["sense_no"].alias("sense_no"), s["definition"].alias("definition"))).alias("senses"))


def pairs(senses: DataFrame) -> DataFrame:
    """Each target (term, gold_no) with each sense (sense_no) of its phrase."""
    targets = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("target"))
    return targets.join(senses.select("term", "sense_no", "n_senses"), "term")


def tfidf_similarities(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """term, gold_no, sense_no, sim.

    ``texts`` (term, sense_no, text) and ``targets`` (term, gold_no, target).
    Each target is weighed in a corpus of its own, its phrase's senses and
    itself: a term's document frequency there is that among the senses, counted
    once for each phrase, and one more if the target has it. So a sense's
    length is summed once a phrase, and corrected for each target by the words
    that both have; targets meet only those words' senses.
    """
    sizes = texts.groupBy("term").agg(F.count("*").alias("n_senses"))
    held = texts.select("term", "sense_no", F.explode(terms(F.col("text"))).alias("w")).groupBy("term", "sense_no", "w").agg(F.count("*").alias("tf"))
    among = held.groupBy("term", "w").agg(F.count("*").alias("df"), F.collect_list(F.struct("sense_no", "tf")).alias("having"))
    said = targets.select("term", "gold_no", F.explode(terms(F.col("target"))).alias("w")).groupBy("term", "gold_no", "w").agg(F.count("*").alias("ttf"))

    def squared(df: Column) -> Column:
        """The square of the inverse document frequency, smoothed."""
        i = F.log((F.col("n_senses") + 2) / (df + 1)) + 1
        return i * i

    df = F.coalesce("df", F.lit(0))
    weighed = among.join(sizes, "term").withColumns({"without": squared(df), "with": squared(df + 1)})
    lengths = weighed.select("term", "without", F.inline("having")).groupBy("term", "sense_no").agg(F.sum(F.col("tf") * F.col("tf") * F.col("without")).alias("ss"))
    own = said.join(weighed.drop("n_senses"), ["term", "w"], "left").join(sizes, "term").withColumn("with", F.coalesce("with", squared(F.lit(0) + 1)))
    length = own.groupBy("term", "gold_no").agg(F.sum(F.col("ttf") * F.col("ttf") * F.col("with")).alias("tt"))
    meets = own.select("term", "gold_no", "ttf", "with", "without", F.inline("having")).groupBy("term", "gold_no", "sense_no").agg(
        F.sum(F.col("tf") * F.col("ttf") * F.col("with")).alias("dot"), F.sum(F.col("tf") * F.col("tf") * (F.col("with") - F.col("without"))).alias("more")
    )
    # texts without terms meet nothing and have similarity 0
    every = targets.select("term", "gold_no").join(texts.select("term", "sense_no").join(lengths, ["term", "sense_no"], "left"), "term")
    joined = every.join(meets, ["term", "gold_no", "sense_no"], "left").join(length, ["term", "gold_no"], "left")
    return joined.select("term", "gold_no", "sense_no", F.coalesce(F.col("dot") / F.sqrt((F.col("ss") + F.col("more")) * F.col("tt")), F.lit(0.0)).alias("sim"))


def vector_similarities(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """term, gold_no, sense_no, sim of ``anchors`` (term, sense_no, vec) and ``targets`` (term, gold_no, vec)."""
    met = targets.select("term", "gold_no", F.col("vec").alias("t")).join(anchors.select("term", "sense_no", F.col("vec").alias("s")), "term")
    return met.select("term", "gold_no", "sense_no", cosine(F.col("t"), F.col("s")).alias("sim"))


def anchors(example_vectors: DataFrame) -> DataFrame:
    """term, sense_no, vec: the mean of a sense's example vectors, place by place."""
    places = example_vectors.select("term", "sense_no", F.posexplode("vec").alias("pos", "x")).groupBy("term", "sense_no", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy("term", "sense_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vec"))


def anchor_texts(senses: DataFrame) -> DataFrame:
    """term, sense_no, ex_no, text: a sense's example sentences, or its cleaned definition if it has none."""
    said = examples(F.col("dict_example"))
    return senses.select("term", "sense_no", F.posexplode(F.when(F.size(said) > 0, said).otherwise(F.array(clean(F.col("definition"))))).alias("ex_no", "text"))


def sense_texts(senses: DataFrame, strategy: str = "def+ex") -> DataFrame:
    return senses.select("term", "sense_no", sense_text(F.col("definition"), F.col("dict_example") if strategy == "def+ex" else None).alias("text"))


def predicted(similarities: DataFrame, places: int | None = None) -> DataFrame:
    """term, gold_no, n_senses, pred_no, sims, sim_gap, is_tie, is_correct of each target.

    ``places`` rounds similarities before they are ranked; for comparisons with
    another engine's arithmetic only.
    """
    sim = F.col("sim") if places is None else rounded(F.col("sim"), places)
    rows = similarities.withColumn("sim", sim).groupBy("term", "gold_no").agg(
        F.count("*").alias("n_senses"),
        first_best(F.col("sense_no"), F.col("sim"), number_order(F.col("sense_no"))).alias("pred_no"),
        F.transform(F.array_sort(F.collect_list(F.struct(number_order(F.col("sense_no")).alias("_order"), "sim"))), lambda x: x["sim"]).alias("sims"),
    )
    ranked = F.sort_array("sims", asc=False)
    gap = F.when(F.size("sims") > 1, F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))).otherwise(1.0)
    return rows.withColumn("sim_gap", gap).withColumns({"is_tie": F.col("sim_gap") < TIE, "is_correct": F.col("pred_no") == F.col("gold_no")})


def detailed(results: DataFrame, senses: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """``results`` with the texts of the gold and predicted senses, and how targets and examples were matched, if told."""
    gold = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("target"), clean(F.col("definition")).alias("gold_def"), "level")
    pred = senses.select("term", F.col("sense_no").alias("pred_no"), clean(F.col("definition")).alias("pred_def"))
    out = results.join(gold, ["term", "gold_no"]).join(pred, ["term", "pred_no"])
    if matches is None:
        out = out.withColumns({"target_matched": F.lit(None).cast("boolean"), "sense_match_rate": F.lit(None).cast("double")})
    else:
        out = out.join(matches.select("term", "gold_no", "target_matched", "sense_match_rate"), ["term", "gold_no"], "left")
    return out.select(
        F.col("term").alias("phrase"), "n_senses", "target", "gold_no", "gold_def", "pred_no", "pred_def", "is_correct", "is_tie", "sims", "sim_gap", "level", "target_matched", "sense_match_rate"
    )


def _accuracy() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.coalesce(F.try_divide(F.count_if("is_correct"), F.count("*")), F.lit(0.0)).alias("accuracy")]


def summary(results: DataFrame) -> DataFrame:
    """total, correct, accuracy, ties: one row, also without results."""
    return results.agg(*_accuracy(), F.count_if("is_tie").alias("ties"))


def per_n(results: DataFrame) -> DataFrame:
    return results.groupBy("n_senses").agg(*_accuracy())


def ablation(results: DataFrame) -> DataFrame:
    """matched and fallback: accuracy of the targets whose phrase was and wasn't found, to four places."""
    known = results.where("target_matched IS NOT NULL").groupBy("target_matched").agg(*_accuracy())
    return known.select(F.when(F.col("target_matched"), "matched").otherwise("fallback").alias("status"), "total", "correct", F.round("accuracy", 4).alias("accuracy"))


def match_rate(results: DataFrame) -> DataFrame:
    """match_rate: targets found, of all results."""
    return results.agg(F.round(F.coalesce(F.try_divide(F.count_if("target_matched"), F.count("*")), F.lit(0.0)), 4).alias("match_rate"))


def match_log(sentences: DataFrame, has_lemmas: bool = False) -> DataFrame:
    """The record of each sentence (term, label, text, span, n_tokens, weight).

    ``match_method`` is what a run with lemmas calls all its matches;
    ``match_method_actual``, where ``span_by`` is given, tells them apart.
    ``weight`` is how often a sentence counts: an example once for each target
    of its phrase.
    """
    matched = F.col("n_tokens") > 0
    actual = [F.when(matched, F.col("span_by")).otherwise("fallback").alias("match_method_actual")] if "span_by" in sentences.columns else []
    method = F.when(matched, "lemma" if has_lemmas else "exact").otherwise("fallback")
    return sentences.select(
        F.concat_ws(" ", keywords(F.col("term"))).alias("phrase"), "label", F.substring("text", 1, 80).alias("text"),
        F.when(matched, "matched").otherwise("fallback").alias("status"), method.alias("match_method"), *actual, "n_tokens", "weight",
    )


def match_stats(log: DataFrame) -> DataFrame:
    """total, matched, fallback, match_rate overall and by label, phrase and method, in one pass."""
    weight, hit = F.sum("weight"), F.sum(F.when(F.col("status") == "matched", F.col("weight")).otherwise(0))
    label, phrase, method = F.col("label"), F.col("phrase"), F.col("match_method")
    sets = log.groupingSets([[], [label], [phrase], [method]], label, phrase, method)
    rows = sets.agg(F.grouping_id().alias("g"), weight.alias("total"), hit.alias("matched"))
    by = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "label").when(F.col("g") == 5, "phrase").otherwise("method")
    return rows.select(
        by.alias("by"), F.coalesce("label", "phrase", "match_method", F.lit("")).alias("value"), "total", "matched", (F.col("total") - F.col("matched")).alias("fallback"),
        F.round(F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)), 4).alias("match_rate"),
    ).where("total IS NOT NULL")


def by_method(stats: DataFrame) -> DataFrame:
    """value, matched of ``match_stats``: how many sentences each method matched, by its name."""
    return stats.where("by = 'method'").select("value", "matched").orderBy("value")


def sense_match_rates(log: DataFrame) -> DataFrame:
    """term, sense_match_rate: the mean over senses of the share of their sentences that matched; ``log`` has term, sense_no, matched."""
    each = log.groupBy("term", "sense_no").agg((F.count_if("matched") / F.count("*")).alias("rate"))
    return each.groupBy("term").agg(F.round(F.avg("rate"), 4).alias("sense_match_rate"))
