"""Index families of phrases and of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.functions.levels import BANDS, LEVELS, count_levels, is_level, level_score
from verbascope.functions.text import as_text, script_id
from verbascope.operators.ordering import last_value, last_wins

# The marks that hits carry, and the order of the indices.
POLYSEMOUS, PHRASAL_VERB = "是", "phrasal verb"
PHRASE_INDICES = (
    "PH_ratio_A1", "PH_ratio_A2", "PH_ratio_B1", "PH_ratio_B2", "PH_ratio_C1", "PH_ratio_C2",
    "PH_ratio_A", "PH_ratio_B", "PH_ratio_C", "PH_ratio_AboveB1", "PH_ratio_AboveB2",
    "PH_mean_score", "PH_high_low_ratio", "PH_score_var", "PH_pv_ratio", "PH_multi_ratio",
)
PHRASE_COLUMNS = ("essay_id", "total_score", "n_phrases", "PH_level_coverage", *PHRASE_INDICES)
WORD_COLUMNS = ("W_ratio_A1", "W_ratio_A", "W_ratio_B", "W_ratio_C", "W_ratio_AboveB1", "W_mean_score", "W_n")
LEAST_WORDS = 5


def sense_levels(inventory: DataFrame) -> DataFrame:
    """term, sense_no, level of the inventory rows with a key; of rows with the same key the last holds."""
    keyed = inventory.select("row_no", *[F.coalesce(as_text(F.col(c)), F.lit("")).alias(c) for c in ("term", "sense_no", "level")])
    return last_wins(keyed.where("term <> '' AND sense_no <> ''"), ["term", "sense_no"]).drop("row_no")


def resolved(hits: DataFrame, levels: DataFrame) -> DataFrame:
    """``hits`` with ``multi``, and ``level`` where it is a valid one.

    A polysemous phrase takes the level of its sense, others their own. The
    join is left to the planner: it broadcasts an inventory that is small and
    splits hot keys of one that isn't.
    """
    multi = F.coalesce(as_text(F.col("is_poly")) == POLYSEMOUS, F.lit(False))
    keyed = hits.withColumns({"multi": multi, "_term": as_text(F.col("phrase")), "_sense": F.when(multi, as_text(F.col("sense")))})
    senses = levels.select(F.col("term").alias("_term"), F.col("sense_no").alias("_sense"), F.col("level").alias("_level"))
    joined = keyed.join(senses, ["_term", "_sense"], "left")
    level = F.when(F.col("multi"), F.col("_level")).otherwise(as_text(F.col("cefr")))
    return joined.withColumn("level", F.when(is_level(level), level)).drop("_term", "_sense", "_level")


def unresolved(hits: DataFrame) -> DataFrame:
    """n_poly_no_level: polysemous hits without a valid level, over all rows, also those of groups that are dropped."""
    return hits.agg(F.count_if(F.col("multi") & F.col("level").isNull()).alias("n_poly_no_level"))


def level_ratios(prefix: str, names: tuple[str, ...], total: Column, times: Column | None = None) -> dict[str, Column]:
    groups = {level: (level,) for level in LEVELS} | BANDS
    return {f"{prefix}_ratio_{n}": count_levels(F.col("level"), groups[n], times) / total for n in names}


#: The groups that have indices: a valid level, and a positive score.
COUNTED = "_n > 0 AND total_score > 0"


def phrase_indices(hits: DataFrame, unit: str = "answer") -> DataFrame:
    """One row for each answer, or each script, that has a valid level and a positive score; ``hits`` as ``resolved``."""
    return phrase_groups(hits, unit).where(COUNTED).select(*PHRASE_COLUMNS)


def phrase_groups(hits: DataFrame, unit: str = "answer") -> DataFrame:
    """The indices of every answer, or script, with ``_n``, its hits with a level.

    Level indices are shares of the hits with a level, properties of phrases
    shares of all hits. Counts and sums are whole numbers and are divided
    last, so results don't depend on the order of rows.
    """
    key = F.col("essay_id").cast("string") if unit == "answer" else script_id(F.col("essay_id"))
    rows = hits.withColumns({"essay_id": key, "_s": level_score(F.col("level"))})
    n, s, ss = F.count("_s"), F.sum("_s"), F.sum(F.col("_s") * F.col("_s"))
    low, high = count_levels(F.col("level"), BANDS["A"]), count_levels(F.col("level"), BANDS["AboveB1"])
    some = F.nullif(n, F.lit(0))
    measures = level_ratios("PH", (*LEVELS, *BANDS), some) | {
        "PH_mean_score": s / some,
        "PH_high_low_ratio": F.when(low > 0, high / low),
        "PH_score_var": (n * ss - s * s) / (some * some),
        "PH_pv_ratio": F.count_if(as_text(F.col("pos")) == PHRASAL_VERB) / F.count("*"),
        "PH_multi_ratio": F.count_if("multi") / F.count("*"),
        "PH_level_coverage": n / F.count("*"),
        "n_phrases": F.count("*"),
        "total_score": last_value("total_score").cast("double"),
        "_n": n,
    }
    return rows.groupBy("essay_id").agg(*[c.alias(k) for k, c in measures.items()]).select(*PHRASE_COLUMNS, "_n")


def _looked_up(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``tokens`` (lemma, word, ...) with ``level``: the lemma's entry if there is one, else the word's, else null."""
    entries = dictionary.where("word IS NOT NULL AND word <> ''").groupBy("word").agg(F.max("min_level").alias("min_level"))
    by_lemma = entries.select(F.col("word").alias("lemma"), F.lit(True).alias("_has"), F.col("min_level").alias("_lemma"))
    by_word = entries.select("word", F.col("min_level").alias("_word"))
    joined = tokens.join(by_lemma, "lemma", "left").join(by_word, "word", "left")
    level = F.when(F.col("_has"), F.col("_lemma")).otherwise(F.col("_word"))
    return joined.withColumn("level", level).drop("_has", "_lemma", "_word")


def dictionary_levels(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``tokens`` (lemma, word, ...) with ``level``: the lemma's entry if there is one, else the word's; only valid levels stay."""
    return _looked_up(tokens, dictionary).where(is_level(F.col("level")))


#: A word is common if it is at least one in so many of all words; so there are at most as many common words, whatever the input.
COMMON = 1 << 20


def counted_levels(tokens: DataFrame, dictionary: DataFrame, key: str = "essay_id") -> DataFrame:
    """``key``, level, n: the words of ``tokens`` (key, lemma, word) with a valid level, ``n`` of 1 each.

    Each pair of lemma and word is looked up once. The levels of common ones,
    nine words in ten of a text, are broadcast; the other words are shuffled to
    theirs, and none of them is so frequent that it makes a task large.
    """
    tokens = tokens.where("lemma IS NOT NULL AND word IS NOT NULL")  # as the joins do, so that the pairs are counted once for all that follows
    pairs = tokens.groupBy("lemma", "word").agg(F.count("*").alias("_n"))
    total = pairs.agg(F.sum("_n").alias("_total"))
    found = _looked_up(pairs, dictionary).join(F.broadcast(total)).withColumn("_common", F.col("_n") * COMMON >= F.col("_total")).select("lemma", "word", "level", "_common")
    met = tokens.join(F.broadcast(found.where("_common")), ["lemma", "word"], "left")
    often = met.where(F.col("_common") & is_level(F.col("level"))).select(key, "level")
    levels = found.where(~F.col("_common") & is_level(F.col("level"))).drop("_common")
    seldom = met.where("_common IS NULL").select(key, "lemma", "word").join(levels, ["lemma", "word"]).select(key, "level")
    return often.union(seldom).withColumn("n", F.lit(1).cast("long"))


def word_indices(levelled: DataFrame, key: str = "essay_id") -> DataFrame:
    """One row for each essay of at least ``LEAST_WORDS`` content words with a level; rows with ``n`` count that often."""
    times = F.col("n") if "n" in levelled.columns else F.lit(1).cast("long")
    rows = levelled.withColumn("_s", level_score(F.col("level")))
    n = F.sum(F.when(F.col("_s").isNotNull(), times).otherwise(0))
    some = F.nullif(n, F.lit(0))
    ratios = level_ratios("W", ("A1", "A", "B", "C", "AboveB1"), some, times)
    measures = ratios | {"W_mean_score": F.sum(F.col("_s") * times) / some, "W_n": n}
    return rows.groupBy(key).agg(*[c.alias(k) for k, c in measures.items()]).where(F.col("W_n") >= LEAST_WORDS)


def scored(word_rows: DataFrame, essays: DataFrame) -> DataFrame:
    """Word indices joined to the essays' scores; missing and zero scores are left out."""
    return word_rows.join(essays.where("total_score IS NOT NULL AND total_score <> 0").select("essay_id", "total_score"), "essay_id")


def joined_indices(word_rows: DataFrame, phrase_rows: DataFrame) -> DataFrame:
    """Word and phrase indices of the essays that have both and a positive score."""
    return word_rows.where("total_score > 0").join(phrase_rows.drop("total_score", "n_phrases"), "essay_id")
