"""Quality rules by distribution divergence, in DataFrame functions only.

Each language's reference is what its documents hold together: how many
characters of each class, and how often its common words occur, those that
make up at least one in ``COMMON_SHARE`` of its words, at most
``COMMON_WORDS`` of them. A document's histograms are compared with its
language's by Jensen-Shannon distance (base 2, from 0 to 1). A document is
kept if it passes the base rules and neither distance is over its limit.

Guards: documents of fewer than ``LEAST_WORDS`` words fail the base rules and
aren't compared; a language of fewer than ``LEAST_REFERENCE`` words is no
reference, and its documents are kept if they pass the base rules.

Words are told apart by 64-bit hashes where they are counted in a document,
and three-word windows by a hash of those.

Defined cases: a null text has no words and fails; a null language is a
language of its own; repeated rows are judged alike. Very long texts are judged
whole. Of a language's words that are equally frequent the first by code point
rank higher; equal distances to the limit are kept. An empty table gives no
rows. Columns other than doc_id, text and lang aren't read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verbascope.llm.common import BLANK, WORD, Shelf, stored, table
from verbascope.llm.mixing import word_count

LEAST_WORDS, COMMON_WORDS, COMMON_SHARE, LEAST_REFERENCE = 50, 24, 500, 2000
CHARACTER_LIMIT, WORD_LIMIT = 0.27, 0.45
#: Languages whose references are broadcast, at most; more are joined by shuffle.
BROADCAST_LANGUAGES = 2000
#: Characters that a class leaves when all others are removed; blanks are a class, too, and what is in none.
CLASSES = (r"[^\p{Lu}]+", r"[^0-9]+", r"[^.,;:!?'\x22()-]+", r"[^#*$%&|<>]+")


def fenced(rows: DataFrame) -> DataFrame:
    """``rows`` behind a generator of one row each, which filters on computed columns aren't pushed through: they would compute them many times over."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(p: Column, q: Column, p_sum: Column, q_sum: Column) -> Column:
    """Jensen-Shannon distance of two histograms with their sums, to six places; null if one is empty."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(a: Column, b: Column) -> Column:
        x, y = a / p_sum, b / q_sum
        return part(x, (x + y) / 2) + part(y, (x + y) / 2)

    divergence = F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((p_sum > 0) & (q_sum > 0), F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6))


def common_words(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """of, reference_total, common: each language's words in all and its common words with their counts, one small row a language."""
    rows = docs.select(docs.lang.cast("string").alias("lang"), F.coalesce(docs.text, F.lit("")).alias("text"))
    said = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # the texts are read once for both the sums and the words
    said = shelf.put(said, "words")
    sums = shelf.put(said.groupBy("lang").agg(F.sum("n").alias("reference_total")).withColumnRenamed("lang", "of"), "sums")
    # at most COMMON_SHARE words of a language pass, so that ranking them is a small step
    often = said.join(small(sums), F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") * COMMON_SHARE >= F.col("reference_total"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "word"))
    ranked = often.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    found = ranked.groupBy(F.col("of").alias("lang")).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("common"))
    none = F.array().cast("array<struct<rank:int,word:string,n:bigint>>")
    return sums.join(found, F.col("of").eqNullSafe(F.col("lang")), "left").select("of", "reference_total", F.coalesce("common", none).alias("common"))


def small(table: DataFrame) -> DataFrame:
    """``table``, of one row for each language, broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_LANGUAGES else table


def measured(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The base measures of every row of ``docs``, its character classes, and how often it has the ``common_words`` of its language."""
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.lang.cast("string").alias("lang"), F.coalesce(docs.text, F.lit("")).alias("text"))
    classes = [F.length(F.regexp_replace("text", c, "")).cast("long") for c in CLASSES]
    rows = rows.select(
        "doc_id", "lang", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.length("text").cast("long").alias("n_chars"), F.array(*classes).alias("classes"),
        F.filter(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, BLANK, "") != "").alias("lines"),
    )
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.col("classes")[len(CLASSES) - 1],
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    place = F.sequence(F.lit(0), F.size("words") - 3)
    rows = rows.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(place, lambda i: F.xxhash64(F.get("hashed", i), F.get("hashed", i + 1), F.get("hashed", i + 2)))
    rows = rows.withColumn("hashes", F.when(F.size("words") >= 3, windows))
    # texts without a repeat, told by a hash set, need no sort
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("windows", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    at = lambda j: F.get("windows", j)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda j: at(j).eqNullSafe(at(j - 1)) | at(j).eqNullSafe(at(j + 1)))
    starts = F.transform(again, lambda j: F.get("windows", j)["at"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("windows").isNotNull(), covered).otherwise(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    blanks = F.col("n_chars") - F.col("word_chars")
    rows = rows.withColumns({"base_failed": failed, "characters": F.concat("classes", F.array(blanks, F.col("word_chars") - total(F.col("classes"))))})
    rows = rows.join(small(words), F.col("lang").eqNullSafe(F.col("of")), "left")
    own = F.transform("common", lambda x: (F.size("hashed") - F.size(F.array_remove("hashed", F.xxhash64(x["word"])))).cast("long"))
    rows = rows.withColumn("own", F.when(~F.col("base_failed"), own))
    return fenced(rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "characters", "own"))


def judged(docs: DataFrame) -> DataFrame:
    """The base measures, both distances and the verdict for every row of ``docs``.

    The texts are read twice: for the languages' common words, and for the
    measures, whose small table then gives the languages' character classes.
    """
    with Shelf(docs.sparkSession, "rules") as shelf:
        words = stored(common_words(docs, shelf), "rules-words")
    rows = stored(measured(docs, words), "rules-measures")
    places = range(len(CLASSES) + 2)
    sums = rows.groupBy("lang").agg(F.array(*[F.sum(F.col("characters")[i]) for i in places]).alias("reference_characters")).withColumnRenamed("lang", "reference")
    rows = rows.join(small(stored(sums, "rules-classes")), F.col("lang").eqNullSafe(F.col("reference")), "left").join(small(words), F.col("lang").eqNullSafe(F.col("of")), "left")
    fit = ~F.col("base_failed") & (F.col("reference_total") >= LEAST_REFERENCE)
    counts = F.transform("common", lambda x: x["n"])
    rows = rows.withColumns({
        "own": F.concat("own", F.array(F.col("n_words") - total(F.col("own")))), "counts": F.concat(counts, F.array(F.col("reference_total") - total(counts))),
        "own_chars": total(F.col("characters")), "reference_chars": total(F.col("reference_characters")),
    })
    rows = rows.withColumns({
        "char_distance": F.when(fit, distance(F.col("characters"), F.col("reference_characters"), F.col("own_chars"), F.col("reference_chars"))),
        "word_distance": F.when(fit, distance(F.col("own"), F.col("counts"), F.col("n_words"), F.col("reference_total"))),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > CHARACTER_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    verdict = rows.withColumn("kept", ~F.col("base_failed") & ~far)
    return fenced(verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"))


def op3_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    counts = ", ".join(f"length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in CLASSES)
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    js = "round(sqrt(greatest(sum(" + part.format(x="x", y="y") + " + " + part.format(x="y", y="x") + ") / 2, 0)), 6)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, [{counts}] AS cl, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
c AS (
  SELECT *, list_concat(cl, [length(t) - length(array_to_string(words, '')), length(array_to_string(words, '')) - list_sum(cl)]) AS characters, len(words) AS n_words FROM m),
w AS (SELECT row, pos, word FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM c)),
g AS (SELECT row, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY row ORDER BY pos)),
r AS (SELECT row, pos FROM g WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
rep AS (SELECT row, count(DISTINCT pos + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY row),
base AS (
  SELECT c.row, doc_id, lang, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(cl[{len(CLASSES)}] AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, characters
  FROM c LEFT JOIN rep ON c.row = rep.row),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
lw AS (SELECT lang, sum(n_words) AS total FROM base GROUP BY lang),
ch AS (SELECT row, lang, unnest(characters) AS n, generate_subscripts(characters, 1) AS k FROM base),
lc AS (SELECT lang, k, sum(n) AS n FROM ch GROUP BY lang, k),
lt AS (SELECT lang, sum(n) AS n FROM lc GROUP BY lang),
cd AS (
  SELECT row, {js} AS char_distance FROM (
    SELECT ch.row, CAST(ch.n AS DOUBLE) / sum(ch.n) OVER (PARTITION BY ch.row) AS x, CAST(lc.n AS DOUBLE) / lt.n AS y
    FROM ch JOIN f ON ch.row = f.row AND NOT base_failed JOIN lc ON lc.lang IS NOT DISTINCT FROM ch.lang AND lc.k = ch.k JOIN lt ON lt.lang IS NOT DISTINCT FROM ch.lang)
  GROUP BY row),
wl AS (SELECT lang, word, count(*) AS n FROM w JOIN c ON w.row = c.row GROUP BY lang, word),
common AS (
  SELECT wl.lang, word, n FROM wl JOIN lw ON wl.lang IS NOT DISTINCT FROM lw.lang WHERE n * {COMMON_SHARE} >= total
  QUALIFY row_number() OVER (PARTITION BY wl.lang ORDER BY n DESC, word) <= {COMMON_WORDS}),
dw AS (SELECT row, word, count(*) AS n FROM w GROUP BY row, word),
hist AS (
  SELECT f.row, f.n_words, lw.total, common.n AS ref, coalesce(dw.n, 0) AS own FROM f JOIN lw ON lw.lang IS NOT DISTINCT FROM f.lang
  JOIN common ON common.lang IS NOT DISTINCT FROM f.lang LEFT JOIN dw ON dw.row = f.row AND dw.word = common.word WHERE NOT base_failed),
rest AS (SELECT row, any_value(n_words) AS n_words, any_value(total) AS total, any_value(total) - sum(ref) AS ref, any_value(n_words) - sum(own) AS own FROM hist GROUP BY row),
wd AS (SELECT row, {js} AS word_distance FROM (SELECT row, CAST(own AS DOUBLE) / n_words AS x, CAST(ref AS DOUBLE) / total AS y FROM (SELECT row, n_words, total, ref, own FROM hist UNION ALL SELECT row, n_words, total, ref, own FROM rest)) GROUP BY row),
v AS (
  SELECT f.*, CASE WHEN NOT base_failed AND lw.total >= {LEAST_REFERENCE} THEN char_distance END AS char_distance,
    CASE WHEN NOT base_failed AND lw.total >= {LEAST_REFERENCE} THEN coalesce(word_distance, 0) END AS word_distance
  FROM f LEFT JOIN cd ON f.row = cd.row LEFT JOIN wd ON f.row = wd.row LEFT JOIN lw ON lw.lang IS NOT DISTINCT FROM f.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {CHARACTER_LIMIT} AND coalesce(word_distance, 0) <= {WORD_LIMIT} AS kept, char_distance, word_distance
FROM v
"""


ORACLE_SQL = _oracle()
