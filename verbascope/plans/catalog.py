"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.functions import spans, text, vectors
from verbascope.functions.levels import BANDS, LEVELS
from verbascope.operators import encoders, indices, ordering, stats, wsd
from verbascope.plans import shared
from verbascope.plans.views import view, with_views
from verbascope.sources import files, workbooks

FLAGSHIP = "ph_indices_answer"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    """Registers a query under its function's name, with SQL over ``views`` to check it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = with_views(oracle, *views) if views else oracle
        return f

    return add


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[vectors.rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- phrase and word indices

SPACE_SQL = r"[\s\x{0B}\x1c-\x1f\x{85}\p{Z}]"


class Template(str):
    """SQL with a place for an expression; braces elsewhere stay."""

    def format(self, expression: str) -> Template:
        return Template(self.replace("{}", expression))


STRIP = Template(rf"regexp_replace({{}}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')")
CLEAN = STRIP.format(rf"regexp_replace(regexp_replace(coalesce({{}}, ''), '\[[^\n]*?\]', '', 'g'), '{SPACE_SQL}+', ' ', 'g')")
VALID = "('A1', 'A2', 'B1', 'B2', 'C1', 'C2')"


def _in(levels: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in levels) + ")"


LEVELS_SQL = "SELECT trim(term) AS term, CAST(sense_no AS STRING) AS sense_no, trim(arg_max_null(level, row_no)) AS level FROM inventory GROUP BY 1, 2"
RESOLVED = f"""
lv AS ({LEVELS_SQL}),
resolved AS (
  SELECT h.*, is_poly = '是' AS multi, CASE WHEN is_poly = '是' THEN CASE WHEN lv.level IN {VALID} THEN lv.level END WHEN cefr IN {VALID} THEN cefr END AS lev
  FROM hits h LEFT JOIN lv ON h.phrase = lv.term AND h.sense = lv.sense_no AND h.is_poly = '是'),
numbered AS (SELECT *, CASE lev WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 3 WHEN 'B2' THEN 4 WHEN 'C1' THEN 5 WHEN 'C2' THEN 6 END AS s FROM resolved)"""
GROUPS = {level: (level,) for level in LEVELS} | BANDS
RATIOS = ", ".join(f"count(*) FILTER (lev IN {_in(v)}) / nullif(count(s), 0) AS PH_ratio_{k}" for k, v in GROUPS.items())


def _indices_sql(key: str) -> str:
    return f"""
indices AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT {key} AS essay_id, arg_max_null(total_score, row_no) AS total_score, count(*) AS n_phrases, count(s) AS n, count(s) / count(*) AS PH_level_coverage, {RATIOS},
      sum(s) / nullif(count(s), 0) AS PH_mean_score, count(*) FILTER (lev IN {_in(BANDS['AboveB1'])}) / nullif(count(*) FILTER (lev IN ('A1', 'A2')), 0) AS PH_high_low_ratio,
      CAST(count(s) * sum(s * s) - sum(s) * sum(s) AS DOUBLE) / nullif(count(s) * count(s), 0) AS PH_score_var,
      count(*) FILTER (pos = 'phrasal verb') / count(*) AS PH_pv_ratio, count(*) FILTER (multi) / count(*) AS PH_multi_ratio
    FROM numbered GROUP BY 1)
  WHERE n > 0 AND total_score > 0)"""


ANSWERS = f"WITH {RESOLVED.strip()}, {_indices_sql('essay_id').strip()}"
SCRIPTS = f"WITH {RESOLVED.strip()}, {_indices_sql(chr(39).join(['regexp_replace(essay_id, ', '_[^_]*$', ', ', '', ')'])).strip()}"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.resolved(view(spark, sf_dir, "hits"), indices.sense_levels(view(spark, sf_dir, "inventory")))


@query(ANSWERS + " SELECT * FROM indices", "inventory", "hits")
def ph_indices_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sense-aware levels, the two denominators and all indices, by answer."""
    return indices.phrase_indices(_resolved(spark, sf_dir), "answer")


@query(SCRIPTS + " SELECT * FROM indices", "inventory", "hits")
def ph_indices_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by script: hits are merged before they are aggregated."""
    return indices.phrase_indices(_resolved(spark, sf_dir), "script")


@query(LEVELS_SQL, "inventory")
def sense_levels_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.sense_levels(view(spark, sf_dir, "inventory"))


@query(f"SELECT multi, lev AS level, count(*) AS n FROM (WITH {RESOLVED.strip()} SELECT * FROM resolved) GROUP BY ALL", "inventory", "hits")
def level_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of either kind got which valid level."""
    return _resolved(spark, sf_dir).groupBy("multi", "level").agg(F.count("*").alias("n"))


@query(f"WITH {RESOLVED.strip()} SELECT count(*) AS n_poly_no_level FROM resolved WHERE multi AND lev IS NULL", "inventory", "hits")
def unresolved_poly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.unresolved(_resolved(spark, sf_dir))


@query("SELECT o_custkey, arg_max_null(o_totalprice, o_orderkey) AS last_score FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders) GROUP BY 1")
def last_score_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row's score, null if that row has none."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return rows.groupBy("o_custkey").agg(ordering.last_value("o_totalprice", "o_orderkey").alias("last_score"))


@query("SELECT user_id, event_type, arg_max_null(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_wins(_table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


LONG = " UNION ALL ".join(f"SELECT '{n}' AS index, {i} AS place, total_score AS y, {n} AS x FROM indices" for i, n in enumerate(indices.PHRASE_INDICES))
CORRELATIONS = f"""{ANSWERS}, long AS ({LONG}), m AS (
  SELECT index, CAST(place AS INT) AS place, avg(x) AS mean, stddev_pop(x) AS sd, count(x) AS n, covar_pop(y, x) AS xy, stddev_pop(y) FILTER (x IS NOT NULL) AS sy FROM long GROUP BY 1, 2)
SELECT index, place, round(mean, 9) AS mean, round(sd, 9) AS sd, n, round(CASE WHEN n >= 3 AND sd > 0 AND sy > 0 THEN xy / (sd * sy) END, 9) AS r FROM m"""


@query(CORRELATIONS, "inventory", "hits")
def index_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlations(ph_indices_answer(spark, sf_dir)))


REFERENCE = "reference AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a or 'NULL'}, {b})" for k, (a, b) in stats.REFERENCE_R.items()) + ") AS v(index, r_docx_v6, r_v12_fixed))"


@query(f"WITH {REFERENCE}, c AS ({CORRELATIONS}) SELECT c.index, place, mean, sd, n, r AS r_senseaware, CAST(r_docx_v6 AS DOUBLE) AS r_docx_v6, CAST(r_v12_fixed AS DOUBLE) AS r_v12_fixed FROM c LEFT JOIN reference ON c.index = reference.index", "inventory", "hits")
def corr_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations beside those of earlier runs: all columns of ``corr_pvalues`` but p and its mark."""
    return _rounded(corr_pvalues(spark, sf_dir).drop("p", "sig"))


@query()
def corr_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with p, significance marks and earlier runs' values."""
    return stats.correlation_table(stats.correlations(ph_indices_answer(spark, sf_dir)))


# ---- text


@query(f"""SELECT doc_id, {CLEAN.format("t")} AS cleaned FROM (
  SELECT doc_id, text AS t FROM documents UNION ALL SELECT 1000000 + item_id, text FROM benchmark
  UNION ALL SELECT * FROM (VALUES (-1, 'I  go [went] home' || chr(10) || ' now '), (-2, 'a[b' || chr(10) || 'c]d'), (-3, NULL), (-4, '  [x][y] z' || chr(160)), (-5, 'a[b;c]d [e')) AS v(k, t))""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = rows.union(_table(spark, sf_dir, "benchmark").select(F.col("item_id") + 1000000, "text"))
    more = [(-1, "I  go [went] home\n now "), (-2, "a[b\nc]d"), (-3, None), (-4, "  [x][y] z\xa0"), (-5, "a[b;c]d [e")]
    return rows.union(spark.createDataFrame(more, "doc_id long, text string")).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"""SELECT row_no, {CLEAN.format("definition")} AS short_text,
  concat_ws(' ', nullif({CLEAN.format("definition")}, ''), nullif({CLEAN.format("dict_example")}, '')) AS long_text FROM inventory""", "inventory")
def build_sense_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "inventory")
    return rows.select("row_no", text.sense_text(rows.definition).alias("short_text"), text.sense_text(rows.definition, rows.dict_example).alias("long_text"))


SKIP = "[" + ", ".join(f"'{w}'" for w in text.PLACEHOLDERS) + "]"
KEYWORDS = Template(rf"list_filter(regexp_split_to_array(regexp_replace(lower({{}}), '[''\-]', ' ', 'g'), '{SPACE_SQL}+'), lambda w: w <> '' AND NOT list_contains({SKIP}, w))")
PHRASES = "SELECT p_partkey AS k, p_name AS t FROM part UNION ALL SELECT 10000000 + item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES (-1, 'make up for sth'), (-2, 'be in sb''s shoes'), (-3, 'to be the one'), (-4, 'well-known'), (-5, '')) AS v(k, t)"


@query(f"SELECT k, {KEYWORDS.format('t')} AS keywords FROM ({PHRASES})")
def phrase_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"))
    rows = rows.union(_table(spark, sf_dir, "benchmark").select(F.col("item_id") + 10000000, "text"))
    more = [(-1, "make up for sth"), (-2, "be in sb's shoes"), (-3, "to be the one"), (-4, "well-known"), (-5, "")]
    return rows.union(spark.createDataFrame(more, "k long, t string")).select("k", text.keywords(F.col("t")).alias("keywords"))


@query(f"""SELECT k, list_filter(list_transform(regexp_split_to_array(coalesce(t, ''), '[\\n;；]+'), lambda x: {CLEAN.format("x")}), lambda x: x <> '') AS examples FROM (
  SELECT doc_id AS k, text AS t FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'A x.；B y;' || chr(10)), (-2, 'see [a;b] now'), (-3, NULL)) AS v(k, t))""")
def split_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    more = [(-1, "A x.；B y;\n"), (-2, "see [a;b] now"), (-3, None)]
    return rows.union(spark.createDataFrame(more, "k long, t string")).select("k", text.examples(F.col("t")).alias("examples"))


EDGE = r"[\p{L}\p{N}_]"
GENRE = rf"""CASE
  WHEN contains(head, 'dear') OR contains(full_text, 'yours faithfully') OR contains(full_text, 'yours sincerely') OR contains(full_text, 'best wishes') OR contains(full_text, 'yours truly') THEN 'letter'
  WHEN starts_with({STRIP.format('head')}, 'report') OR (contains(head, 'introduction') AND contains(full_text, 'conclusion')) OR regexp_matches(head, '(^|[^\p{{L}}\p{{N}}_])(to|subject):{EDGE}') THEN 'report'
  WHEN contains(head, ' i ') AND regexp_matches(head, '(^|[^\p{{L}}\p{{N}}_])(once|suddenly)([^\p{{L}}\p{{N}}_]|$)|that day|last (summer|year|week|night)|when i was') THEN 'narrative'
  ELSE 'essay' END"""
GENRES = f"genres AS (SELECT essay_id, total_score, {GENRE} AS genre FROM (SELECT essay_id, total_score, lower(text) AS full_text, lower(substr(text, 1, 400)) AS head FROM essays))"


def _essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "essays")
    return rows.select("essay_id", F.split("text", "\n").alias("paragraphs"), "total_score")


@query(f"WITH {GENRES} SELECT essay_id, genre FROM genres", "essays")
def genre_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _essays(spark, sf_dir).select("essay_id", text.genre(F.col("paragraphs")).alias("genre"))


@query(f"WITH {GENRES} SELECT genre, count(*) AS n FROM genres GROUP BY 1", "essays")
def genre_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genre_classify(spark, sf_dir).groupBy("genre").agg(F.count("*").alias("n"))


@query("SELECT tag, CASE substr(tag, 1, 1) WHEN 'N' THEN 'n' WHEN 'V' THEN 'v' WHEN 'J' THEN 'a' WHEN 'R' THEN 'r' END AS wn, n FROM (SELECT upper(substr(p_type, 1 + p_partkey % 4, 2)) AS tag, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('RP', 1), ('JJ', 1), ('NNS', 1), ('VB', 1), ('DT', 1), ('', 1)) AS v(a, b))")
def pos_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    tags = part.groupBy(F.upper(F.substr("p_type", (1 + F.col("p_partkey") % 4).cast("int"), F.lit(2))).alias("tag")).agg(F.count("*").alias("n"))
    tags = tags.union(spark.createDataFrame([(x, 1) for x in ("RP", "JJ", "NNS", "VB", "DT", "")], "tag string, n long"))
    return tags.select("tag", text.pos_class(F.col("tag")).alias("wn"), "n")


# ---- words

#: A dictionary of the documents' own vocabulary, of words of any length: some first letters have no entries, some have levels that aren't valid, some entries are lemmas.
DICTIONARY = """
vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents),
dictionary AS (SELECT word, CASE ascii(word) % 8 WHEN 1 THEN 'A1' WHEN 2 THEN 'A2' WHEN 3 THEN 'B1' WHEN 4 THEN 'B2' WHEN 5 THEN 'C1' WHEN 6 THEN 'C2' WHEN 7 THEN 'X9' ELSE '' END AS min_level FROM vocabulary WHERE ascii(word) % 9 <> 0)"""
WORDS = f"""
tokens AS (SELECT essay_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM essays),
lemmas AS (SELECT essay_id, word, CASE WHEN length(word) > 4 THEN substr(word, 1, length(word) - 1) ELSE word END AS lemma FROM tokens),
found AS (SELECT essay_id, CASE WHEN l.word IS NOT NULL THEN l.min_level ELSE w.min_level END AS lev FROM lemmas t LEFT JOIN dictionary l ON t.lemma = l.word LEFT JOIN dictionary w ON t.word = w.word),
levelled AS (SELECT *, CASE lev WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 3 WHEN 'B2' THEN 4 WHEN 'C1' THEN 5 ELSE 6 END AS s FROM found WHERE lev IN {VALID}),
word_rows AS (
  SELECT essay_id, count(*) FILTER (lev = 'A1') / count(*) AS W_ratio_A1, count(*) FILTER (lev IN {_in(BANDS['A'])}) / count(*) AS W_ratio_A,
    count(*) FILTER (lev IN {_in(BANDS['B'])}) / count(*) AS W_ratio_B, count(*) FILTER (lev IN {_in(BANDS['C'])}) / count(*) AS W_ratio_C,
    count(*) FILTER (lev IN {_in(BANDS['AboveB1'])}) / count(*) AS W_ratio_AboveB1, sum(s) / count(*) AS W_mean_score, count(*) AS W_n
  FROM levelled GROUP BY 1 HAVING count(*) >= 5)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).where(F.ascii("word") % 9 != 0)
    # words are counted as the optimizer drops a mere DISTINCT before the greatest level of a word is taken, which then sorts all words of all texts
    documents = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 0")
    level = F.element_at(F.array(*[F.lit(x) for x in ("", *LEVELS, "X9")]), F.ascii("word") % 8 + 1)
    return documents.select("word", level.alias("min_level"))


def _word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = view(spark, sf_dir, "essays").select("essay_id", F.explode(text.words(F.col("text"))).alias("word"))
    lemma = F.when(F.length("word") > 4, F.expr("substr(word, 1, length(word) - 1)")).otherwise(F.col("word"))
    return indices.word_indices(indices.counted_levels(tokens.withColumn("lemma", lemma), _dictionary(spark, sf_dir)))


@query(f"WITH {DICTIONARY.strip()}, {WORDS.strip()} SELECT * FROM word_rows", "essays")
def word_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by lemma, else by word; essays of five levelled words and more."""
    return _word_rows(spark, sf_dir)


@query(f"WITH {DICTIONARY.strip()}, {WORDS.strip()} SELECT w.*, total_score FROM word_rows w JOIN essays e ON w.essay_id = e.essay_id WHERE total_score <> 0", "essays")
def word_indices_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.scored(_word_rows(spark, sf_dir), view(spark, sf_dir, "essays"))


#: A document joins the answer whose order has its number.
KEYED = "phrases AS (SELECT * REPLACE (CAST(CAST(regexp_extract(essay_id, '[0-9]+$') AS BIGINT) AS STRING) AS essay_id) FROM indices)"
JOINED = f"{ANSWERS}, {KEYED}, {DICTIONARY.strip()}, {WORDS.strip()}, both_rows AS (SELECT w.*, e.total_score, p.* EXCLUDE (essay_id, total_score, n_phrases) FROM word_rows w JOIN essays e ON w.essay_id = e.essay_id JOIN phrases p ON p.essay_id = w.essay_id WHERE e.total_score > 0)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the answers whose order has their number."""
    number = F.regexp_extract("essay_id", "[0-9]+$", 0).cast("long")
    phrases = ph_indices_answer(spark, sf_dir).withColumn("essay_id", number.cast("string"))
    return indices.joined_indices(word_indices_scored(spark, sf_dir), phrases)


@query(JOINED + " SELECT * FROM both_rows", "inventory", "hits", "essays")
def word_phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)


@query(JOINED + " SELECT round(regr_r2(total_score, PH_mean_score), 9) AS r2, count(*) AS n FROM both_rows", "inventory", "hits", "essays")
def ols_r2_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R² of one predictor, from its moments."""
    rows = _both(spark, sf_dir)
    found = stats.moments(rows, ("PH_mean_score", "total_score"))
    return found.select(vectors.rounded(F.col("cov")[1] * F.col("cov")[1] / (F.col("cov")[0] * F.col("cov")[2]), 9).alias("r2"), "n")


PREDICTORS = (*stats.WORD_BLOCK, *stats.PHRASE_BLOCK)


def _eliminated(name: str, source: str, gone: list[int], left: list[int]) -> tuple[list[str], str]:
    """Steps that take predictors out of the covariances one by one: what is left of the outcome's variance is unexplained."""
    steps, at = [], lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    for k in gone:
        left = [i for i in left if i != k]
        columns = ", ".join(f"{at(i, j)} - CASE WHEN {at(k, k)} > 1e-12 THEN {at(i, k)} * {at(j, k)} / {at(k, k)} ELSE 0 END AS {at(i, j)}" for i in left for j in left if i <= j)
        steps.append(f"{name}{k} AS (SELECT grp, {columns} FROM {source})")
        source = f"{name}{k}"
    return steps, source


def _regression_sql() -> str:
    """R² of both blocks and the F of the gain, overall and by genre, from covariances."""
    columns, y, first = (*PREDICTORS, "total_score"), len(PREDICTORS), len(stats.WORD_BLOCK)
    moments = ", ".join(f"covar_pop({columns[i]}, {columns[j]}) AS a_{i}_{j}" for i in range(y + 1) for j in range(i, y + 1))
    start = f"m AS (SELECT CASE WHEN grouping(genre) = 1 THEN 'overall' ELSE genre END AS grp, count(*) AS n, {moments} FROM both_rows JOIN (SELECT essay_id, genre FROM genres) USING (essay_id) GROUP BY GROUPING SETS ((), (genre)))"
    word, w = _eliminated("w", "m", list(range(first)), list(range(y + 1)))
    both, b = _eliminated("b", w, list(range(first, y)), list(range(first, y + 1)))
    phrase, p = _eliminated("p", "m", list(range(first, y)), list(range(first, y + 1)))
    v = f"a_{y}_{y}"
    fits = f"""fits AS (
  SELECT m.grp, n, m.n >= {stats.LEAST_GROUP} AND m.{v} > 0 AS ok, 1 - {w}.{v} / m.{v} AS r2_word, 1 - {b}.{v} / m.{v} AS r2_both, 1 - {p}.{v} / m.{v} AS r2_phrase
  FROM m JOIN {w} ON m.grp = {w}.grp JOIN {b} ON m.grp = {b}.grp JOIN {p} ON m.grp = {p}.grp)"""
    steps = ", ".join([start, *word, *both, *phrase, fits])
    shown = ", ".join(f"CASE WHEN ok THEN round({x}, 6) END AS {n}" for n, x in {
        "r2_word": "r2_word", "r2_both": "r2_both", "r2_phrase": "r2_phrase", "delta_r2": "r2_both - r2_word", "f": f"((r2_both - r2_word) / {y - first}) / ((1 - r2_both) / (n - {y + 1}))",
    }.items())
    return f"{JOINED}, {GENRES}, {steps} SELECT grp, n, CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS status, {shown} FROM fits"


@query(_regression_sql(), "inventory", "hits", "essays")
def hier_f_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested test up to its p: R² of either block and of both, and F, overall and by genre."""
    return _rounded(hier_f_test(spark, sf_dir).drop("p", "sig"), 6)


@query(f"SELECT round(r2_word, 6) AS r2_word, round(r2_both, 6) AS r2_both, round(r2_phrase, 6) AS r2_phrase, n FROM ({_regression_sql()}) WHERE grp = 'overall'", "inventory", "hits", "essays")
def ols_r2_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R² of the word block, of the phrase block, and of all five predictors."""
    return _rounded(hier_f_test(spark, sf_dir).where("grp = 'overall'").select("r2_word", "r2_both", "r2_phrase", "n"), 6)


@query()
def hier_f_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word block, word and phrase block: overall and by genre."""
    genres = genre_classify(spark, sf_dir)
    return stats.hierarchical(_both(spark, sf_dir).join(genres, "essay_id"))


# ---- sources and sinks: tables written to the shared folder in each format and read back


def _cells(names: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'CAST({n} AS STRING) AS {n}' for n in names)} FROM {table}"


@query(ANSWERS + " SELECT * FROM indices", "inventory", "hits")
def source_index_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase indices as CSV with headers and ``nan``, read by id."""
    path = shared.folder(spark, "index-csv")
    files.write_indices(ph_indices_answer(spark, sf_dir), path)
    return files.read_indices(spark, path)


@query(f"WITH {DICTIONARY.strip()} SELECT word, min_level FROM dictionary")
def source_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "dictionary")
    _dictionary(spark, sf_dir).write.parquet(path)
    return files.read_dictionary(spark, path)


@query("SELECT essay_id, string_split(text, chr(10)) AS paragraphs, total_score FROM essays", "essays")
def source_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays as XML, a paragraph a line."""
    path = shared.folder(spark, "essays")
    files.write_essays(_essays(spark, sf_dir), path)
    essays, _ = files.read_essays(spark, path, pattern="part-*", written=True)
    return essays


@query(_cells(workbooks.INVENTORY, "inventory"), "inventory")
def source_inventory_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sense inventory as workbooks of ten thousand rows, read by header."""
    path = shared.folder(spark, "inventory")
    workbooks.write_workbooks(view(spark, sf_dir, "inventory"), path, workbooks.INVENTORY, "row_no")
    return workbooks.read_inventory(spark, path).drop("row_no")


@query(f"SELECT * REPLACE (CAST(total_score AS DOUBLE) AS total_score) FROM ({_cells(workbooks.HITS, 'hits')})", "hits")
def source_hits_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase hits as workbooks; an essay's number gives the book."""
    path = shared.folder(spark, "hits")
    number = F.regexp_extract("essay_id", "[0-9]+$", 0).cast("long")
    workbooks.write_workbooks(view(spark, sf_dir, "hits").withColumn("number", number), path, workbooks.HITS, "number")
    return workbooks.read_hits(spark, path).drop("row_no")


# ---- senses

FIRST = "firsts AS (SELECT * FROM inventory QUALIFY row_number() OVER (PARTITION BY term, sense_no ORDER BY row_no) = 1)"
CLEANED = f"cleaned AS (SELECT *, {CLEAN.format('learner_example')} AS clean_learner FROM firsts)"
EVALUABLE = "evaluable AS (SELECT c.*, n_senses FROM cleaned c JOIN (SELECT term, count(*) AS n_senses FROM cleaned GROUP BY term HAVING count(*) >= 2 AND bool_and(clean_learner <> '')) USING (term))"


@query(f"WITH {FIRST}, {CLEANED} SELECT * FROM cleaned", "inventory")
def sense_inventory_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.sense_inventory(view(spark, sf_dir, "inventory"))


@query(f"WITH {FIRST} SELECT term, list(sense_no ORDER BY sense_no) AS numbers FROM firsts GROUP BY term", "inventory")
def senses_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wsd.senses_in_order(wsd.sense_inventory(view(spark, sf_dir, "inventory")))
    return rows.select("term", F.transform("senses", lambda s: s["sense_no"]).alias("numbers"))


@query(f"WITH {FIRST}, {CLEANED}, {EVALUABLE} SELECT term, sense_no, n_senses, clean_learner FROM evaluable", "inventory")
def evaluable_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.evaluable(wsd.sense_inventory(view(spark, sf_dir, "inventory"))).select("term", "sense_no", "n_senses", "clean_learner")


@query(f"WITH {FIRST}, {CLEANED}, {EVALUABLE} SELECT g.term, g.sense_no AS gold_no, s.sense_no, g.clean_learner AS target, g.n_senses FROM evaluable g JOIN evaluable s ON g.term = s.term", "inventory")
def sense_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.pairs(wsd.evaluable(wsd.sense_inventory(view(spark, sf_dir, "inventory")))).select("term", "gold_no", "sense_no", "target", "n_senses")


def _tfidf_sql(texts: str, targets: str) -> str:
    word = r"'[\p{L}\p{N}_][\p{L}\p{M}\p{N}_]+'"
    return f"""
texts AS ({texts}), targets AS ({targets}),
docs AS (SELECT g.term, gold_no, sense_no, text FROM targets g JOIN texts t ON g.term = t.term UNION ALL SELECT term, gold_no, NULL, target FROM targets),
size AS (SELECT term, gold_no, count(*) AS n FROM docs GROUP BY 1, 2),
tok AS (SELECT term, gold_no, sense_no, unnest(regexp_extract_all(lower(text), {word})) AS w FROM docs),
tf AS (SELECT term, gold_no, sense_no, w, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, gold_no, w, count(*) AS df FROM tf GROUP BY ALL),
weighted AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term, gold_no, w) JOIN size USING (term, gold_no)),
length AS (SELECT term, gold_no, sense_no, sqrt(sum(x * x)) AS len FROM weighted GROUP BY ALL),
unit AS (SELECT a.*, x / len AS u FROM weighted a JOIN length b ON a.term = b.term AND a.gold_no = b.gold_no AND a.sense_no IS NOT DISTINCT FROM b.sense_no),
meet AS (SELECT s.term, s.gold_no, s.sense_no, sum(s.u * t.u) AS sim FROM unit s JOIN unit t ON s.term = t.term AND s.gold_no = t.gold_no AND s.w = t.w AND t.sense_no IS NULL WHERE s.sense_no IS NOT NULL GROUP BY ALL),
sims AS (SELECT d.term, d.gold_no, d.sense_no, round(coalesce(sim, 0), 9) AS sim FROM docs d LEFT JOIN meet m ON d.term = m.term AND d.gold_no = m.gold_no AND d.sense_no = m.sense_no WHERE d.sense_no IS NOT NULL)"""


PREDICTED = """
results AS (
  SELECT *, CASE WHEN n_senses > 1 THEN round(ranked[1] - ranked[2], 9) ELSE 1.0 END AS sim_gap, CASE WHEN n_senses > 1 THEN ranked[1] - ranked[2] ELSE 1.0 END < 1e-4 AS is_tie, pred_no = gold_no AS is_correct FROM (
    SELECT term, gold_no, count(*) AS n_senses, arg_max(sense_no, sim * 1e6 - sense_no * 1e-9) AS guess, list(sim ORDER BY sense_no) AS sims, list(sim ORDER BY sim DESC) AS ranked,
      first(sense_no ORDER BY sim DESC, sense_no) AS pred_no FROM sims GROUP BY term, gold_no))"""
RESULT = "SELECT term, gold_no, n_senses, pred_no, sims, sim_gap, is_tie, is_correct FROM results"
DIALOGUES = "WITH " + _tfidf_sql("SELECT term, sense_no, text FROM dialogues", "SELECT term, gold_no, target FROM openers").strip() + ", " + PREDICTED.strip()


def _tidy(results: DataFrame) -> DataFrame:
    return results.withColumn("sim_gap", vectors.rounded(F.col("sim_gap"), 9))


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.predicted(wsd.tfidf_similarities(view(spark, sf_dir, "dialogues"), view(spark, sf_dir, "openers")), places=9)


@query(DIALOGUES + " " + RESULT, "dialogues", "openers")
def tfidf_wsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each opener against the other turns of its conversation."""
    return _tidy(_dialogues(spark, sf_dir))


INVENTORY_WSD = f"""WITH {FIRST}, {CLEANED}, {EVALUABLE}, {_tfidf_sql(
    f"SELECT term, sense_no, concat_ws(' ', nullif({CLEAN.format('definition')}, ''), nullif({CLEAN.format('dict_example')}, '')) AS text FROM evaluable",
    "SELECT term, sense_no AS gold_no, clean_learner AS target FROM evaluable").strip()}, {PREDICTED.strip()}"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    senses = wsd.evaluable(wsd.sense_inventory(view(spark, sf_dir, "inventory")))
    targets = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("target"))
    return wsd.predicted(wsd.tfidf_similarities(wsd.sense_texts(senses), targets), places=9)


@query(INVENTORY_WSD + f""" SELECT trim(r.term) AS phrase, r.n_senses, g.clean_learner AS target, gold_no, {CLEAN.format('g.definition')} AS gold_def, pred_no, {CLEAN.format('p.definition')} AS pred_def,
  is_correct, is_tie, sims, sim_gap, g.level, CAST(NULL AS BOOLEAN) AS target_matched, CAST(NULL AS DOUBLE) AS sense_match_rate
FROM results r JOIN evaluable g ON r.term = g.term AND gold_no = g.sense_no JOIN evaluable p ON r.term = p.term AND pred_no = p.sense_no""", "inventory")
def wsd_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every target, with the texts of its gold and predicted senses."""
    senses = wsd.evaluable(wsd.sense_inventory(view(spark, sf_dir, "inventory")))
    return wsd.detailed(_tidy(_evaluated(spark, sf_dir)), senses).withColumn("phrase", F.trim("phrase"))


@query(DIALOGUES + " SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, coalesce(count(*) FILTER (is_correct) / count(*), 0) AS accuracy, count(*) FILTER (is_tie) AS ties FROM results", "dialogues", "openers")
def wsd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.summary(_dialogues(spark, sf_dir))


@query(DIALOGUES + " SELECT n_senses, count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct) / count(*) AS accuracy FROM results GROUP BY 1", "dialogues", "openers")
def wsd_per_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.per_n(_dialogues(spark, sf_dir))


@query(DIALOGUES + " SELECT term, gold_no, sim_gap FROM results WHERE is_tie", "dialogues", "openers")
def wsd_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(_dialogues(spark, sf_dir)).where("is_tie").select("term", "gold_no", "sim_gap")


# ---- vectors

NEAR = """
targets AS (SELECT term, vec_id AS gold_id, label AS gold_no, embedding AS t FROM vectors WHERE vec_id % 20 < 10),
anchors AS (SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY vec_id) AS INT) AS sense_no, label, embedding AS s FROM vectors WHERE vec_id % 20 >= 10),
sims AS (SELECT g.term, gold_id AS gold_no, sense_no, round(list_cosine_similarity(CAST(t AS DOUBLE[]), CAST(s AS DOUBLE[])), 9) AS sim FROM targets g JOIN anchors a ON g.term = a.term)"""


@query(f"WITH {NEAR.strip()}, {PREDICTED.strip()} {RESULT}", "vectors")
def embedding_wsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and senses as given vectors: a phrase has ten of each, and phrases grow with the table."""
    rows = view(spark, sf_dir, "vectors")
    targets = rows.where("vec_id % 20 < 10").select("term", F.col("vec_id").alias("gold_no"), F.col("embedding").alias("vec"))
    numbers = rows.where("vec_id % 20 >= 10").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    anchors = numbers.select("term", F.posexplode("all").alias("pos", "one")).select("term", (F.col("pos") + 1).alias("sense_no"), F.col("one.embedding").alias("vec"))
    return _tidy(wsd.predicted(wsd.vector_similarities(anchors, targets), places=9))


@query("""WITH e AS (SELECT term, label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT term, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors) GROUP BY ALL)
SELECT term, label AS sense_no, list(round(x, 6) ORDER BY pos) AS vec FROM e GROUP BY ALL""", "vectors")
def sense_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "vectors").select("term", F.col("label").alias("sense_no"), F.col("embedding").alias("vec"))
    return wsd.anchors(rows).withColumn("vec", F.transform("vec", lambda x: vectors.rounded(x, 6)))


@query("""WITH e AS (SELECT term, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT term, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors WHERE vec_id % 4 <> 0) GROUP BY ALL)
SELECT term, list(round(x, 6) ORDER BY pos) AS vec FROM e GROUP BY ALL""", "vectors")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked mean of the token vectors of each text: here the vectors of each term, a quarter of them padding."""
    rows = view(spark, sf_dir, "vectors").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("tokens"))
    pooled = vectors.pooled(F.transform("tokens", lambda t: t["embedding"]), F.transform("tokens", lambda t: F.when(t["vec_id"] % 4 != 0, 1).otherwise(0)))
    return rows.select("term", F.transform(pooled, lambda x: vectors.rounded(x, 6)).alias("vec"))


# ---- phrase matching

SPAN = f"""
words AS (SELECT doc_id, text, lower(text) AS low, term, {KEYWORDS.format('term')} AS kw FROM sentences),
step1 AS (SELECT *, len(kw) AS n, instr(low, kw[1]) AS a FROM words),
step2 AS (SELECT *, CASE WHEN a > 0 AND n > 1 THEN CASE WHEN instr(substr(low, a + 1), kw[2]) > 0 THEN a + instr(substr(low, a + 1), kw[2]) ELSE instr(low, kw[2]) END END AS b FROM step1),
step3 AS (SELECT *, CASE WHEN b > 0 AND n > 2 THEN CASE WHEN instr(substr(low, b + 1), kw[3]) > 0 THEN b + instr(substr(low, b + 1), kw[3]) ELSE instr(low, kw[3]) END END AS c FROM step2),
ends AS (SELECT *, n > 0 AND a > 0 AND (n < 2 OR b > 0) AND (n < 3 OR c > 0) AS ok FROM step3),
spans AS (SELECT doc_id, text, term, kw, CASE WHEN ok THEN least(a, coalesce(b, a), coalesce(c, a)) - 1 END AS span_start,
  CASE WHEN ok THEN greatest(a + length(kw[1]), coalesce(b + length(kw[2]), 0), coalesce(c + length(kw[3]), 0)) - 1 END AS span_end FROM ends)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "sentences")
    return rows.withColumn("span", spans.exact_span(F.col("text"), text.keywords(F.col("term"))))


@query(f"WITH {SPAN.strip()} SELECT doc_id, CAST(span_start AS INT) AS span_start, CAST(span_end AS INT) AS span_end FROM spans", "sentences")
def exact_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))




@query(f"""WITH {SPAN.strip()},
pieces AS (SELECT doc_id, span_start, span_end, unnest(range(0, CAST(ceil(length(text) / 4) AS BIGINT))) AS i FROM spans WHERE length(text) > 0)
SELECT s.doc_id, coalesce(list(CAST(i + 1 AS INT) ORDER BY i) FILTER (i IS NOT NULL), []) AS at FROM spans s LEFT JOIN pieces p ON s.doc_id = p.doc_id AND 4 * i < p.span_end AND 4 * i + 4 > p.span_start GROUP BY s.doc_id""", "sentences")
def token_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a span touches, if tokens are four characters long and stand between two specials."""
    special = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 4).cast("int") - 1), lambda i: F.struct((4 * i).alias("start"), (4 * i + 4).alias("end")))
    tokens = F.concat(special, F.when(F.length("text") > 0, pieces).otherwise(F.array().cast("array<struct<start:int,end:int>>")), special)
    return _spans(spark, sf_dir).withColumn("tokens", tokens).select("doc_id", spans.covered_tokens(F.col("tokens"), F.col("span")).alias("at"))


LEMMA_SPAN = f"""{SPAN.strip()},
runs AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS r FROM spans)),
placed AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos) AS ce FROM runs),
lettered AS (SELECT doc_id, lower(run) AS w, ce - length(run) AS cs, ce, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM placed WHERE regexp_matches(run, '\\p{{L}}')),
one AS (SELECT s.doc_id, any_value(kw) AS kw, min(i) AS i1 FROM spans s LEFT JOIN lettered t ON t.doc_id = s.doc_id AND t.w = s.kw[1] GROUP BY s.doc_id),
two AS (SELECT s.*, m, coalesce(m, f) AS i2, coalesce(m + 1, i1 + 1) AS next2 FROM one s LEFT JOIN (
  SELECT s.doc_id, min(i) FILTER (i > i1) AS m, min(i) AS f FROM one s JOIN lettered t ON t.doc_id = s.doc_id AND t.w = s.kw[2] GROUP BY s.doc_id) x ON s.doc_id = x.doc_id),
three AS (SELECT s.*, coalesce(m3, f3) AS i3 FROM two s LEFT JOIN (
  SELECT s.doc_id, min(i) FILTER (i >= next2) AS m3, min(i) AS f3 FROM two s JOIN lettered t ON t.doc_id = s.doc_id AND t.w = s.kw[3] GROUP BY s.doc_id) x ON s.doc_id = x.doc_id),
told AS (SELECT * FROM three WHERE len(kw) > 0 AND i1 IS NOT NULL AND (len(kw) < 2 OR i2 IS NOT NULL) AND (len(kw) < 3 OR i3 IS NOT NULL)),
lemma_spans AS (SELECT g.doc_id, min(cs) AS low, max(ce) AS high FROM told g JOIN lettered t ON t.doc_id = g.doc_id AND t.i IN (i1, i2, i3) GROUP BY g.doc_id)"""


@query(f"WITH {LEMMA_SPAN} SELECT s.doc_id, CAST(coalesce(low, span_start) AS INT) AS span_start, CAST(coalesce(high, span_end) AS INT) AS span_end FROM spans s LEFT JOIN lemma_spans l ON s.doc_id = l.doc_id", "sentences")
def lemma_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by lemma, from the plain analyzer, and else by characters."""
    rows = encoders.lemma_tokens(view(spark, sf_dir, "sentences").withColumn("keywords", text.keywords(F.col("term"))), encoders.PlainAnalyzer, among="keywords")
    span = spans.phrase_span(F.col("text"), F.col("keywords"), F.col("lemmas"))
    return rows.select("doc_id", span.alias("span")).select("doc_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


LOG = f"""{SPAN.strip()},
log AS (SELECT array_to_string(kw, ' ') AS phrase, CASE WHEN doc_id % 3 = 0 THEN 'target' ELSE 'sense_ex' END AS label, substr(text, 1, 80) AS text,
  CASE WHEN span_start IS NULL THEN 'fallback' ELSE 'matched' END AS status, CASE WHEN span_start IS NULL THEN 'fallback' ELSE 'exact' END AS match_method,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS weight FROM spans)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.col("doc_id") % 3 == 0
    rows = _spans(spark, sf_dir).withColumns({
        "label": F.when(target, "target").otherwise("sense_ex"), "n_tokens": F.when(F.col("span").isNotNull(), 1).otherwise(0), "weight": F.when(target, 1).otherwise(2),
    })
    return wsd.match_log(rows)


@query(f"WITH {LOG} SELECT phrase, label, text, status, match_method, CAST(weight AS INT) AS weight FROM log", "sentences")
def match_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).drop("n_tokens")


@query(f"""WITH {LOG}, r AS (
  SELECT grouping_id(label, phrase, match_method) AS g, label, phrase, match_method, CAST(sum(weight) AS BIGINT) AS total, CAST(coalesce(sum(weight) FILTER (status = 'matched'), 0) AS BIGINT) AS matched
  FROM log GROUP BY GROUPING SETS ((), (label), (phrase), (match_method)))
SELECT CASE g WHEN 7 THEN 'overall' WHEN 3 THEN 'label' WHEN 5 THEN 'phrase' ELSE 'method' END AS by, coalesce(label, phrase, match_method, '') AS value, total, matched, total - matched AS fallback, round(matched / total, 4) AS match_rate FROM r""", "sentences")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched sentences overall and by label, phrase and method."""
    return wsd.match_stats(_log(spark, sf_dir))


@query(f"""WITH {SPAN.strip()}, e AS (SELECT term, doc_id % 7 AS sense_no, count(*) FILTER (span_start IS NOT NULL) / count(*) AS rate FROM spans GROUP BY ALL)
SELECT term, round(avg(rate), 4) AS sense_match_rate FROM e GROUP BY term""", "sentences")
def sense_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over senses, not over sentences."""
    rows = _spans(spark, sf_dir).select("term", (F.col("doc_id") % 7).alias("sense_no"), F.col("span").isNotNull().alias("matched"))
    return wsd.sense_match_rates(rows)


MATCHED = "matches AS (SELECT CAST(conv_id AS STRING) AS term, CASE WHEN conv_id % 5 = 4 THEN NULL ELSE conv_id % 2 = 0 END AS target_matched FROM conversations WHERE turn = 0)"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("term").cast("long")
    return _dialogues(spark, sf_dir).withColumn("target_matched", F.when(key % 5 != 4, key % 2 == 0))


@query(f"{DIALOGUES}, {MATCHED} SELECT CASE WHEN target_matched THEN 'matched' ELSE 'fallback' END AS status, count(*) AS total, count(*) FILTER (is_correct) AS correct, round(count(*) FILTER (is_correct) / count(*), 4) AS accuracy FROM results JOIN matches USING (term) WHERE target_matched IS NOT NULL GROUP BY 1", "dialogues", "openers")
def wsd_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.ablation(_matched(spark, sf_dir))


@query(f"{DIALOGUES}, {MATCHED} SELECT round(count(*) FILTER (target_matched) / count(*), 4) AS match_rate FROM results JOIN matches USING (term)", "dialogues", "openers")
def wsd_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsd.match_rate(_matched(spark, sf_dir))


@query()
def phrase_vector_wsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over contextual vectors, with the stand-in model: anchors, targets, matches, predictions."""
    senses = wsd.evaluable(wsd.sense_inventory(view(spark, sf_dir, "inventory")))
    said = encoders.phrase_vectors(encoders.token_vectors(wsd.anchor_texts(senses), encoders.HashingEncoder))
    targets = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("text"))
    heard = encoders.phrase_vectors(encoders.token_vectors(targets, encoders.HashingEncoder))
    rates = wsd.sense_match_rates(said.select("term", "sense_no", (F.col("n_tokens") > 0).alias("matched")))
    matches = heard.select("term", "gold_no", (F.col("n_tokens") > 0).alias("target_matched")).join(rates, "term")
    similarities = wsd.vector_similarities(wsd.anchors(said), heard.select("term", "gold_no", "vec"))
    return wsd.detailed(_tidy(wsd.predicted(similarities, places=9)), senses, matches)
