"""Mixing sources to target weights.

Tokens are summed by source; targets follow from the weights; each source's
repetition rate is its target over its tokens. A document is emitted
floor(rate) times, and once more when a uniform number hashed from its id and
a seed lies below the fraction. All of it is DataFrame functions.

Targets: sources by code point, a null source last, weigh 5, 2, 1, 5, 2, 1 ...
and share all tokens. A target stops at ``most`` times its source's tokens and
what is over goes to the others by weight, until none is above. That fixed
point is min(most * tokens, level * weight) for one level, found with running
sums over the sources in the order in which they stop.

The targets are made from one row a source, ranked in one task: a few hundred
bytes each, so that a hundred thousand sources fit easily; their documents
aren't among them.

Defined cases: a null text has size 0; texts of any length are counted whole;
of sources that stop at the same level the first by rank counts first; a source without words has target 0
and its documents are emitted as often as the next whole number of its rate,
0; a null source is a source of its own; a null doc_id hashes as the empty
text; repeated rows share their draw. An empty table gives no rows. Other columns are
neither read nor in the way, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verbascope.llm.common import BLANK, stored, table

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"

#: A table of so many sources at most is broadcast; a larger one is joined with salt.
BROADCAST_SOURCES = 20_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text, as long: the gaps between them are single blanks once runs are squeezed."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))
    blanks = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, size): one small row a source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = len(weights)
    weighed = sums.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % kinds + 1).cast("int"))
    )
    # in the order in which sources reach their limit as the level rises; whole numbers, so sums are exact
    order = Window.orderBy((F.col("source_size") * most / F.col("weight")).asc(), F.col("rank").asc())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * most
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = weighed.withColumn("level", (F.sum("source_size").over(everything) - stopped).cast("double") / rest)
    free = F.col("level") * F.col("weight") <= F.col("source_size") * most
    # the first source that doesn't stop at its own level sets the level of all
    level = F.min(F.when(free, F.struct(F.col("source_size") * most / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"]
    target = F.least((F.col("source_size") * most).cast("double"), F.coalesce(level * F.col("weight"), F.lit(float("inf"))))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) of an id: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``docs`` joined to their source's row, null source included.

    The sources are counted first. Few are broadcast; many are repeated under
    each salt and shuffled, so that a hot source is spread over the tasks.
    """
    key, null = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    few = targets.select(key.alias("_key"), null.alias("_null"), "source_size", "target")
    keyed = docs.withColumns({"_key": key, "_null": null})
    if targets.count() <= BROADCAST_SOURCES:
        return keyed.join(F.broadcast(few), ["_key", "_null"]).drop("_key", "_null")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["_key", "_null", "_salt"]).drop("_key", "_null", "_salt")


def copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (with doc_id, source, size) with source_size, target and how often each is emitted."""
    sized = docs.withColumn("source", F.col("source").cast("string"))
    targets = stored(source_targets(sized.select("source", "size")), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return with_targets(sized, targets).withColumn("copies", F.floor(rate) + more)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies, with the columns of ``docs``."""
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs.doc_id, docs.source, word_count(docs.text).alias("size"))
    return copies(row, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(docs.text).alias("size"))
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER o, 0) AS before_size, coalesce(sum(weight) OVER o, 0) AS before_weight,
    source_size * 3 / weight AS stops_at
  FROM w WINDOW o AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - 3 * before_size AS DOUBLE) / CAST(weights - before_weight AS DOUBLE) AS level FROM p),
c AS (SELECT arg_min(level, CAST(source_size * 3 AS DOUBLE) / weight) AS level FROM l WHERE level * weight <= source_size * 3),
t AS (SELECT l.source, source_size, least(CAST(source_size * 3 AS DOUBLE), coalesce(c.level * weight, CAST('inf' AS DOUBLE))) AS target FROM l, c),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM e
"""
