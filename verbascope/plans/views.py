"""The analyses' inputs as views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LEVEL = "CASE {} WHEN 1 THEN 'A1' WHEN 2 THEN 'A2' WHEN 3 THEN 'B1' WHEN 4 THEN 'B2' WHEN 5 THEN 'C1' WHEN 6 THEN 'C2' WHEN 7 THEN 'X9' ELSE '' END"

VIEWS = {
    "inventory": f"""
SELECT p_partkey AS row_no, ' ' || p_brand AS term, CAST(1 + p_size % 7 AS INT) AS sense_no, p_name AS definition,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type || '; ' || p_name || chr(10) || p_brand END AS dict_example,
  CASE WHEN p_partkey % 13 = 0 THEN '[none]' ELSE p_name || '  [sic] in ' || p_type END AS learner_example, {LEVEL.format('p_partkey % 8')} AS level
FROM part""",
    "hits": f"""
SELECT CAST(o_custkey AS STRING) || '_A' || CAST(l_orderkey AS STRING) AS essay_id, l_linenumber AS row_no, p_brand AS phrase,
  CASE WHEN l_returnflag = 'R' THEN '是' ELSE '否' END AS is_poly, CAST(l_linenumber AS STRING) AS sense,
  {LEVEL.format('(l_linenumber + l_suppkey) % 8')} AS cefr, CASE WHEN l_linestatus = 'F' THEN 'phrasal verb' ELSE 'noun' END AS pos,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 41 AS DOUBLE) END AS total_score
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "essays": """
SELECT CAST(doc_id AS STRING) AS essay_id, text, CAST(doc_id % 23 AS DOUBLE) AS total_score FROM documents
UNION ALL SELECT CAST(-k AS STRING), t, 5.0 FROM (VALUES
  (1, 'Dear Sir'), (2, 'Report on x'), (3, 'to:john'), (4, 'to: john'), (5, 'Well i was once here'), (6, 'Hello'), (7, 'An introduction. And a conclusion'), (8, 'Hi. Best wishes'), (9, 'that day i left')) AS v(k, t)""",
    "dialogues": """
SELECT CAST(conv_id AS STRING) AS term, CAST(turn AS INT) AS sense_no, text FROM conversations WHERE turn > 0 AND text IS NOT NULL""",
    "openers": """
SELECT CAST(conv_id AS STRING) AS term, CAST(1 + conv_id % 2 AS INT) AS gold_no, text AS target FROM conversations
WHERE turn = 0 AND text IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations WHERE turn > 0 AND text IS NOT NULL)""",
    "vectors": """
SELECT vec_id, embedding, label, CAST((vec_id - vec_id % 20) AS STRING) AS term FROM embeddings""",
    "sentences": """
SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'the of' WHEN 1 THEN 'on th' WHEN 2 THEN 'de en' WHEN 3 THEN 'to be the one' ELSE 'make up for sth' END AS term FROM documents
UNION ALL SELECT * FROM (VALUES (-1, 'make it up', 'make up'), (-2, 'up we make', 'make up'), (-3, 'made up', 'make up'), (-4, 'in my shoes so s', 'be in sb''s shoes')) AS v(a, b, c)""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with views of ``VIEWS`` as common tables."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {parts}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {parts} {sql}"
