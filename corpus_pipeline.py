"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the nearest-neighbour votes reject go.
2. near_dedup: one document of each class of near-duplicates stays.
3. secrets: found secrets are replaced in the text.
4. mix: documents are repeated or left out so that sources meet their targets.
5. tokens: texts become ids, and the ids' digests and those of the bytes they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbascope.llm import bpe, dedup, knn, mixing, secrets
from verbascope.llm.common import Shelf, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score 0.5 or more by the labels of ``sf_dir``, with all their columns.

    Null and empty texts get the sample's mean label; without labels, or with
    no document that is labelled, all stay. Equal texts stay or go together, as
    do rows of one id and text; very long texts are scored whole. An empty
    table stays empty. Columns other than doc_id and text aren't looked at.
    """
    return knn.good(docs, knn.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id, with all its columns.

    Null texts all stay; equal texts, empty ones included, are one class; rows
    that repeat an id and its text leave one. Of texts that share the least id
    the one of least digest stays; a null id counts after all others. Very long
    texts are compared whole. An empty table stays empty.
    """
    return dedup.distinct_documents(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced in ``text`` and ``n_chars`` counted anew where the text changed.

    Null and empty texts stay as they are; spans that overlap are replaced
    together; equal texts change alike, and texts of any length are scanned
    whole. Other columns stay as they are. An empty table stays empty.
    """
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for, with all its columns.

    A null source is one of its own, the last; null and empty texts have no
    words, and a source of such texts alone leaves none. Repeated rows share
    their draw, so all or none of them get the extra copy; a null id is drawn
    as the empty text. Texts of any length are counted whole. An empty table
    stays empty.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every document.

    A null text is the empty text, which has no ids; pairs of equal rank merge
    from the left; texts of any length are encoded whole. Repeated rows give
    repeated rows; an empty table gives none. Other columns are dropped.
    """
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", without_secrets), ("mix", mix), ("tokens", tokens)]

#: Sketches, votes and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from a table in the shared folder that is the caller's; those of the other stages are deleted."""
    docs = table(spark, sf_dir, "documents")
    with Shelf(spark, "pipeline") as shelf:
        for name, stage in STAGES[:-1]:
            docs = shelf.put(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
