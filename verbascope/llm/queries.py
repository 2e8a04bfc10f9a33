"""The queries of this package, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbascope.llm import bpe, dedup, knn, langid, mixing, rollups, rules, secrets, tiff, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": dedup.op1_order_minhash,
    "op2_language_id": langid.op2_language_id,
    "op3_distribution_rules": rules.op3_distribution_rules,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_rollup": rollups.op5_token_rollup,
    "op6_tiff_pages": tiff.op6_tiff_pages,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_quality_votes": knn.op8_quality_votes,
    "op9_warc": warc.op9_warc,
    "op10_secret_scan": secrets.op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op3_distribution_rules": rules.ORACLE_SQL,
    "op7_source_mix": mixing.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
