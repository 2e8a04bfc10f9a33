"""Phrase indices that follow a growing folder of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbascope.operators.indices import COUNTED, PHRASE_COLUMNS, phrase_groups, resolved
from verbascope.operators.ordering import last_wins


def follow(spark: SparkSession, hits: str, schema: str, levels: DataFrame, folder: str, unit: str = "answer") -> StreamingQuery:
    """Keeps the indices of all hits that arrive in ``hits`` in ``folder``, for ``latest`` to read.

    The plan is the batch plan; ``levels`` is joined as a fixed table. Each
    batch writes the groups that it changed, and nothing else, under its own
    number, so a batch that is run again replaces what it wrote.
    """

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    rows = resolved(spark.readStream.schema(schema).parquet(hits), levels)
    return phrase_groups(rows, unit).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/progress").start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The indices as of the last batch: of each group its last row, if it still counts."""
    changes = spark.read.option("mergeSchema", "false").parquet(f"{folder}/changes")
    return last_wins(changes.withColumn("batch", F.col("batch").cast("long")), ["essay_id"], "batch").where(COUNTED).select(*PHRASE_COLUMNS)
