"""Rules that depend on the order of rows; a row number makes them deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, order: str) -> Column:
    return F.struct(*[df[c] for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """The first row of each key, by an aggregate that combines before it shuffles."""
    return df.groupBy(*keys).agg(F.min_by(_row(df, order), order).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(_row(df, order), order).alias("_row")).select("_row.*")


def last_value(value: str, order: str = "row_no") -> Column:
    """An aggregate: the value of the last row, null if that row's value is."""
    return F.max_by(F.col(value), F.col(order))
