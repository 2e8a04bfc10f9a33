"""CEFR levels as an ordinal scale, and their bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scale, lowest first, and the bands; the last two bands include their first level.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
BANDS = {
    "A": ("A1", "A2"),
    "B": ("B1", "B2"),
    "C": ("C1", "C2"),
    "AboveB1": ("B1", "B2", "C1", "C2"),
    "AboveB2": ("B2", "C1", "C2"),
}


def is_level(column: Column) -> Column:
    return F.coalesce(column.isin(*LEVELS), F.lit(False))


def level_score(column: Column) -> Column:
    """1 to 6 as long; null for what is no level."""
    score = F.lit(None).cast("long")
    for i, level in enumerate(LEVELS, 1):
        score = F.when(column == level, F.lit(i).cast("long")).otherwise(score)
    return score


def count_levels(column: Column, levels: tuple[str, ...], times: Column | None = None) -> Column:
    """An aggregate: how many rows have one of ``levels``, each counted ``times``."""
    return F.count_if(column.isin(*levels)) if times is None else F.sum(F.when(column.isin(*levels), times).otherwise(0))
