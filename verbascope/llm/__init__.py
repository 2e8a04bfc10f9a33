"""Operators of a training-data pipeline.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
