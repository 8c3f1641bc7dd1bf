"""Whole input rows that travel beside an operator's own columns, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def others(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct ``row``."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")


def whole(docs: DataFrame, text_col: str) -> Column:
    """The row again as a struct ``row``, with its text from the column ``text``, in the order of the input."""
    return F.struct(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns)).alias("row")
