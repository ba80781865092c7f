"""Column functions over several cells of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import is_missing, python_text


def collect_values(df: DataFrame, names: list[str]) -> Column:
    """The cells of the named columns in that order, as text; empty text for missing ones."""
    cells = [F.when(is_missing(df, n), F.lit("")).otherwise(python_text(df, n)) for n in names]
    return F.array(*cells) if cells else F.array().cast("array<string>")
