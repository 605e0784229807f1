"""Rounding helpers shared by the operators and the checked queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(column: Column | str, digits: int) -> Column:
    """Round exact ties to the even neighbour."""
    return F.bround(column, digits)


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns half up, keeping the column order."""
    return df.select(
        *[
            F.round(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
