"""Predicates used by answer rules, over typed columns and over parsed (variant) answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_int(value: Column) -> Column:
    """Whole number, but not a boolean."""
    return variant_type(value) == "BIGINT"


def is_positive_int(value: Column) -> Column:
    return is_int(value) & F.coalesce(F.try_variant_get(value, "$", "double") > 0, F.lit(False))


def is_bool(value: Column) -> Column:
    return variant_type(value) == "BOOLEAN"


def is_string(value: Column) -> Column:
    return variant_type(value) == "STRING"


def is_dict(value: Column) -> Column:
    return variant_type(value).startswith("OBJECT")


def is_finite_number(value: Column) -> Column:
    numeric = variant_type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return numeric & F.coalesce(
        F.abs(F.try_variant_get(value, "$", "double")) < float("inf"), F.lit(False)
    )


def is_positive_finite_number(value: Column) -> Column:
    return is_finite_number(value) & F.coalesce(
        F.try_variant_get(value, "$", "double") > 0, F.lit(False)
    )


def is_list(value: Column) -> Column:
    return variant_type(value).startswith("ARRAY")


def is_finite_number_list(value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return is_list(value) & F.coalesce(F.forall(items, is_finite_number), F.lit(False))


def is_int_list(value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return is_list(value) & F.coalesce(F.forall(items, is_int), F.lit(False))


def finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def positive_finite(value: Column) -> Column:
    return finite(value) & (value > 0)


def number_or_none_in_range(text: Column, low: float, high: float) -> Column:
    """True for a missing value or the text null; otherwise a finite number within the range."""
    cleaned = F.trim(text)
    number = cleaned.try_cast("double")
    return F.when(text.isNull() | (F.lower(cleaned) == "null"), True).otherwise(
        finite(number) & F.coalesce(number.between(low, high), F.lit(False))
    )


def numbers_close(
    a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0
) -> Column:
    """Difference within the relative tolerance of the larger value or the absolute one."""
    allowed = F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return finite(a) & finite(b) & F.coalesce(F.abs(a - b) <= allowed, F.lit(False))


def slice_range_matches(
    text: Column, start: Column, end: Column, expected_start: int, expected_end: int
) -> Column:
    """Explicit start and end, or the first two numbers of a range text, equal the expected."""
    explicit = F.coalesce((start == expected_start) & (end == expected_end), F.lit(False))
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    from_text = (F.get(numbers, F.lit(0)).try_cast("bigint") == expected_start) & (
        F.get(numbers, F.lit(1)).try_cast("bigint") == expected_end
    )
    return explicit | F.coalesce(from_text, F.lit(False))
