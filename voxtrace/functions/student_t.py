"""Student t quantiles as a column, without a statistics library on the executors."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_SIZE = 40


def _cdf(t: float, df: int) -> float:
    """Closed form of the t distribution for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    sine, cosine = math.sin(theta), math.cos(theta)
    if df % 2:
        term, series = cosine, (cosine if df > 1 else 0.0)
        for k in range(3, df - 1, 2):
            term *= cosine * cosine * (k - 1) / k
            series += term
        area = 2 / math.pi * (theta + sine * series)
    else:
        term = series = 1.0
        for k in range(2, df - 1, 2):
            term *= cosine * cosine * (k - 1) / k
            series += term
        area = sine * series
    return 0.5 + area / 2


def t_quantile(probability: float, df: int) -> float:
    """Quantile above one half, by bisection on the closed form."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        if _cdf(middle, df) < probability:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def quantile_table(probability: float) -> list[float]:
    return [t_quantile(probability, df) for df in range(1, TABLE_SIZE + 1)]


def expansion_terms(probability: float) -> tuple[float, list[float]]:
    """Normal quantile and the coefficients of 1/df, 1/df^2, 1/df^3, 1/df^4."""
    z = NormalDist().inv_cdf(probability)
    return z, [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_critical(df: Column, probability: float = 0.975) -> Column:
    """Exact values up to TABLE_SIZE degrees of freedom, then the series in 1/df."""
    table = F.array(*[F.lit(q) for q in quantile_table(probability)])
    z, terms = expansion_terms(probability)
    series = F.lit(z)
    for power, coefficient in enumerate(terms, start=1):
        series = series + F.lit(coefficient) / F.pow(df.cast("double"), F.lit(power))
    return F.when(df < 1, F.lit(None).cast("double")).otherwise(
        F.when(df <= TABLE_SIZE, F.get(table, df.cast("int") - 1)).otherwise(series)
    )


def t_critical_sql(df: str, probability: float = 0.975) -> str:
    """The same formula as SQL text."""
    table = ", ".join(repr(q) for q in quantile_table(probability))
    z, terms = expansion_terms(probability)
    series = repr(z) + "".join(
        f" + {c!r} / pow(({df})::DOUBLE, {p})" for p, c in enumerate(terms, start=1)
    )
    return (
        f"CASE WHEN ({df}) < 1 THEN NULL WHEN ({df}) <= {TABLE_SIZE} "
        f"THEN list_extract([{table}], ({df})::INTEGER) ELSE {series} END"
    )


def mean_half_width(n: Column, std: Column, probability: float = 0.975) -> Column:
    """Half-width of the confidence interval of a mean, 4 decimals, 0 below two values."""
    width = t_critical(n - 1, probability) * std / F.sqrt(n.cast("double"))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.round(width, 4))


def mean_half_width_sql(n: str, std: str) -> str:
    return (
        f"CASE WHEN ({n}) < 2 THEN 0.0::DOUBLE ELSE "
        f"round(({t_critical_sql(f'({n}) - 1')}) * ({std}) / sqrt(({n})::DOUBLE), 4) END"
    )
