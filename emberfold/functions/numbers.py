"""Coercion and rounding of numbers, and confidence weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal text; hexadecimal, binary and named numbers are not read.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num_or_null(x: Column) -> Column:
    """Text to double; null for anything that is not a finite decimal number."""
    text = x.cast("string")
    value = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_num(x: Column) -> Column:
    """As num_or_null, but null is 0."""
    return F.when(x.isNull(), F.lit(0.0)).otherwise(num_or_null(x))


def str_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def clamp(x: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def round_up(x: Column, digits: int = 2) -> Column:
    """Half up towards plus infinity."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def confidence_weight(x: Column) -> Column:
    """1, 0.75 and 0.45 for high, nominal and low; a number by hundredths; 0 for null and empty; 0.6 for other text."""
    s = F.lower(x.cast("string"))
    n = num_or_null(x)
    return (
        F.when(s.isin("high", "h"), 1.0)
        .when(s.isin("nominal", "n"), 0.75)
        .when(s.isin("low", "l"), 0.45)
        .when(s.isNull() | (F.trim(s) == ""), 0.0)
        .when(n.isNotNull(), clamp(n / 100, 0.0, 1.0))
        .otherwise(0.6)
    )
