"""Scalar column helpers.  All are JVM expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den when den > 0, else 0; NULL when either input is NULL."""
    return (F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
             .when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))).otherwise(F.lit(0.0)))


def safe_divide(num: Column, den: Column) -> Column:
    """Unguarded ratio that yields NULL (not an error) on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def round_half_even(c: Column, scale: int = 2) -> Column:
    return F.bround(c, scale)


def is_priority_condition(condition: Column) -> Column:
    """Case-sensitive substring test for the heart-failure / heart-attack codes."""
    return condition.contains("HF") | condition.contains("AMI")


def prefix(c: Column, n: int = 25) -> Column:
    return F.substring(c, 1, n)


def fixed(c: Column, decimals: int) -> Column:
    """Python ``f"{x:.Nf}"`` text: ``format_number`` rounds half-even on the
    exact binary value (as Python and C printf do); its grouping commas are
    removed.  ``format_string`` would round half-up on the decimal digits."""
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def money(c: Column) -> Column:
    """``$1,234`` text: comma grouping, no decimals, half-even."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def percent(c: Column, decimals: int = 1) -> Column:
    """Fraction -> ``12.3%`` text."""
    return F.concat(fixed(c * 100, decimals), F.lit("%"))


def binary_label(c: Column, positive: str = "PENALIZED", negative: str = "NOT PENALIZED") -> Column:
    return F.when(c == 1, positive).when(c == 0, negative)
