"""Text -> number coercion with "bad text becomes missing" semantics.

Spark 4 runs with ANSI mode on, so a plain ``cast`` of bad text throws, and
``try_cast`` accepts forms a lenient numeric parser rejects (``'1.5d'``).  We
therefore guard ``try_cast`` with a strict numeric pattern.  NaN is normalised
to NULL once, here, so later comparisons never see NaN (in Spark ``NaN > 1``
is true).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-value tokens a CSV reader treats as NA by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"^[+-]?(inf|infinity)$"


def na_token_to_null(c: Column) -> Column:
    """String column with the NA tokens (after trimming) replaced by NULL."""
    return F.when(F.trim(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Coerce a string column to double; anything that is not a number -> NULL.

    Accepted: optional sign, digits with optional fraction, optional exponent,
    surrounding blanks, and ``inf``/``infinity``.  Rejected (NULL): thousands
    separators, type suffixes, words, NaN.
    """
    if dtype is not None and isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    s = F.trim(c)
    lowered = F.lower(s)
    return (F.when(s.rlike(_NUMBER), s.try_cast("double"))
             .when(lowered.rlike(_INFINITY),
                   F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
             .otherwise(F.lit(None).cast("double")))
