"""Coercion, row filters, labelling and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import to_number
from ..functions.scalar import safe_divide

DISCHARGES = "number_of_discharges"
RATIO = "excess_readmission_ratio"
PREDICTED = "predicted_readmission_rate"
EXPECTED = "expected_readmission_rate"
READMISSIONS = "number_of_readmissions"
STATE = "state"
MEASURE = "measure_name"
LABEL = "is_penalized"

NUMERIC_COLUMNS = [DISCHARGES, RATIO, PREDICTED, EXPECTED, READMISSIONS]
# Identity and bookkeeping columns that never reach a model.
NON_MODEL_COLUMNS = ["facility_id", "facility_name", RATIO, "footnote", "start_date", "end_date"]
FEATURE_COLUMNS = [STATE, MEASURE, DISCHARGES, PREDICTED, EXPECTED, READMISSIONS]


def coerce_numeric(df: DataFrame, columns: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Numeric coercion of the columns that exist; bad text -> NULL."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select(*[
        to_number(F.col(c), types[c]).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P2 (subset) / P3 (all columns, the strict variant)."""
    return df.na.drop(how="any", subset=subset)


def add_label(df: DataFrame, threshold: float = 1.0, ratio: str = RATIO) -> DataFrame:
    """1 when the ratio is strictly above ``threshold``."""
    return df.withColumn(LABEL, (F.col(ratio) > F.lit(threshold)).cast("int"))


def drop_if_present(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*[n for n in names if n in df.columns])


def clean(raw: DataFrame, threshold: float = 1.0) -> DataFrame:
    """coerce -> drop rows without a ratio -> label."""
    return add_label(drop_missing(coerce_numeric(raw), [RATIO]), threshold)


def clean_strict(raw: DataFrame, threshold: float = 1.0) -> DataFrame:
    """P3 variant: drop rows with ANY missing column (footnote and dates included)."""
    return add_label(drop_missing(coerce_numeric(raw)), threshold)


def model_frame(cleaned: DataFrame) -> DataFrame:
    """Columns a model sees: features + label."""
    return drop_if_present(cleaned, NON_MODEL_COLUMNS)


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """P8: 'number' -> numeric columns, 'object' -> string columns, schema order."""
    want = T.NumericType if kind == "number" else T.StringType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, want)]


def derived_ratio(df: DataFrame) -> DataFrame:
    """Predicted / expected, NULL on a zero or missing denominator."""
    return df.withColumn("derived_ratio", safe_divide(F.col(PREDICTED), F.col(EXPECTED)))


def default_inputs(cleaned: DataFrame, key: str = "facility_id") -> DataFrame:
    """The state and condition of the first row, 'first' = smallest key.

    ``min_by`` is an ordinary partial/final aggregate: one small struct per task.
    """
    first = F.min_by(F.struct(F.col(STATE), F.col(MEASURE)), F.struct(F.col(key), F.col(MEASURE)))
    return cleaned.agg(first.alias("d")).select(
        F.col("d.state").alias("default_state"), F.col("d.measure_name").alias("default_measure_name"))
