"""Deterministic scored tables derived from the cleaned HRRP view (FIXTURES F5).

Predictions and probabilities come from key arithmetic, so every metric over
them has a plain-SQL oracle.  Six models per row; model k is right on a
(3 + k)/10 share of rows; probabilities take 50 levels per class (ties).
The model fan-out is a literal array exploded per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clean import LABEL, MEASURE
from ..operators.metrics import MODEL_NAMES
from .dimensions import BENCHMARK_RATES


def measure_number(c: Column) -> Column:
    """1..6 in the benchmark table's order."""
    expr = None
    for i, (name, _) in enumerate(BENCHMARK_RATES, start=1):
        expr = F.when(c == name, F.lit(i)) if expr is None else expr.when(c == name, F.lit(i))
    return expr


def row_id(df: DataFrame) -> Column:
    return F.col("facility_id").cast("bigint") * 10 + measure_number(F.col(MEASURE))


def votes(cleaned: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(n).alias("model"))
                       for i, (n, _) in enumerate(MODEL_NAMES, start=1)])
    base = cleaned.select(row_id(cleaned).alias("row_id"), F.col(LABEL).alias("label"),
                          F.inline(models))
    rid, k = F.col("row_id"), F.col("model_no")
    correct = (rid * 31 + k * 7) % 10 < (3 + k)
    pred = F.when(correct, F.col("label")).otherwise(1 - F.col("label"))
    lvl = ((rid * 13 + k * 5) % 50) / F.lit(100.0)
    prob = F.when(pred == 1, F.lit(0.5) + lvl).otherwise(lvl)
    return base.select(
        "row_id", "model", "label", pred.cast("int").alias("prediction"), prob.alias("probability"),
        F.when(rid % 5 == 0, "test").otherwise("train").alias("split"),
        (F.floor(rid / 5) % 5).cast("int").alias("fold"))


VOTES_SQL = """
vt_base AS (
  SELECT cast(facility_id AS bigint) * 10 + (CASE measure_name
            WHEN 'Heart Failure (HF)' THEN 1 WHEN 'Acute Myocardial Infarction (AMI)' THEN 2
            WHEN 'Pneumonia (PN)' THEN 3 WHEN 'COPD' THEN 4 WHEN 'Hip/Knee Arthroplasty' THEN 5
            WHEN 'CABG' THEN 6 END) AS row_id,
         is_penalized AS label
  FROM hrrp_clean),
vt_models AS (SELECT * FROM (VALUES (1, 'Logistic Regression'), (2, 'Decision Tree'),
    (3, 'Support Vector Machine'), (4, 'Random Forest'), (5, 'Gradient Boosting'),
    (6, 'Neural Network (MLP)')) AS m(model_no, model)),
vt_pred AS (
  SELECT row_id, model, label,
         cast(CASE WHEN (row_id * 31 + model_no * 7) % 10 < 3 + model_no THEN label ELSE 1 - label END AS integer)
           AS prediction,
         ((row_id * 13 + model_no * 5) % 50) / 100.0e0 AS lvl,
         CASE WHEN row_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         cast((row_id // 5) % 5 AS integer) AS fold
  FROM vt_base, vt_models),
votes AS (
  SELECT row_id, model, label, prediction,
         CASE WHEN prediction = 1 THEN 0.5e0 + lvl ELSE lvl END AS probability, split, fold
  FROM vt_pred)"""
