"""CSV source for the hospital table.

* S1: header CSV read with an explicit all-string schema: no inference job,
  leading zeros in ids survive, coercion happens later (P1).
* S2: a missing file gives a message and ``None`` instead of an exception;
  callers stop.
* S3: the NA spellings a CSV reader treats as missing become NULL in every
  string column (the Spark CSV reader accepts only one ``nullValue``).
* S4: ``persist=True`` keeps the loaded frame (memory, spilling to disk) for
  repeated use; lost blocks are recomputed from the file.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import na_token_to_null
from .fixture import RAW_COLUMNS

log = logging.getLogger(__name__)

# Column headers of the published CSV, in file order, and our snake_case names.
CSV_HEADERS = [
    ("Facility Name", "facility_name"), ("Facility ID", "facility_id"), ("State", "state"),
    ("Measure Name", "measure_name"), ("Number of Discharges", "number_of_discharges"),
    ("Footnote", "footnote"), ("Excess Readmission Ratio", "excess_readmission_ratio"),
    ("Predicted Readmission Rate", "predicted_readmission_rate"),
    ("Expected Readmission Rate", "expected_readmission_rate"),
    ("Number of Readmissions", "number_of_readmissions"), ("Start Date", "start_date"),
    ("End Date", "end_date"),
]


def _schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def load_hrrp_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                  persist: bool = False) -> DataFrame | None:
    """Read the table; ``columns`` are the file's header names in order
    (default: our snake_case names).  Returns None when the path is missing."""
    columns = columns or RAW_COLUMNS
    try:
        df = (spark.read.schema(_schema(columns)).option("header", True).option("mode", "PERMISSIVE")
              .option("multiLine", False).csv(path))
        df.schema  # resolve now so a missing path surfaces here
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.error("CSV file not found: %s", path)
            return None
        raise
    out = df.select(*[na_token_to_null(F.col(c)).alias(c) for c in columns])
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def rename_published_headers(df: DataFrame) -> DataFrame:
    """Published header names -> snake_case (absent columns are ignored)."""
    mapping = dict(CSV_HEADERS)
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV (one folder of part files), e.g. to exchange the raw table."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
