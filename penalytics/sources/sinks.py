"""Parquet sink for derived tables (the reference has none; SURVEY §2.1).

Writing the cleaned table partitioned by state makes later state filters
prune whole folders at the scan (``PartitionFilters`` in the plan).  Paths
are expected under the shared folder (``session.shared_path``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                row_key: list[str] | None = None, mode: str = "overwrite") -> str:
    """Write parquet, optionally partitioned into folders.

    With ``row_key``, rows are range-partitioned on (partition columns, row
    key) first, so each task writes one contiguous slice and few files per
    folder, and a hot partition value (say one state with a third of all rows)
    is still split over many tasks.  Without it, tasks write as they are (no
    shuffle; more, smaller files).
    """
    if partition_by and row_key:
        df = df.repartitionByRange(*partition_by, *row_key)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
