"""Literal dimension tables.  Both have a fixed, small row
count, so broadcasting them is safe at any data size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# State / territory code -> full name (56 entries).
STATE_NAMES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"), ("CA", "California"),
    ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"), ("FL", "Florida"), ("GA", "Georgia"),
    ("HI", "Hawaii"), ("ID", "Idaho"), ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"),
    ("KS", "Kansas"), ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"), ("MO", "Missouri"),
    ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"), ("NH", "New Hampshire"), ("NJ", "New Jersey"),
    ("NM", "New Mexico"), ("NY", "New York"), ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"),
    ("OK", "Oklahoma"), ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"), ("VT", "Vermont"),
    ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"), ("WI", "Wisconsin"), ("WY", "Wyoming"),
    ("DC", "District of Columbia"), ("PR", "Puerto Rico"), ("VI", "Virgin Islands"),
    ("GU", "Guam"), ("AS", "American Samoa"), ("MP", "Northern Mariana Islands"),
]

# Condition -> benchmark penalty rate (%).
BENCHMARK_RATES = [
    ("Heart Failure (HF)", 32.5),
    ("Acute Myocardial Infarction (AMI)", 28.1),
    ("Pneumonia (PN)", 24.7),
    ("COPD", 22.3),
    ("Hip/Knee Arthroplasty", 18.9),
    ("CABG", 15.4),
]


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """An inline relation: its size is in the plan, and joins broadcast it by themselves."""
    def text(v) -> str:
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D"

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def state_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, STATE_NAMES, "code, name")


def benchmark_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, BENCHMARK_RATES, "measure_name, benchmark_penalty_rate")
