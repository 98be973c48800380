"""Structured Streaming scoring.

Requests arrive as Parquet files in a folder; the stream applies the same
column expressions as the batch path (rules) or a saved ``PipelineModel``
(models) and writes Parquet with a checkpoint, so a restarted query resumes
exactly where it stopped.  Both paths are stateless: each micro-batch is
scored on its own, so the stream scales with the executors like the batch job.

All folders live under the shared checkpoint folder (``spark.checkpoint.dir``);
``run_available`` processes whatever is present (``availableNow``) and stops.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators.models import positive_probability
from ..operators.clean import DISCHARGES, EXPECTED, LABEL, MEASURE, PREDICTED, READMISSIONS, STATE
from ..session import shared_path

REQUEST_SCHEMA = (f"request_id long, {STATE} string, {MEASURE} string, {DISCHARGES} double, "
                  f"{PREDICTED} double, {EXPECTED} double, {READMISSIONS} double")


def scoring_requests(cleaned: DataFrame, row_key) -> DataFrame:
    """one request per cleaned row, plus hand-written boundary rows."""
    spark = cleaned.sparkSession
    base = cleaned.select(row_key.alias("request_id"), STATE, MEASURE, DISCHARGES, PREDICTED,
                          EXPECTED, READMISSIONS)
    edge = spark.createDataFrame(BOUNDARY_REQUESTS, REQUEST_SCHEMA)
    return base.unionByName(edge)


# Boundary cases (negative ids never collide with row ids): expected 0;
# discharges 0/25/100/1000; ratio exactly 1.0/1.05/1.1; readm share 0.15/0.18;
# gap -1/1/3/6; each input NULL in turn.
BOUNDARY_REQUESTS = [
    (-1, "AL", "COPD", 500.0, 16.0, 0.0, 50.0),
    (-2, "AL", "COPD", 0.0, 16.0, 16.0, 0.0),
    (-3, "AL", "COPD", 25.0, 16.0, 16.0, 4.0),
    (-4, "AL", "COPD", 100.0, 16.0, 16.0, 15.0),
    (-5, "AL", "COPD", 1000.0, 16.0, 16.0, 150.0),
    (-6, "AK", "Heart Failure (HF)", 400.0, 21.0, 20.0, 72.0),
    (-7, "AK", "Heart Failure (HF)", 400.0, 22.0, 20.0, 60.0),
    (-8, "AK", "Acute Myocardial Infarction (AMI)", 400.0, 15.0, 16.0, 60.0),
    (-9, "AK", "Pneumonia (PN)", 400.0, 17.0, 16.0, 60.0),
    (-10, "AK", "Pneumonia (PN)", 400.0, 19.0, 16.0, 60.0),
    (-11, "AK", "Pneumonia (PN)", 400.0, 22.0, 16.0, 60.0),
    (-12, None, "CABG", 400.0, 16.0, 16.0, 60.0),
    (-13, "AZ", None, 400.0, 16.0, 16.0, 60.0),
    (-14, "AZ", "CABG", None, 16.0, 16.0, 60.0),
    (-15, "AZ", "CABG", 400.0, None, 16.0, 60.0),
    (-16, "AZ", "CABG", 400.0, 16.0, None, 60.0),
    (-17, "AZ", "CABG", 400.0, 16.0, 16.0, None),
    (-18, "ZZ", "Unknown condition", 400.0, 16.0, 16.0, 60.0),
]


def write_request_files(requests: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> str:
    """the requests as Parquet files.  Their number follows the data: each task of the
    input writes its own files, of at most ``rows_per_file`` rows, and nothing is shuffled."""
    requests.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return folder


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(REQUEST_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def rule_scores(df: DataFrame) -> DataFrame:
    """L2: the batch rule operators, unchanged, on a (streaming) frame of requests."""
    st = R.staged(df, ["request_id"])
    p, e, r, d = F.col(PREDICTED), F.col(EXPECTED), F.col(READMISSIONS), F.col(DISCHARGES)
    score = F.col("_s")
    return st.select(
        "request_id",
        score.alias("risk_score"),
        R.payment_impact(d, score).alias("payment_impact"),
        R.severity_band(score).alias("severity"),
        R.risk_index_from(F.col("_rg")).alias("risk_index"),
        R.exposure_a_from(F.col("_rg"), d)[1].alias("exposure_a"),
        R.exposure_b_from(F.col("_ru"), d).alias("exposure_b"),
        R.gap_tier(p, e).alias("gap_tier"),
        R.ratio_tier_from(F.col("_ru")).alias("ratio_tier"),
        F.size(R.drivers_v1(p, e, r, d)).alias("n_drivers_v1"),
        F.size(R.drivers_v2(p, e, r, d)).alias("n_drivers_v2"))


def model_scores(df: DataFrame, model: PipelineModel, name: str, report: bool = False) -> DataFrame:
    """L1: a saved pipeline applied to a (streaming) frame of requests.

    ``report`` adds the probability's band and confidence and the threshold flag (R13, R16, R17).
    """
    out = model.transform(df.withColumn(LABEL, F.lit(None).cast("int")))
    keep = ["request_id", F.lit(name).alias("model"), F.col("prediction").cast("int").alias("prediction")]
    p = positive_probability(out).alias("probability")
    if not report:
        return out.select(*keep, p)
    ratio = R.ratio_guarded(F.col(PREDICTED), F.col(EXPECTED)).alias("excess_ratio")
    return R.probability_report(out.select(*keep, p, ratio), ["request_id", "model", "prediction", "excess_ratio"],
                                "probability", F.col("excess_ratio"))


def run_available(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write the stream to Parquet (checkpointed) until the input is drained,
    then return the written table as a batch DataFrame."""
    out = shared_path(spark, f"{name}-out")
    ckpt = shared_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
