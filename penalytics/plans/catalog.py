"""Registered queries, one per operator group of SURVEY §2.

Every query starts from the raw test tables (via the fixture view), so its
work grows with them.  Column names match the oracle SQL exactly.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import explore as X
from ..operators import ordered as O
from ..operators import peers as PE
from ..operators import profile as PR
from ..operators import rules as R
from ..operators import sketches as SK
from . import rules_sql as RS
from . import metrics_sql as MS
from ..operators import metrics as M
from ..operators import features as FE
from ..operators import importance as IM
from ..operators import shapley as SH
from ..operators import models as MD
from ..session import delete_path, shared_path
from ..sources.votes import row_id as make_row_id
from ..streaming import once as SO
from ..streaming import scoring as ST
from ..streaming import windowed as SW
from ..sources.votes import votes as make_votes
from ..sources.dimensions import BENCHMARK_RATES, STATE_NAMES, benchmark_dim, state_dim
from ..sources.fixture import RAW_COLUMNS
from ..sources import csv_loader as CSV
from ..sources.fixture import hrrp_raw
from ..sources.observations import observations
from .oracle import union_all, with_fixture
from .registry import register


# S4 cached load.  A query that reads the view once takes the pruned lineage (``raw``,
# ``cleaned``): its columns alone reach the scans.  A query that reads it several times,
# and a fit, take ``loaded``: the cleaned columns, written once to the shared folder.  Its
# readers prune columns there, their plans start at a scan and not at the whole lineage,
# and a lost executor loses nothing.  ``drop_cached_views`` deletes them; results that
# read them lazily must be used before that.
_VIEWS: dict = {}


def _app(spark: SparkSession):
    """Cache scope: the application (falls back to the session object)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a driver-side context
        return id(spark)


def _kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (_app(spark), sf_dir, name)
    if key not in _VIEWS:
        df, path = build(), shared_path(spark, f"view-{name}")
        # files of bounded rows: a file that is small in bytes would be one task for its readers
        df.write.option("maxRecordsPerFile", MD.FIT_ROWS).parquet(path)
        _VIEWS[key] = (path, spark.read.schema(df.schema).parquet(path))
    return _VIEWS[key][1]


def drop_cached_views() -> None:
    """Delete every kept view, and forget fitted models and scored tables."""
    for path, kept in _VIEWS.values():
        delete_path(kept.sparkSession, path)
    _VIEWS.clear()
    drop_models()


def drop_models() -> None:
    """Forget the fitted models, their scored tables and CV results; the views stay."""
    for kept in _SCORED.values():
        kept.unpersist()
    for cache in (_SCORED, _FITTED, _CV):
        cache.clear()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hrrp_raw(spark, sf_dir)


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 without the columns that no analysis reads, kept."""
    return _kept(spark, sf_dir, "clean", lambda: C.clean(raw(spark, sf_dir)).drop("facility_name", "footnote", "start_date", "end_date"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 as a pruned lineage."""
    return C.clean(raw(spark, sf_dir))


def modeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.model_frame(loaded(spark, sf_dir))


# ---------------------------------------------------------------- sources / cleaning

@register("hrrp_raw_view", with_fixture("SELECT * FROM hrrp_raw"), ids=("S1", "F1"))
def q_hrrp_raw(spark, sf_dir):
    return raw(spark, sf_dir)


@register("hrrp_clean_view", with_fixture("SELECT * FROM hrrp_clean"), ids=("P1", "P2", "P4"))
def q_hrrp_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


# ---------------------------------------------------------------- exploration

@register("state_penalty_top15", with_fixture("""
SELECT state, cast(count(*) AS bigint) AS n_rows, cast(sum(is_penalized) AS bigint) AS n_penalized,
       100.0e0 * sum(is_penalized) / count(*) AS penalty_rate_pct
FROM hrrp_model GROUP BY state
ORDER BY penalty_rate_pct DESC, state ASC LIMIT 15"""), ids=("A10", "T1"), headline=True)
def q_state_penalty_top15(spark, sf_dir):
    return X.penalty_rate_by(C.model_frame(cleaned(spark, sf_dir)), C.STATE, top=15)


@register("hrrp_clean_strict", with_fixture("""
SELECT * FROM (SELECT *, cast(excess_readmission_ratio > 1 AS integer) AS is_penalized FROM hrrp_num)
WHERE facility_id IS NOT NULL AND facility_name IS NOT NULL AND state IS NOT NULL AND measure_name IS NOT NULL
  AND number_of_discharges IS NOT NULL AND footnote IS NOT NULL AND excess_readmission_ratio IS NOT NULL
  AND predicted_readmission_rate IS NOT NULL AND expected_readmission_rate IS NOT NULL
  AND number_of_readmissions IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL"""), ids=("P3",))
def q_hrrp_clean_strict(spark, sf_dir):
    return C.clean_strict(raw(spark, sf_dir))


@register("label_threshold_105", with_fixture("""
SELECT facility_id, measure_name, excess_readmission_ratio,
       cast(excess_readmission_ratio > 1.05 AS integer) AS is_penalized
FROM hrrp_num WHERE excess_readmission_ratio IS NOT NULL"""), ids=("P5",))
def q_label_threshold_105(spark, sf_dir):
    df = C.clean(raw(spark, sf_dir), threshold=1.05)
    return df.select("facility_id", "measure_name", C.RATIO, C.LABEL)


@register("model_frame", with_fixture("SELECT * FROM hrrp_model"), ids=("P6", "P7", "P11"))
def q_model_frame(spark, sf_dir):
    return modeled(spark, sf_dir)


@register("derived_ratio", with_fixture("""
SELECT facility_id, measure_name,
       CASE WHEN expected_readmission_rate = 0 THEN NULL
            ELSE predicted_readmission_rate / expected_readmission_rate END AS derived_ratio
FROM hrrp_clean"""), ids=("P12",))
def q_derived_ratio(spark, sf_dir):
    return C.derived_ratio(loaded(spark, sf_dir)).select("facility_id", "measure_name", "derived_ratio")


@register("default_inputs", with_fixture("""
SELECT arg_min(state, facility_id || '|' || measure_name) AS default_state,
       arg_min(measure_name, facility_id || '|' || measure_name) AS default_measure_name
FROM hrrp_clean"""), ids=("P13",))
def q_default_inputs(spark, sf_dir):
    return C.default_inputs(loaded(spark, sf_dir))


@register("penalized_rows", with_fixture("""
SELECT facility_id, measure_name, state FROM hrrp_clean WHERE is_penalized = 1"""), ids=("P10",))
def q_penalized_rows(spark, sf_dir):
    return cleaned(spark, sf_dir).where(F.col(C.LABEL) == 1).select("facility_id", C.MEASURE, C.STATE)


# ---------------------------------------------------------------- profiling

MODEL_COLUMNS = [C.STATE, C.MEASURE, C.DISCHARGES, C.PREDICTED, C.EXPECTED, C.READMISSIONS, C.LABEL]
MODEL_TYPES = ["string", "string", "double", "double", "double", "double", "int"]
MODEL_NUMERIC = [C.DISCHARGES, C.PREDICTED, C.EXPECTED, C.READMISSIONS, C.LABEL]
CLEAN_NUMERIC = [C.DISCHARGES, C.RATIO, C.PREDICTED, C.EXPECTED, C.READMISSIONS, C.LABEL]
BOX_COLUMNS = [C.DISCHARGES, C.PREDICTED, C.EXPECTED, C.READMISSIONS]


@register("dataset_stats", with_fixture("""
SELECT cast(count(*) AS bigint) AS n_rows, cast(12 AS bigint) AS n_columns,
       cast(count(DISTINCT facility_name) AS bigint) AS n_hospitals,
       cast(count(DISTINCT state) AS bigint) AS n_states,
       cast(count(DISTINCT measure_name) AS bigint) AS n_conditions
FROM hrrp_raw"""), ids=("A1", "A2", "S7"))
def q_dataset_stats(spark, sf_dir):
    return PR.dataset_stats(raw(spark, sf_dir))


# Written out for the oracle; not taken from the operators.
_NA_SQL = """'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA',
'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"""
_MISSING_RAW = union_all([f"""
SELECT '{c}' AS column_name, cast({i} AS integer) AS position, 'string' AS data_type,
       cast(sum(CASE WHEN {c} IS NULL OR trim({c}) IN ({_NA_SQL}) THEN 1 ELSE 0 END) AS bigint) AS missing_count,
       100.0e0 * sum(CASE WHEN {c} IS NULL OR trim({c}) IN ({_NA_SQL}) THEN 1 ELSE 0 END) / count(*) AS missing_pct,
       round_even(100.0e0 * sum(CASE WHEN {c} IS NULL OR trim({c}) IN ({_NA_SQL}) THEN 1 ELSE 0 END) / count(*), 2)
         AS missing_pct_2dp
FROM hrrp_raw""" for i, c in enumerate(RAW_COLUMNS)])


@register("missing_profile", with_fixture(_MISSING_RAW), ids=("A3", "S3", "S7", "F3"))
def q_missing_profile(spark, sf_dir):
    return PR.missing_profile(raw(spark, sf_dir))


_MISSING_MODEL = union_all([f"""
SELECT '{c}' AS column_name, cast({i} AS integer) AS position, '{t}' AS data_type,
       cast(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing_count,
       100.0e0 * sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*) AS missing_pct,
       round_even(100.0e0 * sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*), 2) AS missing_pct_2dp
FROM hrrp_model""" for i, (c, t) in enumerate(zip(MODEL_COLUMNS, MODEL_TYPES))])


@register("missing_top10", with_fixture(f"""
SELECT * FROM ({_MISSING_MODEL}) m ORDER BY missing_count DESC, column_name ASC LIMIT 10"""),
          ids=("A4", "T3"))
def q_missing_top10(spark, sf_dir):
    return PR.missing_top(modeled(spark, sf_dir), 10)


@register("missing_any", with_fixture(f"""
SELECT max(missing_count) > 0 AS any_missing,
       cast(sum(CASE WHEN missing_count > 0 THEN 1 ELSE 0 END) AS bigint) AS n_columns_missing
FROM ({_MISSING_MODEL}) m"""), ids=("A5",))
def q_missing_any(spark, sf_dir):
    return PR.any_missing(modeled(spark, sf_dir))


_ROLLED = union_all([f"""
SELECT {"state" if "state" in kept else "cast(NULL AS varchar) AS state"},
       {"measure_name" if "measure_name" in kept else "cast(NULL AS varchar) AS measure_name"}, '{c}' AS column_name,
       cast(count({c}) AS bigint) AS n_rows, cast(count(DISTINCT {c}) AS bigint) AS n_distinct, '{",".join(kept)}' AS level
FROM hrrp_raw GROUP BY {", ".join(kept) or "()"}""" for kept in (["state", "measure_name"], ["state"], ["measure_name"], [])
                     for c in ("facility_id", "facility_name")])


@register("distinct_rollups", with_fixture(_ROLLED), ids=("A2",))
def q_distinct_rollups(spark, sf_dir):
    """Sketches are stored once per state and condition; four levels are answered from them."""
    path = shared_path(spark, "sketches")
    groups, columns = [C.STATE, C.MEASURE], ["facility_id", "facility_name"]
    SK.distinct_sketches(raw(spark, sf_dir), groups, columns).write.parquet(path)
    return SK.roll_up(spark.read.parquet(path), [groups, [C.STATE], [C.MEASURE], []], groups)


_DESCRIBE = union_all([f"""
SELECT '{c}' AS column_name, cast(count({c}) AS bigint) AS count, avg({c}) AS mean,
       stddev_samp({c}) AS std, cast(min({c}) AS double) AS min,
       quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, cast(max({c}) AS double) AS max
FROM hrrp_clean""" for c in CLEAN_NUMERIC])


@register("describe_numeric", with_fixture(_DESCRIBE), ids=("A6", "P8"))
def q_describe_numeric(spark, sf_dir):
    return PR.describe(loaded(spark, sf_dir), CLEAN_NUMERIC)


def _corr_sql(cols):
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                expr = f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0e0 END"
            else:
                expr = f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expr} AS corr FROM hrrp_model")
    return union_all(parts)


@register("correlation_matrix", with_fixture(_corr_sql(MODEL_NUMERIC)), ids=("A7", "P8"))
def q_correlation_matrix(spark, sf_dir):
    return PR.correlation_long(modeled(spark, sf_dir), MODEL_NUMERIC)


@register("preview_rows", with_fixture("""
SELECT * FROM hrrp_raw ORDER BY facility_id, measure_name LIMIT 10"""), ids=("S6",))
def q_preview_rows(spark, sf_dir):
    return PR.preview(raw(spark, sf_dir), 10, ["facility_id", "measure_name"])


_BOX = union_all([f"""
SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
       quantile_cont({c}, 0.75) AS q3 FROM hrrp_model""" for c in BOX_COLUMNS])
_BOX_LONG = union_all([f"SELECT '{c}' AS column_name, {c} AS value, facility_id, measure_name FROM hrrp_clean WHERE {c} IS NOT NULL"
                       for c in BOX_COLUMNS])
_FENCES = f"""
SELECT column_name, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
       q3 + 1.5 * (q3 - q1) AS upper_fence FROM ({_BOX}) b"""


@register("box_stats", with_fixture(f"""
SELECT f.column_name, q1, median, q3, iqr, lower_fence, upper_fence,
       min(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS whisker_low,
       max(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS whisker_high,
       cast(sum(CASE WHEN value >= lower_fence AND value <= upper_fence THEN 0 ELSE 1 END) AS bigint) AS n_outliers
FROM ({_BOX_LONG}) l JOIN ({_FENCES}) f ON l.column_name = f.column_name
GROUP BY f.column_name, q1, median, q3, iqr, lower_fence, upper_fence"""), ids=("A15", "P9"))
def q_box_stats(spark, sf_dir):
    df = modeled(spark, sf_dir)
    return PR.box_stats(df, PR.numeric_columns(df)[:4])  # P9: the first four numeric columns


@register("box_outliers", with_fixture(f"""
SELECT facility_id, measure_name, l.column_name, value
FROM ({_BOX_LONG}) l JOIN ({_FENCES}) f ON l.column_name = f.column_name
WHERE value < lower_fence OR value > upper_fence"""), ids=("A15",))
def q_box_outliers(spark, sf_dir):
    first_four = PR.numeric_columns(modeled(spark, sf_dir))[:4]
    return PR.box_outliers(loaded(spark, sf_dir), first_four, ["facility_id", "measure_name"])


# ---------------------------------------------------------------- exploration (continued)

@register("label_distribution", with_fixture("""
SELECT is_penalized, cast(count(*) AS bigint) AS n,
       100.0e0 * count(*) / (SELECT count(*) FROM hrrp_model) AS pct
FROM hrrp_model GROUP BY is_penalized"""), ids=("A8",))
def q_label_distribution(spark, sf_dir):
    return X.label_distribution(C.model_frame(cleaned(spark, sf_dir)))


@register("penalty_rate_overall", with_fixture("""
SELECT cast(count(*) AS bigint) AS n_rows, cast(sum(is_penalized) AS bigint) AS n_penalized,
       100.0e0 * sum(is_penalized) / count(*) AS penalty_rate_pct FROM hrrp_model"""), ids=("A9",))
def q_penalty_rate_overall(spark, sf_dir):
    return X.penalty_rate_overall(C.model_frame(cleaned(spark, sf_dir)))


@register("condition_penalty_rate", with_fixture("""
SELECT measure_name, cast(count(*) AS bigint) AS n_rows, cast(sum(is_penalized) AS bigint) AS n_penalized,
       100.0e0 * sum(is_penalized) / count(*) AS penalty_rate_pct
FROM hrrp_model GROUP BY measure_name"""), ids=("A11",))
def q_condition_penalty_rate(spark, sf_dir):
    return X.penalty_rate_by(C.model_frame(cleaned(spark, sf_dir)), C.MEASURE)


_TOP_COND = """
SELECT measure_name, cast(count(*) AS bigint) AS n_penalized FROM hrrp_model WHERE is_penalized = 1
GROUP BY measure_name ORDER BY n_penalized DESC, measure_name ASC LIMIT 10"""


@register("top_conditions_penalized", with_fixture(_TOP_COND), ids=("A12", "T2", "P10"))
def q_top_conditions_penalized(spark, sf_dir):
    return X.top_penalized_conditions(modeled(spark, sf_dir), 10)


@register("top_conditions_label_counts", with_fixture(f"""
SELECT measure_name, is_penalized, cast(count(*) AS bigint) AS n_rows FROM hrrp_model
WHERE measure_name IN (SELECT measure_name FROM ({_TOP_COND}) t)
GROUP BY measure_name, is_penalized"""), ids=("A13", "J3"))
def q_top_conditions_label_counts(spark, sf_dir):
    return X.condition_label_counts(modeled(spark, sf_dir), 10)


def _hist_sql(col):
    return f"""
SELECT '{col}' AS column_name, bin, is_penalized, cast(count(*) AS bigint) AS n_rows,
       lo + bin * (hi - lo) / 30.0e0 AS bin_start, lo + (bin + 1) * (hi - lo) / 30.0e0 AS bin_end
FROM (SELECT is_penalized, lo, hi,
             cast(CASE WHEN hi = lo THEN 0
                       ELSE least(floor(({col} - lo) / ((hi - lo) / 30.0e0)), 29) END AS integer) AS bin
      FROM hrrp_model, (SELECT min({col}) AS lo, max({col}) AS hi FROM hrrp_model) b
      WHERE {col} IS NOT NULL) x
GROUP BY bin, is_penalized, lo, hi"""


@register("histogram_predicted_rate", with_fixture(_hist_sql(C.PREDICTED)), ids=("A14",))
def q_histogram_predicted_rate(spark, sf_dir):
    return X.histogram_by_label(modeled(spark, sf_dir), C.PREDICTED, 30)


@register("histogram_all_numeric", with_fixture(union_all([_hist_sql(c) for c in BOX_COLUMNS])), ids=("A14",))
def q_histogram_all_numeric(spark, sf_dir):
    return X.histogram_by_label(modeled(spark, sf_dir), BOX_COLUMNS, 30)


@register("distinct_conditions", with_fixture("""
SELECT DISTINCT measure_name FROM hrrp_clean WHERE measure_name IS NOT NULL"""), ids=("A16",))
def q_distinct_conditions(spark, sf_dir):
    return X.distinct_sorted(loaded(spark, sf_dir), C.MEASURE)


@register("distinct_states", with_fixture("""
SELECT DISTINCT state FROM hrrp_clean WHERE state IS NOT NULL"""), ids=("A16",))
def q_distinct_states(spark, sf_dir):
    return X.distinct_sorted(loaded(spark, sf_dir), C.STATE)


_MEDIANS = union_all([f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.5) AS median FROM hrrp_model"
                      for c in BOX_COLUMNS])


@register("column_medians", with_fixture(_MEDIANS), ids=("A17", "M1"))
def q_column_medians(spark, sf_dir):
    return O.exact_median(modeled(spark, sf_dir), BOX_COLUMNS)


def _mode_sql(cols):
    parts = [f"""
SELECT '{c}' AS column_name, value AS mode, cast(n AS bigint) AS mode_count FROM (
  SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c} ASC) AS rk
  FROM hrrp_model WHERE {c} IS NOT NULL GROUP BY {c}) m WHERE rk = 1""" for c in cols]
    return union_all(parts)


@register("column_modes", with_fixture(_mode_sql([C.STATE, C.MEASURE])), ids=("A17", "M2", "P8"))
def q_column_modes(spark, sf_dir):
    return O.most_frequent(modeled(spark, sf_dir), C.columns_of_kind(modeled(spark, sf_dir), "object"))


@register("benchmark_lookup", with_fixture(f"""
SELECT h.facility_id, h.measure_name, bd.benchmark_penalty_rate
FROM hrrp_clean h LEFT JOIN {RS.BENCHMARK} ON h.measure_name = bd.measure_name"""),
          ids=("J1", "S5"))
def q_benchmark_lookup(spark, sf_dir):
    return X.with_benchmark(loaded(spark, sf_dir), benchmark_dim(spark)).select(
        "facility_id", C.MEASURE, "benchmark_penalty_rate")


@register("state_lookup", with_fixture(f"""
SELECT s.state, sd.name AS state_name, sd2.code AS state_code
FROM (SELECT DISTINCT state FROM hrrp_clean) s
LEFT JOIN {RS.STATES} AS sd(code, name) ON s.state = sd.code
LEFT JOIN {RS.STATES} AS sd2(code, name) ON sd.name = sd2.name"""),
          ids=("J2", "S5"))
def q_state_lookup(spark, sf_dir):
    states = state_dim(spark)
    named = X.with_state_name(X.distinct_sorted(loaded(spark, sf_dir), C.STATE), states)
    return X.state_code_for_name(named, states).select(C.STATE, "state_name", "state_code")


_PEER_COLUMNS = union_all([f"""
SELECT facility_id, measure_name, volume_band, '{name}' AS column_name, {value} AS value FROM banded WHERE {value} IS NOT NULL"""
                           for name, value in (("excess_readmission_ratio", "excess_readmission_ratio"),
                                               ("predicted_readmission_rate", "predicted_readmission_rate"),
                                               ("readmission_share", "CASE WHEN number_of_discharges > 0 THEN "
                                                                     "number_of_readmissions / number_of_discharges END"))])


@register("peer_comparison", with_fixture(f"""
SELECT facility_id, measure_name, volume_band, column_name, value, cast(count(*) OVER peers - 1 AS bigint) AS n_peers,
       cast(sum(cast(value AS decimal(28,10))) OVER peers - cast(value AS decimal(28,10)) AS double) / nullif(count(*) OVER peers - 1, 0) AS peer_mean,
       value - cast(sum(cast(value AS decimal(28,10))) OVER peers - cast(value AS decimal(28,10)) AS double) / nullif(count(*) OVER peers - 1, 0) AS gap,
       (rank() OVER (PARTITION BY measure_name, volume_band, column_name ORDER BY value) - 1)
         / nullif(count(*) OVER peers - 1, 0) AS percentile
FROM ({_PEER_COLUMNS}) l WINDOW peers AS (PARTITION BY measure_name, volume_band, column_name)""", """
banded AS (SELECT *, CASE WHEN number_of_discharges >= 1000 THEN 'large' WHEN number_of_discharges >= 100 THEN 'medium'
                          WHEN number_of_discharges >= 25 THEN 'small' WHEN number_of_discharges IS NOT NULL THEN 'tiny' END AS volume_band
           FROM hrrp_clean)"""), ids=("J4",))
def q_peer_comparison(spark, sf_dir):
    return PE.hospital_peers(loaded(spark, sf_dir))


# ---------------------------------------------------------------- rules

ROW_KEY = ["facility_id", C.MEASURE]


@register("risk_drivers_v1", RS.drivers_v1_sql(), ids=("R1", "R20", "T6"))
def q_risk_drivers_v1(spark, sf_dir):
    return R.driver_report_v1(loaded(spark, sf_dir), ROW_KEY)


@register("risk_drivers_v2", RS.drivers_v2_sql(), ids=("R2",))
def q_risk_drivers_v2(spark, sf_dir):
    return R.driver_report_v2(loaded(spark, sf_dir), ROW_KEY)


@register("risk_drivers_v3", RS.drivers_v3_sql(), ids=("R4", "T7", "F6", "F7", "F8"))
def q_risk_drivers_v3(spark, sf_dir):
    return R.driver_report_v3(loaded(spark, sf_dir), ROW_KEY)


@register("risk_scores", RS.score_table_sql(), ids=("R3", "R5", "R11", "R12", "R14", "F1", "F2", "F8", "F11"))
def q_risk_scores(spark, sf_dir):
    return R.score_table(loaded(spark, sf_dir), ROW_KEY)


@register("risk_index_exposure", RS.index_exposure_sql(),
          ids=("R6", "R7", "R8", "R9", "R10", "R17", "R18", "F4", "F9"))
def q_risk_index_exposure(spark, sf_dir):
    return R.index_exposure_table(loaded(spark, sf_dir), ROW_KEY)


@register("risk_profile_axes", RS.profile_axes_sql(), ids=("R15", "J1"))
def q_risk_profile_axes(spark, sf_dir):
    df = X.with_benchmark(loaded(spark, sf_dir), benchmark_dim(spark))
    return R.profile_axes(df, ROW_KEY)


@register("what_if_scenarios", RS.what_if_sql(), ids=("R19",))
def q_what_if_scenarios(spark, sf_dir):
    return R.what_if(loaded(spark, sf_dir), ROW_KEY)


# ---------------------------------------------------------------- metrics over the votes table

def votes_frame(spark, sf_dir):
    return make_votes(loaded(spark, sf_dir))


def _test(v):
    return v.where(F.col("split") == "test")


@register("votes_table", MS.votes_sql(), ids=("F5",))
def q_votes_table(spark, sf_dir):
    return votes_frame(spark, sf_dir)


@register("probability_report", with_fixture("""
SELECT row_id, model, probability, printf('%.1f%%', probability * 100) AS probability_text,
       CASE WHEN probability * 100 < 30 THEN 'low' WHEN probability * 100 < 70 THEN 'medium'
            WHEN probability IS NOT NULL THEN 'high' END AS probability_band,
       greatest(probability, 1 - probability) AS confidence, 1 - probability AS safe_probability
FROM votes""", MS.VOTES_SQL.strip()), ids=("R13", "R16", "F8"))
def q_probability_report(spark, sf_dir):
    return R.probability_report(votes_frame(spark, sf_dir), ["row_id", M.MODEL])


@register("model_metrics", MS.model_metrics_sql(), ids=("E1", "E2-4"))
def q_model_metrics(spark, sf_dir):
    return M.binary_metrics(votes_frame(spark, sf_dir), [M.MODEL, "split"])


@register("confusion_matrix", MS.confusion_sql(), ids=("E6",))
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_test(votes_frame(spark, sf_dir)), [M.MODEL])


@register("classification_report", MS.report_sql(), ids=("E7",))
def q_classification_report(spark, sf_dir):
    return M.classification_report(_test(votes_frame(spark, sf_dir)), [M.MODEL])


@register("roc_auc", MS.auc_sql(), ids=("E5",))
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(_test(votes_frame(spark, sf_dir)), [M.MODEL])


@register("roc_points", MS.roc_points_sql(), ids=("E8",))
def q_roc_points(spark, sf_dir):
    return M.roc_points(_test(votes_frame(spark, sf_dir)), [M.MODEL])


@register("cv_summary", MS.cv_sql(), ids=("E9", "A18"))
def q_cv_summary(spark, sf_dir):
    return M.cv_summary(votes_frame(spark, sf_dir).where(F.col("split") == "train"), [M.MODEL])


def _comparison(spark, sf_dir):
    return M.comparison(votes_frame(spark, sf_dir))


@register("model_comparison", MS.comparison_sql(), ids=("E10", "E13"))
def q_model_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


@register("metrics_long", MS.metrics_long_sql(), ids=("H1",))
def q_metrics_long(spark, sf_dir):
    return M.metrics_long(_comparison(spark, sf_dir))


@register("metrics_by_metric", MS.metrics_wide_sql(), ids=("H2",))
def q_metrics_by_metric(spark, sf_dir):
    return M.metrics_by_metric(M.metrics_long(_comparison(spark, sf_dir)))


@register("metric_best_flags", MS.best_flags_sql(), ids=("H4",))
def q_metric_best_flags(spark, sf_dir):
    return M.best_flags(M.metrics_long(_comparison(spark, sf_dir)))


@register("best_model", MS.best_model_sql(), ids=("T5", "E11"))
def q_best_model(spark, sf_dir):
    return M.best_model(_comparison(spark, sf_dir))


@register("model_ranking", MS.ranking_sql(), ids=("T4",))
def q_model_ranking(spark, sf_dir):
    return M.model_ranking(_comparison(spark, sf_dir))


@register("consensus_votes", MS.consensus_sql(), ids=("M18", "A19", "F10"))
def q_consensus_votes(spark, sf_dir):
    return M.consensus(votes_frame(spark, sf_dir))


@register("prediction_matrix", MS.prediction_matrix_sql(), ids=("M19", "M20"))
def q_prediction_matrix(spark, sf_dir):
    return M.prediction_matrix(votes_frame(spark, sf_dir))


@register("correct_count_mean", MS.correct_mean_sql(), ids=("A20",))
def q_correct_count_mean(spark, sf_dir):
    pm = M.prediction_matrix(votes_frame(spark, sf_dir))
    return pm.agg(F.avg("correct_count").alias("mean_correct_count"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- features

NUM_FEATURES = [C.DISCHARGES, C.PREDICTED, C.EXPECTED, C.READMISSIONS]
CAT_FEATURES = [C.STATE, C.MEASURE]


def _filled_sql(cols_num, cols_cat, src="hrrp_clean"):
    nums = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {src})) AS {c}" for c in cols_num)
    cats = ", ".join(
        f"coalesce({c}, (SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in cols_cat)
    return nums, cats


_N, _C = _filled_sql(NUM_FEATURES, CAT_FEATURES, "hrrp_model")


@register("imputed_model_frame", with_fixture(f"SELECT {_C}, {_N}, is_penalized FROM hrrp_model"),
          ids=("M1", "M2"))
def q_imputed_model_frame(spark, sf_dir):
    df = FE.impute_frame(modeled(spark, sf_dir), NUM_FEATURES, CAT_FEATURES)
    return df.select(*CAT_FEATURES, *NUM_FEATURES, C.LABEL)


_FILLED = f"filled AS (SELECT {_N} FROM hrrp_model)"


@register("scaling_params", with_fixture(union_all([
    f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_pop({c}) AS std_pop FROM filled"
    for c in NUM_FEATURES]), _FILLED), ids=("M3",))
def q_scaling_params(spark, sf_dir):
    df = FE.ExactMedianImputer(inputCols=NUM_FEATURES).fit(modeled(spark, sf_dir)).transform(modeled(spark, sf_dir))
    return FE.scaling_stats(df, NUM_FEATURES)


_NK, _ = _filled_sql(NUM_FEATURES, [], "hrrp_clean")
_SCALED = ", ".join(
    f"({c} - (SELECT avg({c}) FROM filled_k)) / coalesce(nullif((SELECT stddev_pop({c}) FROM filled_k), 0), 1) "
    f"AS {c}_scaled" for c in NUM_FEATURES)


@register("standardized_features", with_fixture(
    f"SELECT facility_id, measure_name, {_SCALED} FROM filled_k",
    f"filled_k AS (SELECT facility_id, measure_name, {_NK} FROM hrrp_clean)"), ids=("M3", "M1"))
def q_standardized_features(spark, sf_dir):
    df = loaded(spark, sf_dir).select("facility_id", C.MEASURE, *NUM_FEATURES)
    df = FE.ExactMedianImputer(inputCols=NUM_FEATURES).fit(df).transform(df)
    out = FE.PopulationScaler(inputCols=NUM_FEATURES).fit(df).transform(df)
    return out.select("facility_id", C.MEASURE, *[c + "_scaled" for c in NUM_FEATURES])


@register("category_levels", with_fixture(union_all([f"""
SELECT '{c}' AS column_name, {c} AS level,
       cast(row_number() OVER (ORDER BY {c}) - 1 AS integer) AS level_index, cast(n AS bigint) AS n_rows
FROM (SELECT {c}, count(*) AS n FROM hrrp_model WHERE {c} IS NOT NULL GROUP BY {c}) x""" for c in CAT_FEATURES])),
          ids=("H3", "M4"))
def q_category_levels(spark, sf_dir):
    return FE.category_levels(modeled(spark, sf_dir), CAT_FEATURES)


@register("encoded_feature_counts", with_fixture(union_all(
    [f"SELECT '{c}' AS column_name, cast(1 AS bigint) AS n_features" for c in NUM_FEATURES]
    + [f"SELECT '{c}' AS column_name, cast(count(DISTINCT {c}) AS bigint) AS n_features FROM hrrp_model"
       for c in CAT_FEATURES])), ids=("E12", "M5"))
def q_encoded_feature_counts(spark, sf_dir):
    return FE.encoded_feature_counts(modeled(spark, sf_dir), NUM_FEATURES, CAT_FEATURES)


@register("class_weights", with_fixture("""
SELECT is_penalized, cast(count(*) AS bigint) AS n_c,
       (SELECT count(*) FROM hrrp_model) / ((SELECT count(DISTINCT is_penalized) FROM hrrp_model) * cast(count(*) AS double)) AS weight
FROM hrrp_model GROUP BY is_penalized"""), ids=("M15",))
def q_class_weights(spark, sf_dir):
    return FE.class_weights(modeled(spark, sf_dir))


_CLS = "cls AS (SELECT is_penalized, count(*) AS n_c, (2 * count(*) + 5) // 10 AS n_test FROM hrrp_clean GROUP BY is_penalized)"


@register("split_sizes", with_fixture("""
SELECT 'test' AS split, is_penalized, cast(n_test AS bigint) AS n_rows FROM cls WHERE n_test > 0
UNION ALL
SELECT 'train' AS split, is_penalized, cast(n_c - n_test AS bigint) AS n_rows FROM cls WHERE n_c > n_test""", _CLS),
          ids=("M7", "E12"))
def q_split_sizes(spark, sf_dir):
    sp = FE.stratified_split(loaded(spark, sf_dir), ["facility_id", C.MEASURE])
    return sp.groupBy("split", C.LABEL).agg(F.count(F.lit(1)).alias("n_rows"))


@register("fold_sizes", with_fixture("""
SELECT cast(f AS integer) AS fold, is_penalized, cast((n_c - n_test - f + 4) // 5 AS bigint) AS n_rows
FROM cls, (VALUES (0), (1), (2), (3), (4)) AS fs(f) WHERE (n_c - n_test - f + 4) // 5 > 0""", _CLS), ids=("M8",))
def q_fold_sizes(spark, sf_dir):
    sp = FE.stratified_split(loaded(spark, sf_dir), ["facility_id", C.MEASURE])
    return sp.where(F.col("split") == "train").groupBy("fold", C.LABEL).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- fitted models (rows-only checks)

_FITTED: dict = {}
_SCORED: dict = {}
_CV: dict = {}


def split_frame(spark, sf_dir):
    """The cleaned view with its deterministic split / fold columns, kept with the loaded view."""
    def build():
        c = loaded(spark, sf_dir)
        return FE.stratified_split(c.withColumn("row_id", make_row_id(c)), ROW_KEY)

    return _kept(spark, sf_dir, "split", build)


def fold_frame(spark, sf_dir):
    """All rows dealt into the five CV folds (no test part)."""
    def build():
        return FE.stratified_split(loaded(spark, sf_dir), ROW_KEY, test_fraction=0)

    return _kept(spark, sf_dir, "folds", build)


def fitted_models(spark, sf_dir, names, rows="train"):
    """Models by name, fitted once per (application, input, rows): on the training rows
    or, for live scoring, on all rows.  Those that are missing are fitted together."""
    app = (_app(spark), sf_dir, rows)
    missing = [n for n in names if (*app, n) not in _FITTED]
    if missing:
        data = split_frame(spark, sf_dir)
        data = data.where(F.col("split") == "train") if rows == "train" else data
        _FITTED.update({(*app, n): m for n, m in MD.fit_many(missing, data).items()})
    return {n: _FITTED[(*app, n)] for n in names}


def scored_rows(spark, sf_dir, name, split=None):
    """Every row, or every row of ``split``, scored by one fitted model, kept while that model
    is the current fit (comparison and consensus aggregate over it several times)."""
    model = fitted_models(spark, sf_dir, [name])[name]
    key = (_app(spark), sf_dir, name)
    if split and (*key, None) in _SCORED:
        return _SCORED[(*key, None)].where(F.col("split") == split)
    if (*key, split) not in _SCORED:
        rows = split_frame(spark, sf_dir)
        rows = rows.where(F.col("split") == split) if split else rows
        _SCORED[(*key, split)] = MD.score(model, rows, name).select(
            "row_id", "facility_id", C.MEASURE, "split", "fold",
            F.col(C.LABEL).alias("label"), "model", "prediction", "probability") \
            .persist(StorageLevel.MEMORY_AND_DISK)
    return _SCORED[(*key, split)]


MODEL_IDS = {"LR": "M9", "DT": "M10", "SVM": "M11", "RF": "M12", "GB": "M13", "MLP": "M14"}


def _register_model_query(name, short):
    @register(f"model_scores_{short.lower()}", None, ids=(MODEL_IDS[short], "M15", "M16", "M17", "M4", "M5", "M6"))
    def scores(spark, sf_dir):
        return scored_rows(spark, sf_dir, name)

    @register(f"cv_scores_{short.lower()}", None, ids=("M8", "E9", "A18", MODEL_IDS[short]))
    def cv(spark, sf_dir):
        return cv_summaries(spark, sf_dir, [name])


def cv_summaries(spark, sf_dir, names):
    """Five-fold CV over all rows: mean and population std of the fold accuracies per model."""
    key = (_app(spark), sf_dir)
    missing = [n for n in names if (*key, n) not in _CV]
    if missing:
        found = MD.cross_validate(missing, fold_frame(spark, sf_dir)).collect()  # a row per model and fold
        _CV.update({(*key, n): [r for r in found if r["model"] == n] for n in missing})
    rows = [tuple(r) for n in names for r in _CV[(*key, n)]]
    folds = spark.createDataFrame(rows, "model string, fold int, accuracy double")
    return folds.groupBy("model").agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                                      F.count(F.lit(1)).alias("n_folds"))


for _name, _short in M.MODEL_NAMES:
    _register_model_query(_name, _short)


def all_scored(spark, sf_dir, split=None):
    fitted_models(spark, sf_dir, MD.model_names())
    out = None
    for name in MD.model_names():
        s = scored_rows(spark, sf_dir, name, split)
        out = s if out is None else out.unionByName(s)
    return out


def fitted_comparison(spark, sf_dir):
    """E10 on real fits: the eight metrics, with CV over all rows."""
    s = all_scored(spark, sf_dir)
    cv = cv_summaries(spark, sf_dir, MD.model_names()).drop("n_folds")
    return M.comparison(s, cv=cv)


@register("model_comparison_fitted", None, ids=("E1-E8", "E10", "E13", "M16"))
def q_model_comparison_fitted(spark, sf_dir):
    return fitted_comparison(spark, sf_dir)


@register("model_ranking_fitted", None, ids=("T4", "T5", "E11"))
def q_model_ranking_fitted(spark, sf_dir):
    ranked = M.model_ranking(fitted_comparison(spark, sf_dir))
    return ranked.withColumn("is_best", F.col("rank") == 1)


@register("model_confusion_fitted", None, ids=("E6",))
def q_model_confusion_fitted(spark, sf_dir):
    return M.confusion_matrix(all_scored(spark, sf_dir, "test"), [M.MODEL])


@register("model_report_fitted", None, ids=("E7",))
def q_model_report_fitted(spark, sf_dir):
    return M.classification_report(all_scored(spark, sf_dir, "test"), [M.MODEL])


@register("model_roc_points_fitted", None, ids=("E8",))
def q_model_roc_points_fitted(spark, sf_dir):
    return M.roc_points(all_scored(spark, sf_dir, "test"), [M.MODEL])


@register("consensus_fitted", None, ids=("M18", "M16", "M17", "A19"))
def q_consensus_fitted(spark, sf_dir):
    return M.consensus(all_scored(spark, sf_dir, "test"), "row_id")


@register("consensus_requests", None, ids=("M18", "L1", "R13", "R16", "R17"))
def q_consensus_requests(spark, sf_dir):
    """Live consensus: six models fitted on all rows score every request."""
    requests, out = _requests(spark, sf_dir), None
    for name, model in fitted_models(spark, sf_dir, MD.model_names(), rows="all").items():
        s = ST.model_scores(requests, model, name)
        out = s if out is None else out.unionByName(s)
    votes = M.consensus(out, "request_id")
    ratio = requests.select("request_id", R.ratio_guarded(F.col(C.PREDICTED), F.col(C.EXPECTED)).alias("excess_ratio"))
    joined = votes.join(ratio, "request_id")
    return R.probability_report(joined, [*votes.drop("mean_probability").columns, "excess_ratio"], "mean_probability",
                                F.col("excess_ratio"))


@register("model_importance", None, ids=("M16", "M17"))
def q_model_importance(spark, sf_dir):
    """What the test metrics of the forest lose with each input column permuted."""
    name = "Random Forest"
    model = fitted_models(spark, sf_dir, [name])[name]
    test = split_frame(spark, sf_dir).where(F.col("split") == "test").select("row_id", *NUM_FEATURES, *CAT_FEATURES, C.LABEL)
    return IM.importance(test, [*NUM_FEATURES, *CAT_FEATURES], ["row_id"], lambda df: MD.score(model, df, name), label=C.LABEL)


@register("model_explanations", None, ids=("M10", "M17"))
def q_model_explanations(spark, sf_dir):
    """Shapley values of every row's score by the decision tree, per input column."""
    name = "Decision Tree"
    model = fitted_models(spark, sf_dir, [name])[name]
    rows = split_frame(spark, sf_dir).select("row_id", *NUM_FEATURES, *CAT_FEATURES)
    return SH.explain_rows(model, rows, ["row_id"], [*NUM_FEATURES, *CAT_FEATURES])


@register("sample_test_rows", MS.sample_test_rows_sql(), ids=("T8", "M19"))
def q_sample_test_rows(spark, sf_dir):
    pm = M.prediction_matrix(votes_frame(spark, sf_dir).where(F.col("split") == "test"))
    # a spread order by key arithmetic, which SQL can express
    return pm.orderBy((F.col("row_id") * 48271) % 2147483647, "row_id").limit(5)


# ---------------------------------------------------------------- streaming (L1, L2)

def _requests(spark, sf_dir):
    c = loaded(spark, sf_dir)
    return ST.scoring_requests(c, make_row_id(c))


@register("stream_rule_scores", RS.stream_rules_sql(), ids=("L2", "F7"))
def q_stream_rule_scores(spark, sf_dir):
    folder = ST.write_request_files(_requests(spark, sf_dir), shared_path(spark, "requests"))
    stream = ST.rule_scores(ST.request_stream(spark, folder))
    return ST.run_available(stream, spark, "rule-scores")


@register("stream_model_scores", None, ids=("L1", "F7"))
def q_stream_model_scores(spark, sf_dir):
    """Live scoring by a saved model that was fitted on all rows, with R13, R16 and R17."""
    name = "Logistic Regression"
    path = shared_path(spark, "model-lr")
    fitted_models(spark, sf_dir, [name], rows="all")[name].write().overwrite().save(path)
    model = MD.PipelineModel.load(path)
    folder = ST.write_request_files(_requests(spark, sf_dir), shared_path(spark, "requests"))
    stream = ST.model_scores(ST.request_stream(spark, folder), model, name, report=True)
    return ST.run_available(stream, spark, "model-scores")


@register("stream_requests_once", RS.stream_rules_sql(), ids=("L1", "L2"))
def q_stream_requests_once(spark, sf_dir):
    """All requests come twice, the second time after the stream was stopped; each is scored once."""
    requests, folder = _requests(spark, sf_dir), shared_path(spark, "requests-twice")
    timed = SO.timed(requests, SO.received(F.col("request_id")))
    stream = SO.OnceStream.create(spark, folder, ST.rule_scores, delay="3650 days")
    for _ in range(2):
        SO.deliver(timed, folder)
        stream.advance(spark)
    delete_path(spark, folder)
    return stream.sink.table(spark, ST.rule_scores(timed).schema)


RATE_RULE = SW.WindowRule(size="30 days", lateness="10 days")
DELIVERIES = 4


@register("stream_penalty_rate", with_fixture("""
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, state, cast(count(*) AS bigint) AS n_rows,
       cast(sum(is_penalized) AS bigint) AS n_penalized, 100.0e0 * sum(is_penalized) / count(*) AS penalty_rate_pct
FROM placed
WHERE reported_at <= window_start + INTERVAL 40 DAY
  AND window_start + INTERVAL 30 DAY <= (SELECT max(event_time) FROM placed) - INTERVAL 10 DAY
GROUP BY window_start, state""", """
placed AS (
  SELECT l.l_shipdate AS event_time, c.state, c.is_penalized,
         l.l_shipdate + to_days(cast((l.l_orderkey * 7 + l.l_linenumber * 13) % 45 AS integer)) AS reported_at,
         TIMESTAMP '1970-01-01' + to_days(cast(30 * floor(epoch(l.l_shipdate) / 2592000) AS integer)) AS window_start
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN hrrp_clean c ON cast(c.facility_id AS bigint) = l.l_suppkey AND c.measure_name =
    CASE p.p_type WHEN 'ECONOMY' THEN 'Acute Myocardial Infarction (AMI)' WHEN 'LARGE' THEN 'Heart Failure (HF)'
         WHEN 'MEDIUM' THEN 'Pneumonia (PN)' WHEN 'PROMO' THEN 'COPD' WHEN 'SMALL' THEN 'Hip/Knee Arthroplasty' ELSE 'CABG' END)"""),
          ids=("L3", "A10"))
def q_stream_penalty_rate(spark, sf_dir):
    """Observations come in deliveries by the time of their report; the stream is started anew after
    each and goes on from its checkpoint."""
    staged, folder = shared_path(spark, "observations-all"), shared_path(spark, "observations")
    observations(spark, sf_dir, loaded(spark, sf_dir)).write.parquet(staged)
    seen = spark.read.schema(SW.OBSERVATION_SCHEMA).parquet(staged)
    low, high = seen.agg(F.min("reported_at").cast("double"), F.max("reported_at").cast("double")).first()
    stream = SW.RateStream.create(spark, folder, RATE_RULE)
    inner = [] if low is None else [F.lit(low + (high - low) * k / DELIVERIES).cast("timestamp") for k in range(1, DELIVERIES)]
    at = [None, *inner, None]
    for lower, upper in zip(at, at[1:]):
        SW.deliver(seen, folder, lower, upper)
        stream.advance(spark)
    for read in (staged, folder):
        delete_path(spark, read)
    return stream.table(spark)


# ---------------------------------------------------------------- CSV source

@register("csv_load_roundtrip", with_fixture("SELECT " + ", ".join(
    f"CASE WHEN trim({c}) IN ({_NA_SQL}) THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS) + " FROM hrrp_raw"),
    ids=("S1", "S2", "S3", "S4"))
def q_csv_load_roundtrip(spark, sf_dir):
    """The raw view written as header CSV to the shared folder and read back
    with the explicit all-string schema and NA-token handling."""
    if CSV.load_hrrp_csv(spark, shared_path(spark, "no-such-csv")) is not None:  # S2
        raise RuntimeError("a missing file must give None")
    path = CSV.write_csv(raw(spark, sf_dir), shared_path(spark, "hrrp-csv"))
    return CSV.load_hrrp_csv(spark, path)


# ---------------------------------------------------------------- one-hot against the dimensions (H3)

DUMMY_VOCAB = {C.STATE: [c for c, _ in STATE_NAMES], C.MEASURE: [m for m, _ in BENCHMARK_RATES]}


def _dummy_sql():
    cols = []
    for c in (C.STATE, C.MEASURE):
        for v in DUMMY_VOCAB[c]:
            name = f"{c}_{v}".replace('"', '""')
            lit = v.replace("'", "''")
            cols.append(f"cast(coalesce({c} = '{lit}', FALSE) AS integer) AS \"{name}\"")
    return with_fixture("SELECT facility_id, " + ", ".join(cols) + " FROM hrrp_clean")


@register("one_hot_dummies", _dummy_sql(), ids=("H3", "M4"))
def q_one_hot_dummies(spark, sf_dir):
    df = loaded(spark, sf_dir).select("facility_id", C.STATE, C.MEASURE)
    return FE.one_hot_columns(df, [C.STATE, C.MEASURE], vocabulary=DUMMY_VOCAB)
