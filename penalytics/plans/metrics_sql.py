"""Oracle SQL for the metric queries over the votes table (FIXTURES F5)."""

from __future__ import annotations

from ..operators.metrics import CLASS_NAMES, MODEL_NAMES
from ..sources.votes import VOTES_SQL
from .oracle import union_all, with_fixture


def r0(n: str, d: str) -> str:
    return f"coalesce(cast({n} AS double) / nullif(cast({d} AS double), 0), 0.0e0)"


CONF = """conf AS (
  SELECT model, {grp}
         cast(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS bigint) AS tp,
         cast(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS bigint) AS fp,
         cast(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS bigint) AS tn,
         cast(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS bigint) AS fn
  FROM votes {where} GROUP BY model {grp_by})"""


def _v(body: str, *ctes: str) -> str:
    return with_fixture(body, ",\n".join([VOTES_SQL.strip(), *ctes]))


def votes_sql() -> str:
    return _v("SELECT * FROM votes")


BINARY_COLS = f"""tp, fp, tn, fn, tp + fp + tn + fn AS n,
       {r0('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {r0('tp', 'tp + fp')} AS precision,
       {r0('tp', 'tp + fn')} AS recall, {r0('2 * tp', '2 * tp + fp + fn')} AS f1"""


def model_metrics_sql() -> str:
    conf = CONF.format(grp="split,", where="", grp_by=", split")
    return _v(f"SELECT model, split, {BINARY_COLS} FROM conf", conf)


def confusion_sql() -> str:
    conf = CONF.format(grp="", where="WHERE split = 'test'", grp_by="")
    parts = [f"SELECT model, {a} AS actual, {p} AS predicted, {n} AS n FROM conf"
             for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return _v(union_all(parts), conf)


def report_sql() -> str:
    conf = CONF.format(grp="", where="WHERE split = 'test'", grp_by="")
    m = f"""m AS (SELECT model, tp + fp + tn + fn AS n, tp + fn AS s1, tn + fp AS s0,
       {r0('tp', 'tp + fp')} AS p1, {r0('tp', 'tp + fn')} AS r1,
       {r0('tn', 'tn + fn')} AS p0, {r0('tn', 'tn + fp')} AS r0,
       {r0('2 * tp', '2 * tp + fp + fn')} AS f1_1, {r0('2 * tn', '2 * tn + fn + fp')} AS f1_0,
       {r0('tp + tn', 'tp + fp + tn + fn')} AS acc FROM conf)"""
    rows = [
        (CLASS_NAMES[0], "p0", "r0", "f1_0", "s0"),
        (CLASS_NAMES[1], "p1", "r1", "f1_1", "s1"),
        ("accuracy", "acc", "acc", "acc", "n"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f1_0 + f1_1) / 2", "n"),
        ("weighted avg", r0("p0 * s0 + p1 * s1", "n"), r0("r0 * s0 + r1 * s1", "n"),
         r0("f1_0 * s0 + f1_1 * s1", "n"), "n"),
    ]
    parts = [f"SELECT model, '{c}' AS class_name, {p} AS precision, {r} AS recall, {f} AS f1_score, "
             f"cast({s} AS double) AS support FROM m" for c, p, r, f, s in rows]
    return _v(union_all(parts), conf, m)


SC = """sc AS (
  SELECT model, probability AS score,
         cast(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS bigint) AS pos,
         cast(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS bigint) AS neg
  FROM votes WHERE split = 'test' GROUP BY model, probability)"""

AUC_BODY = """SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
       THEN sum(pos * (cum_neg - neg + 0.5e0 * neg)) / cast(sum(pos) * sum(neg) AS double) END AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc) c
GROUP BY model"""


def auc_sql() -> str:
    return _v(AUC_BODY, SC)


def roc_points_sql() -> str:
    return _v("""
SELECT model, score AS threshold,
       CASE WHEN tn_ = 0 THEN NULL ELSE cast(cn AS double) / tn_ END AS fpr,
       CASE WHEN tp_ = 0 THEN NULL ELSE cast(cp AS double) / tp_ END AS tpr
FROM (SELECT model, score,
             sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn
      FROM sc) c
JOIN (SELECT model, sum(pos) AS tp_, sum(neg) AS tn_ FROM sc GROUP BY model) t USING (model)
UNION ALL
SELECT DISTINCT model, 'inf'::double AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr FROM sc""", SC)


CV = """cv AS (
  SELECT model, cast(count(*) AS bigint) AS n_folds, avg(acc) AS cv_mean, stddev_pop(acc) AS cv_std
  FROM (SELECT model, fold, avg(CASE WHEN prediction = label THEN 1.0e0 ELSE 0.0e0 END) AS acc
        FROM votes WHERE split = 'train' GROUP BY model, fold) f
  GROUP BY model)"""


def cv_sql() -> str:
    return _v("SELECT * FROM cv", CV)


COMP = f"""comp AS (
  SELECT tr.model, tr.train_accuracy, {r0('tp + tn', 'tp + fp + tn + fn')} AS test_accuracy,
         {r0('tp', 'tp + fp')} AS precision, {r0('tp', 'tp + fn')} AS recall,
         {r0('2 * tp', '2 * tp + fp + fn')} AS f1, auc.roc_auc, cv.cv_mean, cv.cv_std,
         tr.train_accuracy - {r0('tp + tn', 'tp + fp + tn + fn')} AS overfit_gap
  FROM (SELECT model, avg(CASE WHEN prediction = label THEN 1.0e0 ELSE 0.0e0 END) AS train_accuracy
        FROM votes WHERE split = 'train' GROUP BY model) tr
  JOIN conf USING (model) JOIN ({AUC_BODY}) auc USING (model) JOIN cv USING (model))"""


def _comp_ctes():
    return (CONF.format(grp="", where="WHERE split = 'test'", grp_by=""), SC, CV, COMP)


def comparison_sql() -> str:
    return _v("SELECT * FROM comp", *_comp_ctes())


METRICS = ["train_accuracy", "test_accuracy", "precision", "recall", "f1", "roc_auc", "cv_mean", "cv_std"]
LONG = "lng AS (" + union_all([f"SELECT model, '{m}' AS metric, {m} AS value FROM comp" for m in METRICS]) + ")"


def metrics_long_sql() -> str:
    return _v("SELECT * FROM lng", *_comp_ctes(), LONG)


def metrics_wide_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN model = '{n}' THEN value END) AS {s}" for n, s in MODEL_NAMES)
    return _v(f"SELECT metric, {cols} FROM lng GROUP BY metric", *_comp_ctes(), LONG)


def best_flags_sql() -> str:
    return _v("SELECT model, metric, value, value = max(value) OVER (PARTITION BY metric) AS is_max FROM lng",
              *_comp_ctes(), LONG)


ORDER_CASE = "CASE model " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(MODEL_NAMES)) + " END"


def best_model_sql() -> str:
    return _v(f"""
SELECT model AS best_model, test_accuracy, roc_auc, f1 FROM comp
ORDER BY test_accuracy DESC, {ORDER_CASE} ASC LIMIT 1""", *_comp_ctes())


def ranking_sql() -> str:
    return _v(f"""
SELECT model, test_accuracy,
       cast(row_number() OVER (ORDER BY test_accuracy DESC, {ORDER_CASE}) AS integer) AS rank
FROM comp""", *_comp_ctes())


def consensus_sql() -> str:
    return _v("""
SELECT row_id, n_votes, n_models, cast(n_votes >= n_models / 2 AS integer) AS consensus,
       CASE WHEN n_votes >= n_models / 2 THEN 'PENALIZED' ELSE 'NOT PENALIZED' END AS consensus_label,
       cast(n_votes AS double) / n_models AS vote_fraction, mean_probability,
       cast(n_votes AS varchar) || '/' || cast(n_models AS varchar) AS models_agree
FROM (SELECT row_id, cast(sum(prediction) AS bigint) AS n_votes, cast(count(*) AS bigint) AS n_models,
             avg(probability) AS mean_probability FROM votes GROUP BY row_id) v""")


PM = ("pm AS (SELECT row_id, any_value(label) AS true_label, "
      + ", ".join(f"max(CASE WHEN model = '{n}' THEN prediction END) AS {s}" for n, s in MODEL_NAMES)
      + ", cast(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS bigint) AS correct_count"
      + " FROM votes GROUP BY row_id)")


def prediction_matrix_sql() -> str:
    return _v(f"""
SELECT *, CASE WHEN correct_count = {len(MODEL_NAMES)} THEN 'all' WHEN correct_count >= 4 THEN 'most'
               ELSE 'split' END AS agreement FROM pm""", PM)


def sample_test_rows_sql() -> str:
    return _v(f"""
SELECT *, CASE WHEN correct_count = {len(MODEL_NAMES)} THEN 'all' WHEN correct_count >= 4 THEN 'most'
               ELSE 'split' END AS agreement
FROM pm ORDER BY (row_id * 48271) % 2147483647, row_id LIMIT 5""", PM.replace("FROM votes GROUP", "FROM votes WHERE split = 'test' GROUP"))


def correct_mean_sql() -> str:
    return _v("SELECT avg(correct_count) AS mean_correct_count, cast(count(*) AS bigint) AS n_rows FROM pm", PM)
