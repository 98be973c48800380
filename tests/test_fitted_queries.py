"""The registered queries on real fits, recomputed from the predictions that they are made of."""
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from penalytics.operators import models as MD
from penalytics.plans import catalog as K
from penalytics.plans.oracle import with_fixture
from penalytics.plans.registry import all_queries
from penalytics.sources.tables import TABLES, table_path
from tests.conftest import SF_MID

NAMES = MD.model_names()


def run(spark, name):
    return all_queries()[name].build(spark, SF_MID).collect()


def sql(body):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        assert t in TABLES
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_MID, t)}')")
    return con.execute(with_fixture(body)).fetchall()


@pytest.fixture(scope="module")
def scored(spark):
    """{model: rows}; the fits of this module are made once, with the registered settings."""
    made = {n: run(spark, f"model_scores_{MD.short_name(n).lower()}") for n in NAMES}
    yield made
    K.drop_models()


def test_rows_labels_splits_and_folds(scored):
    want = {(f, m): y for f, m, y in sql("SELECT facility_id, measure_name, is_penalized FROM hrrp_clean")}
    split = None
    for n, rows in scored.items():
        assert {(r.facility_id, r.measure_name): r.label for r in rows} == want and len(rows) == len(want)
        own = {r.row_id: (r.split, r.fold) for r in rows}
        assert split in (None, own)
        split = own
        assert {r.model for r in rows} == {n}
    sizes = Counter((r.split, r.label) for r in rows)
    for y in (0, 1):
        total = sum(v == y for v in want.values())
        assert sizes["test", y] == (2 * total + 5) // 10
        folds = Counter(r.fold for r in rows if r.split == "train" and r.label == y)
        assert sorted(folds) == list(range(5)) and max(folds.values()) - min(folds.values()) <= 1


def test_predictions_follow_probabilities_and_beat_the_majority(scored):
    for n, rows in scored.items():
        assert all(0 <= r.probability <= 1 for r in rows)
        if n != "Support Vector Machine":  # its margin's sign decides, and its probability is fitted apart
            assert all(r.prediction == int(r.probability > 0.5) for r in rows if r.probability != 0.5)
        test = [r for r in rows if r.split == "test"]
        share = sum(r.label for r in test) / len(test)
        assert sum(r.label == r.prediction for r in test) / len(test) > max(share, 1 - share)


def auc(rows):
    pos, neg = ([r.probability for r in rows if r.label == y] for y in (1, 0))
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def counts(rows):
    c = Counter((r.label, r.prediction) for r in rows)
    return c[1, 1], c[0, 1], c[0, 0], c[1, 0]


def test_comparison_ranking_and_confusion(spark, scored):
    # fold accuracies as if kept from earlier refits, which test_cross_validation... checks
    folds = {n: [0.6 + 0.05 * k + 0.01 * f for f in range(5)] for k, n in enumerate(NAMES)}
    K._CV.update({(K._app(spark), SF_MID, n): [(n, f, a) for f, a in enumerate(own)] for n, own in folds.items()})
    got = {r.model: r for r in run(spark, "model_comparison_fitted")}
    assert set(got) == set(NAMES)
    for n, rows in scored.items():
        train, test = ([r for r in rows if r.split == s] for s in ("train", "test"))
        tp, fp, tn, fn = counts(test)
        r = got[n]
        assert r.train_accuracy == pytest.approx(np.mean([x.label == x.prediction for x in train]))
        assert r.test_accuracy == pytest.approx((tp + tn) / len(test))
        assert r.precision == pytest.approx(tp / (tp + fp)) and r.recall == pytest.approx(tp / (tp + fn))
        assert r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r.roc_auc == pytest.approx(auc(test))
        assert (r.cv_mean, r.cv_std) == (pytest.approx(np.mean(folds[n])), pytest.approx(np.std(folds[n])))
        assert r.overfit_gap == pytest.approx(r.train_accuracy - r.test_accuracy)
    ranked = sorted(run(spark, "model_ranking_fitted"), key=lambda r: r["rank"])
    assert [r.model for r in ranked] == sorted(NAMES, key=lambda n: (-got[n].test_accuracy, NAMES.index(n)))
    assert [r.is_best for r in ranked] == [True] + [False] * 5
    K._CV.clear()
    cells = {(r.model, r.actual, r.predicted): r.n for r in run(spark, "model_confusion_fitted")}
    for n, rows in scored.items():
        tp, fp, tn, fn = counts([r for r in rows if r.split == "test"])
        assert [cells[n, 1, 1], cells[n, 0, 1], cells[n, 0, 0], cells[n, 1, 0]] == [tp, fp, tn, fn]


def test_report_and_roc_points(spark, scored):
    report = {(r.model, r.class_name): r for r in run(spark, "model_report_fitted")}
    points = defaultdict(list)
    for r in run(spark, "model_roc_points_fitted"):
        points[r.model].append(r)
    for n, rows in scored.items():
        test = [r for r in rows if r.split == "test"]
        tp, fp, tn, fn = counts(test)
        assert report[n, "Penalty"].precision == pytest.approx(tp / (tp + fp)) and report[n, "Penalty"].support == tp + fn
        assert report[n, "No Penalty"].recall == pytest.approx(tn / (tn + fp)) and report[n, "accuracy"].f1_score == pytest.approx((tp + tn) / len(test))
        pos, neg = tp + fn, tn + fp
        want = {s: (sum(r.probability >= s and r.label == 0 for r in test) / neg, sum(r.probability >= s and r.label == 1 for r in test) / pos)
                for s in {r.probability for r in test}} | {float("inf"): (0.0, 0.0)}
        assert len(points[n]) == len(want)
        for p in points[n]:
            assert (p.fpr, p.tpr) == pytest.approx(want[p.threshold])


def test_consensus(spark, scored):
    votes = defaultdict(list)
    for rows in scored.values():
        for r in rows:
            if r.split == "test":
                votes[r.row_id].append(r)
    got = {r.row_id: r for r in run(spark, "consensus_fitted")}
    assert set(got) == set(votes)
    for i, own in votes.items():
        k = sum(r.prediction for r in own)
        assert (got[i].n_votes, got[i].n_models, got[i].consensus) == (k, 6, int(k >= 3))
        assert got[i].mean_probability == pytest.approx(np.mean([r.probability for r in own])) and got[i].models_agree == f"{k}/6"


def test_requests_are_scored_by_models_of_all_rows(spark, scored):
    # five of the models as if fitted on all rows; the one that is looked at in detail is
    K._FITTED.update({(K._app(spark), SF_MID, "all", n): K._FITTED[(K._app(spark), SF_MID, "train", n)] for n in NAMES[1:]})
    requests = {r.request_id: r for r in K._requests(spark, SF_MID).collect()}
    live = {r.request_id: r for r in run(spark, "consensus_requests")}
    streamed = {r.request_id: r for r in run(spark, "stream_model_scores")}
    assert set(live) == set(streamed) == set(requests)
    model = K.fitted_models(spark, SF_MID, ["Logistic Regression"], rows="all")["Logistic Regression"]
    single = MD.score(model, K._requests(spark, SF_MID).withColumn("is_penalized", F.lit(None).cast("int")), "x").collect()
    assert {r.request_id: round(r.probability, 9) for r in single} == {i: round(r.probability, 9) for i, r in streamed.items()}
    assert all(r.n_models == 6 and r.consensus == int(r.n_votes >= 3) for r in live.values())


def test_cross_validation_scores_are_those_of_refits(spark, scored):
    folded = K.fold_frame(spark, SF_MID)
    for name in ("Logistic Regression", "Decision Tree"):
        shares = []
        for f in range(5):
            model = MD.fit_pipeline(name, folded.where(F.col("fold") != f))
            held = MD.score(model, folded.where(F.col("fold") == f), name).collect()
            shares.append(np.mean([r.prediction == r.is_penalized for r in held]))
        got = run(spark, f"cv_scores_{MD.short_name(name).lower()}")[0]
        assert (got.cv_mean, got.cv_std, got.n_folds) == (pytest.approx(np.mean(shares)), pytest.approx(np.std(shares), abs=1e-9), 5)


def test_a_model_without_probabilities_gives_the_sigmoid_of_its_margin(spark):
    split = MD.labelled(K.split_frame(spark, SF_MID))
    pre, _ = MD.fit_preprocessing(split)
    prepared = PipelineModel(pre).transform(split)
    bare = PipelineModel([*pre, LinearSVC(maxIter=5).fit(prepared)])
    got = MD.score(bare, split, "bare").select("row_id", "probability").collect()
    raw = {r.row_id: r.rawPrediction[1] for r in bare.transform(split).collect()}
    assert len(got) == len(raw) and all(r.probability == pytest.approx(1 / (1 + np.exp(-raw[r.row_id]))) for r in got)
