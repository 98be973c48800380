"""Model fits (fast settings, smoke) and stream-vs-batch equality (L1, L2)."""
import pytest
from pyspark.sql import functions as F

from penalytics.operators import metrics as M
from penalytics.operators import models as MD
from penalytics.plans import catalog as K
from penalytics.session import shared_path
from penalytics.sources.votes import row_id
from penalytics.streaming import scoring as ST
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def split(spark):
    return K.split_frame(spark, SF_MID).cache()


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "Support Vector Machine",
                                  "Random Forest", "Gradient Boosting", "Neural Network (MLP)"])
def test_model_beats_majority(spark, split, name):
    scored = MD.fit_and_score(name, split, fast=True).where(F.col("split") == "test")
    scored = scored.withColumn("label", F.col("is_penalized"))
    assert scored.count() == split.where(F.col("split") == "test").count()
    m = M.binary_metrics(scored, ["model"]).first()
    majority = max(scored.agg(F.avg("label")).first()[0], 1 - scored.agg(F.avg("label")).first()[0])
    assert m["accuracy"] > majority
    auc = M.roc_auc(scored, ["model"]).first()["roc_auc"]
    assert auc > 0.5
    probs = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= probs[0] <= probs[1] <= 1.0


def test_fit_is_deterministic(spark, split):
    a = MD.fit_and_score("Logistic Regression", split, fast=True).select("row_id", "probability")
    b = MD.fit_and_score("Logistic Regression", split, fast=True).select("row_id", "probability")
    assert {r[0]: round(r[1], 9) for r in a.collect()} == {r[0]: round(r[1], 9) for r in b.collect()}


def test_six_models_share_one_preparation_and_metrics_recompute(spark, split):
    models = MD.fit_many(["Logistic Regression", "Decision Tree"], split.where(F.col("split") == "train"), fast=True)
    first = [m.stages[:-1] for m in models.values()]
    assert all(a is b for a, b in zip(*first))
    scored = MD.score(models["Decision Tree"], split, "Decision Tree").withColumn("label", F.col("is_penalized"))
    rows = [(r["label"], r["prediction"]) for r in scored.where("split = 'test'").collect()]
    got = M.binary_metrics(scored.where("split = 'test'"), ["model"]).first()
    assert got["accuracy"] == pytest.approx(sum(a == b for a, b in rows) / len(rows))
    hit = sum(a == b == 1 for a, b in rows)
    assert got["precision"] == pytest.approx(hit / sum(b for _, b in rows)) and got["recall"] == pytest.approx(hit / sum(a for a, _ in rows))


def test_excluded_features_do_not_reach_the_model(spark, split):
    train = split.where(F.col("split") == "train")
    model = MD.fit_pipeline("Logistic Regression", train, fast=True, exclude_features=("predicted_readmission_rate", "expected_readmission_rate"))
    wild = split.withColumn("predicted_readmission_rate", F.lit(1e9))
    a, b = ({r["row_id"]: r["probability"] for r in MD.score(model, d, "x").collect()} for d in (split, wild))
    assert a == b


def test_cross_validation_covers_all_rows_and_models(spark):
    folded = K.fold_frame(spark, SF_MID)
    assert folded.where("fold is null").count() == 0
    found = MD.cross_validate(["Logistic Regression", "Decision Tree"], folded, fast=True).collect()
    assert sorted((r["model"], r["fold"]) for r in found) == [(m, f) for m in ("Decision Tree", "Logistic Regression") for f in range(5)]
    assert all(0.5 < r["accuracy"] <= 1 for r in found)


def test_request_files_follow_the_data(spark, tmp_path):
    import glob
    req = _requests(spark).repartition(3)
    ST.write_request_files(req, str(tmp_path / "a"), rows_per_file=10)
    files = glob.glob(str(tmp_path / "a" / "*.parquet"))
    assert len(files) >= req.count() / 10
    assert spark.read.parquet(str(tmp_path / "a")).count() == req.count()


def _requests(spark):
    c = K.cleaned(spark, SF_MID)
    return ST.scoring_requests(c, row_id(c))


def test_stream_rules_equal_batch(spark):
    req = _requests(spark)
    folder = ST.write_request_files(req, shared_path(spark, "t-requests"))
    streamed = ST.run_available(ST.rule_scores(ST.request_stream(spark, folder)),
                                spark, "t-rules")
    batch = ST.rule_scores(req)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_model_equals_batch_and_unknowns(spark, split):
    model = MD.fit_pipeline("Logistic Regression", split, fast=True)
    path = shared_path(spark, "t-model")
    model.write().overwrite().save(path)
    loaded = MD.PipelineModel.load(path)
    req = _requests(spark)
    folder = ST.write_request_files(req, shared_path(spark, "t-requests"))
    streamed = ST.run_available(ST.model_scores(ST.request_stream(spark, folder), loaded, "LR"), spark, "t-lr")
    batch = ST.model_scores(req, model, "LR")
    s = {r[0]: (r[1], round(r[2], 9)) for r in streamed.select("request_id", "prediction", "probability").collect()}
    b = {r[0]: (r[1], round(r[2], 9)) for r in batch.select("request_id", "prediction", "probability").collect()}
    assert s == b
    assert s[-18][0] in (0, 1)  # unseen state and condition still score (zero one-hot vector)
