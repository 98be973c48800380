"""Stratified split / folds properties and feature estimators."""
import pytest
from pyspark.sql import functions as F

from penalytics.operators import features as FE
from penalytics.plans import catalog as K
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def split(spark):
    return FE.stratified_split(K.cleaned(spark, SF_MID), ["facility_id", "measure_name"]).cache()


def test_split_is_partition_with_exact_sizes(spark, split):
    n = K.cleaned(spark, SF_MID).count()
    assert split.count() == n
    assert split.select("facility_id", "measure_name").distinct().count() == n
    for r in split.groupBy("is_penalized").agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t")).collect():
        assert r["t"] == (2 * r["n"] + 5) // 10


def test_fold_sizes_differ_by_at_most_one(split):
    for r in split.where(F.col("split") == "train").groupBy("is_penalized").agg(
            F.min("fold").alias("lo"), F.max("fold").alias("hi")).collect():
        assert (r["lo"], r["hi"]) == (0, 4)
    sizes = split.where(F.col("split") == "train").groupBy("is_penalized", "fold").count().collect()
    by_cls = {}
    for r in sizes:
        by_cls.setdefault(r["is_penalized"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_cls.values())


def test_split_deterministic(spark, split):
    again = FE.stratified_split(K.cleaned(spark, SF_MID), ["facility_id", "measure_name"])
    a = {(r[0], r[1]): r[2] for r in split.select("facility_id", "measure_name", "split").collect()}
    b = {(r[0], r[1]): r[2] for r in again.select("facility_id", "measure_name", "split").collect()}
    assert a == b


@pytest.mark.parametrize("share, wanted", [(0.3, 300), (0.4, 400), (0.2, 200), (0, 0), (1, 1000), (0.125, 125)])
def test_asked_sizes(spark, share, wanted):
    df = spark.range(1000).withColumn("is_penalized", F.lit(1))
    out = FE.stratified_split(df, ["id"], test_fraction=share)
    assert out.where("split = 'test'").count() == wanted and out.count() == 1000


def test_rows_without_a_label_stay(spark):
    df = spark.range(100).withColumn("is_penalized", F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")))
    out = FE.stratified_split(df, ["id"])
    assert out.count() == 100 and out.where("is_penalized is null and split = 'test'").count() == 4


def test_weights_come_from_the_rows_of_the_fit(spark):
    from penalytics.operators import models as MD
    rows = K.split_frame(spark, SF_MID)
    changed = rows.withColumn("is_penalized", F.when(F.col("split") == "test", 1 - F.col("is_penalized")).otherwise(F.col("is_penalized")))
    facts = [MD.fit_facts(MD.labelled(d.where("split = 'train'")), MD.NUM_FEATURES, MD.CAT_FEATURES) for d in (rows, changed)]
    assert facts[0] == facts[1]
    counts = {float(r[0]): r[1] for r in rows.where("split = 'train'").groupBy("is_penalized").count().collect()}
    assert FE.balanced_weights(facts[0].classes) == {c: sum(counts.values()) / (2 * n) for c, n in counts.items()}


def test_prepared_features_equal_the_single_steps(spark):
    from pyspark.ml import PipelineModel
    from penalytics.operators import models as MD
    train = MD.labelled(K.split_frame(spark, SF_MID).where("split = 'train'"))
    stages, _ = MD.fit_preprocessing(train)
    out = PipelineModel(stages).transform(train)
    plain = FE.impute_frame(train, MD.NUM_FEATURES, MD.CAT_FEATURES)
    plain = FE.PopulationScaler(inputCols=MD.NUM_FEATURES).fit(plain).transform(plain)
    names = [c + "_scaled" for c in MD.NUM_FEATURES]
    a = {r["row_id"]: [r[c] for c in names] for r in out.collect()}
    b = {r["row_id"]: [r[c] for c in names] for r in plain.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    out = FE.ExactMedianImputer(inputCols=["x"]).fit(df).transform(df)
    assert sorted(r[0] for r in out.collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_mode_imputer_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out = FE.ModeImputer(inputCols=["s"]).fit(df).transform(df)
    assert sorted(r[0] for r in out.collect()) == ["a", "a", "a", "b", "b"]


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double")
    out = FE.PopulationScaler(inputCols=["x"]).fit(df).transform(df)
    vals = sorted(r["x_scaled"] for r in out.collect())
    sd = (8 / 3) ** 0.5
    assert vals == pytest.approx([-2 / sd, 0.0, 2 / sd])
    const = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r["x_scaled"] for r in FE.PopulationScaler(inputCols=["x"]).fit(const).transform(const).collect()] == [0.0, 0.0]


def test_one_hot_columns(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "y")], "id int, s string, t string")
    out = FE.one_hot_columns(df, ["s", "t"]).orderBy("id")
    assert out.columns == ["id", "s_a", "s_b", "t_x", "t_y"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 1, 1, 0), (1, 0, 0, 0), (0, 1, 0, 1)]
    with pytest.raises(ValueError, match="levels"):
        FE.one_hot_columns(df, ["s", "t"], max_levels=1)


def test_approx_options_close_to_exact(spark):
    from penalytics.operators import profile as PR
    c = K.cleaned(spark, SF_MID)
    exact = {r["column_name"]: r for r in PR.describe(c, ["predicted_readmission_rate"]).collect()}
    approx = {r["column_name"]: r for r in PR.describe(c, ["predicted_readmission_rate"], approx_quantiles=True).collect()}
    e, a = exact["predicted_readmission_rate"], approx["predicted_readmission_rate"]
    assert a["count"] == e["count"] and a["mean"] == pytest.approx(e["mean"])
    assert a["p50"] == pytest.approx(e["p50"], rel=0.05)
    s_exact = PR.dataset_stats(c).first()
    s_approx = PR.dataset_stats(c, approx=True).first()
    assert abs(s_approx["n_hospitals"] - s_exact["n_hospitals"]) <= 0.05 * s_exact["n_hospitals"]
