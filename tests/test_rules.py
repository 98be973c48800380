"""Rule boundaries: thresholds hit exactly, NULL inputs."""
import pytest
from pyspark.sql import functions as F

from penalytics.operators import rules as R

SCHEMA = ("id long, measure_name string, number_of_discharges double, predicted_readmission_rate double, "
          "expected_readmission_rate double, number_of_readmissions double")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def drivers(spark, rows, fn, col):
    df = fn(frame(spark, rows), ["id"])
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append(r[col])
    return out


def test_v1_thresholds(spark):
    rows = [
        (1, "COPD", 1000.0, 16.0, 16.0, 150.0),   # pred == exp, share 0.15, disch 1000: only rule 5
        (2, "COPD", 1001.0, 17.0, 16.0, 151.0),   # all of 1-4
        (3, "COPD", None, None, None, None),      # nothing fires -> one NULL row
    ]
    got = drivers(spark, rows, R.driver_report_v1, "rule_no")
    assert got[1] == [5]
    assert got[2] == [1, 2, 3, 4]
    assert got[3] == [None]


def test_v2_up_to_four_and_none_without_inputs(spark):
    rows = [(i, "COPD", d, p, e, r) for i, (d, p, e, r) in enumerate([
        (100.0, 16.0, 16.0, 15.0), (99.0, 17.0, 16.0, 16.0), (None, None, None, None), (0.0, 16.0, 0.0, 0.0)])]
    got = drivers(spark, rows, R.driver_report_v2, "rule_no")
    assert got[0] == [1, 4] and got[1] == [1, 2, 3, 4]
    assert got[2] == [None] and got[3] == [1, 2, 4]


def test_v3_ranks_and_values(spark):
    rows = [(1, "Heart Failure (HF)", 20.0, 21.0, 20.0, 4.0)]  # ratio 1.05 exactly -> no rank 1
    got = R.driver_report_v3(frame(spark, rows), ["id"]).collect()
    ranks = [r["rank"] for r in got]
    assert ranks == sorted(ranks) and 1 not in ranks and 2 in ranks and 3 in ranks
    assert [r["value"] for r in got if r["rank"] == 2] == ["Heart Failure (HF)"]


def test_score_and_money(spark):
    rows = [(1, "COPD", 100.0, 18.0, 20.0, 10.0), (2, "Heart Failure (HF)", 10.0, 30.0, 20.0, 5.0)]
    got = {r["id"]: r for r in R.score_table(frame(spark, rows), ["id"]).collect()}
    assert got[1]["risk_score"] == pytest.approx((0.9 - 0.9) * 45)
    assert got[2]["risk_score"] == 100.0  # capped
    assert got[2]["payment_impact"] == pytest.approx(10.0 * 5200 * 100 / 100)
    assert got[2]["severity"] == "high" and got[2]["action_plan"] == "executive_alert"
    assert got[2]["heuristic_probability"] == pytest.approx(100 / 105)


@pytest.mark.parametrize("pred,exp,tier", [(15.0, 16.0, "maintain"), (17.0, 16.0, "targeted"), (19.0, 16.0, "hospital_wide"),
                                           (22.0, 16.0, "critical"), (16.5, 16.0, "precision"), (None, 16.0, None)])
def test_gap_tier_edges(spark, pred, exp, tier):
    df = frame(spark, [(1, "COPD", 100.0, pred, exp, 10.0)])
    assert R.index_exposure_table(df, ["id"]).first()["gap_tier"] == tier


def test_exposure_nonnegative_and_capped(spark):
    rows = [(i, "COPD", 100.0, p, 16.0, 10.0) for i, p in enumerate([10.0, 16.0, 16.4, 30.0])]
    out = R.index_exposure_table(frame(spark, rows), ["id"]).orderBy("id").collect()
    assert all(r["exposure_a"] >= 0 and r["exposure_b"] >= 0 for r in out)
    assert out[3]["exposure_b"] == pytest.approx(0.03 * 100 * 6000)
    assert out[0]["risk_index"] == 1.0 and out[3]["risk_index"] == 99.0


def test_zero_denominators_do_not_raise(spark):
    df = frame(spark, [(1, "COPD", 0.0, 16.0, 0.0, 0.0)])
    r = R.index_exposure_table(df, ["id"]).first()
    assert r["exposure_b"] is None and r["ratio_tier"] is None and r["threshold_flag"] == "Below Threshold"
    assert R.score_table(df, ["id"]).first()["risk_score"] is not None


def test_what_if_fanout(spark):
    df = frame(spark, [(1, "COPD", 100.0, 18.0, 16.0, 10.0), (2, "CABG", 50.0, 15.0, 16.0, 5.0)])
    out = R.what_if(df, ["id"])
    assert out.count() == 2 * len(R.DEFAULT_SCENARIOS)
    assert out.where(F.col("scenario").isNull()).count() == 0
    by = {(r["id"], r["scenario"]): r for r in out.collect()}
    half, twice = by[1, "pred+0_disch0.5x"], by[1, "pred+0_disch2x"]
    # readmissions follow the sliders, so their share doesn't jump with the volume
    assert (half["implied_readmissions"], twice["implied_readmissions"]) == (9.0, 36.0)
    assert half["readmission_pct"] == twice["readmission_pct"] == 18.0
    assert by[1, "pred+0_disch1x"]["drivers_v1"] == "1,2,3" and by[1, "pred+0_disch1x"]["drivers_v2"] == "1,2,3,4"


MISSING = [(1, "COPD", None, 16.0, 16.0, 5.0), (2, "COPD", 100.0, None, 16.0, 5.0),
           (3, "COPD", 100.0, 16.0, None, 5.0), (4, "COPD", 100.0, 16.0, 16.0, None)]


def test_missing_input_is_not_reported_as_safe(spark):
    score = {r["id"]: r for r in R.score_table(frame(spark, MISSING), ["id"]).collect()}
    for i in range(1, 5):
        assert score[i]["risk_score"] is None and score[i]["severity"] is None and score[i]["action_plan"] is None
        assert score[i]["heuristic_probability"] is None and score[i]["penalty_predicted"] is None
    index = {r["id"]: r for r in R.index_exposure_table(frame(spark, MISSING), ["id"]).collect()}
    for i in (2, 3):
        for name in ("risk_index", "risk_index_band", "penalty_rate", "exposure_a", "exposure_b", "gap_tier", "ratio_tier", "threshold_flag"):
            assert index[i][name] is None, name
    v2 = drivers(spark, MISSING, R.driver_report_v2, "rule_no")
    assert v2 == {1: [1], 2: [4], 3: [4], 4: [1, 4]}
    assert all(r["rank"] is None for r in R.driver_report_v3(frame(spark, MISSING[:1]), ["id"]).collect())


def test_volume_text_is_an_integer(spark):
    got = R.driver_report_v3(frame(spark, [(1, "COPD", 12.0, 30.0, 16.0, 5.0)]), ["id"]).collect()
    assert [r["value"] for r in got if r["rank"] == 3] == ["12"]


def test_confidence_of_probabilities(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.0, 0.29, 0.3, 0.5, 0.69, 0.7, 1.0, None])], "id long, probability double")
    got = R.probability_report(df, ["id"]).orderBy("id").collect()
    assert [r["probability_band"] for r in got] == ["low", "low", "medium", "medium", "medium", "high", "high", None]
    assert all(0.5 <= r["confidence"] <= 1 for r in got[:-1]) and got[-1]["confidence"] is None
    assert got[1]["probability_text"] == "29.0%"


def test_seeded_noise(spark):
    df = spark.range(4000).withColumn("score", F.lit(50.0))
    noisy = df.select("id", R.heuristic_probability(F.col("score"), R.seeded_noise(["id"])).alias("p"))
    row = noisy.agg(F.avg("p").alias("m"), F.stddev("p").alias("s"), F.max("p").alias("top")).first()
    assert abs(row["m"] - 50 / 105) < 0.005 and abs(row["s"] - 0.07) < 0.005 and row["top"] <= 0.97
    assert noisy.exceptAll(noisy).count() == 0
    other = df.select("id", R.heuristic_probability(F.col("score"), R.seeded_noise(["id"], seed=7)).alias("p"))
    assert noisy.intersect(other).count() < 5


@pytest.mark.parametrize("pred,exp,tier", [(22.0, 20.0, "medium"), (22.2, 20.0, "immediate"),
                                           (20.0, 20.0, "healthy"), (20.2, 20.0, "medium"), (None, 20.0, None)])
def test_ratio_tier_edges(spark, pred, exp, tier):
    df = frame(spark, [(1, "COPD", 100.0, pred, exp, 10.0)])
    assert R.index_exposure_table(df, ["id"]).first()["ratio_tier"] == tier


@pytest.mark.parametrize("readm,disch,fires", [(15.0, 100.0, False), (15.5, 100.0, True)])
def test_v2_readmission_share_edge(spark, readm, disch, fires):
    got = drivers(spark, [(1, "COPD", disch, 16.0, 16.0, readm)], R.driver_report_v2, "rule_no")
    assert (3 in got[1]) == fires
    assert 4 in got[1]  # volume row always present (100 -> adequate)


@pytest.mark.parametrize("disch,readm,rank3,rank4", [(25.0, 4.0, False, False), (24.0, 4.5, True, True)])
def test_v3_volume_and_readmission_edges(spark, disch, readm, rank3, rank4):
    # readm / disch * 100: 16% at (25, 4), 18.75% at (24, 4.5)
    got = R.driver_report_v3(frame(spark, [(1, "COPD", disch, 16.0, 16.0, readm)]), ["id"]).collect()
    ranks = {r["rank"] for r in got}
    assert (3 in ranks) == rank3 and (4 in ranks) == rank4


def test_v3_elite_edge(spark):
    # score = (1 - 0.9) * 45 + 0 + 0 + 0 = 4.5 < 35 -> rank 5 fires with value '4%' / '5%'
    got = R.driver_report_v3(frame(spark, [(1, "COPD", 1000.0, 16.0, 16.0, 10.0)]), ["id"]).collect()
    r5 = [r for r in got if r["rank"] == 5]
    assert len(r5) == 1 and r5[0]["risk"] == -8 and r5[0]["value"] == "4%"  # 4.5 -> half-even, as Python
