"""Risk rules, scores, money formulas and tiers.

Every rule is a column expression, applied set-wise to all hospital x
condition rows at once (the reference evaluates one form entry at a time).
Driver lists are ``array<struct>`` columns built with ``when`` + ``array_compact``;
``inline_outer`` turns them into report rows.  All divisions use
``try_divide`` so a zero denominator yields NULL instead of an ANSI error.

NULL semantics: a missing input gives a missing result.  No band, tier or flag
is given and no driver fires on what isn't known; a zero or negative denominator
that is known still gives the guarded ratio 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fixed, guarded_ratio, is_priority_condition, money, percent, prefix, safe_divide
from .clean import DISCHARGES, EXPECTED, MEASURE, PREDICTED, READMISSIONS

# ----------------------------------------------------------------------------
# Rule texts and constants that must equal the reference's.
# Drivers v1, in rule order: (driver, impact, explanation).
DRIVERS_V1 = [
    ("Predicted readmission rate above CMS benchmark", "↑ Increases Risk",
     "Observed readmission rate is higher than the CMS national expected rate."),
    ("Excess Readmission Ratio > 1", "↑ Direct CMS Penalty Trigger",
     "CMS penalties are applied when excess readmission ratio exceeds 1.0."),
    ("High readmissions per discharge", "↑ Increases Risk",
     "A large proportion of discharged patients are readmitted within 30 days."),
    ("High discharge volume", "↑ Higher Financial Exposure",
     "Higher discharge volume amplifies penalty impact under HRRP."),
    ("Readmission rate within expected range", "↓ Reduces Risk",
     "Hospital performance aligns with CMS benchmarks."),
]
DRIVERS_V1_CAP = 5
# Drivers v2: (driver, impact, reason); rules 1 and 4 have an "else" row.
DRIVERS_V2 = {
    "ratio_high": ("Excess Readmission Ratio > 1.0", "↑ Increases Risk",
                   "CMS automatically flags hospitals exceeding benchmark"),
    "ratio_ok": ("Excess Readmission Ratio ≤ 1.0", "↓ Reduces Risk", "Below CMS threshold"),
    "pred_high": ("Predicted Readmission Rate higher than Expected", "↑ Increases Risk",
                  "Observed outcomes worse than benchmark"),
    "readm_high": ("High Readmissions per Discharge", "↑ Increases Risk",
                   "Indicates poor post-discharge care continuity"),
    "volume_low": ("Low Case Volume", "↑ Increases Risk",
                   "Small hospitals more sensitive to performance swings"),
    "volume_ok": ("Adequate Case Volume", "↓ Reduces Risk",
                  "Stable patient base improves statistical reliability"),
}
# Drivers v3: (rank, factor, risk weight, action).
DRIVERS_V3 = [
    (1, "🚨 Excess Ratio CRITICAL", 40, "Emergency discharge protocol overhaul"),
    (2, "🎯 High Priority Condition", 28, "Specialty clinic follow-up"),
    (3, "📉 Low Volume Penalty", 22, "Volume stabilization strategy"),
    (4, "🔥 High Readmission Rate", 18, "72hr follow-up protocol"),
    (5, "🏆 Elite Performance", -8, "Benchmark excellence"),
]
# Thresholds and money constants.
V1_READM_SHARE = 0.15          # readmissions per discharge
V1_HIGH_VOLUME = 1000          # discharges
V2_READM_PCT = 15              # readmissions per 100 discharges
V2_LOW_VOLUME = 100
V3_RATIO = 1.05
V3_LOW_VOLUME = 25
V3_READM_PCT = 18
V3_ELITE_SCORE = 35
SCORE_CAP = 100
PAYMENT_PER_DISCHARGE_V3 = 5200
EXPOSURE_A_PER_DISCHARGE = 5000
EXPOSURE_B_PER_DISCHARGE = 6000
EXPOSURE_B_CAP = 0.03
HEURISTIC_PROB_CAP = 0.97
HEURISTIC_PROB_DIVISOR = 105
HEURISTIC_PROB_THRESHOLD = 0.68
# ----------------------------------------------------------------------------


def _null_double() -> Column:
    return F.lit(None).cast("double")


def ratio_guarded(pred: Column, exp: Column) -> Column:
    """pred / exp when exp > 0 else 0; NULL when either is missing."""
    return guarded_ratio(pred, exp)


def ratio_unguarded(pred: Column, exp: Column) -> Column:
    """pred / exp; NULL on a zero denominator (the reference would raise)."""
    return safe_divide(pred, exp)


def readmission_pct(readm: Column, disch: Column) -> Column:
    """readm / disch * 100 when disch > 0 else 0; NULL when either is missing."""
    return guarded_ratio(readm, disch) * 100


def _pos(x: Column) -> Column:
    """max(0, x); NULL stays NULL."""
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def _cap(x: Column, hi: float) -> Column:
    return F.when(x.isNull(), _null_double()).when(x > hi, F.lit(float(hi))).otherwise(x)


def _cols(pred=PREDICTED, exp=EXPECTED, readm=READMISSIONS, disch=DISCHARGES, cond=MEASURE):
    return F.col(pred), F.col(exp), F.col(readm), F.col(disch), F.col(cond)


# ---------------------------------------------------------------- R1 drivers v1

def drivers_v1(pred: Column, exp: Column, readm: Column, disch: Column) -> Column:
    conds = [
        pred > exp,
        (exp > 0) & (safe_divide(pred, exp) > 1),
        (disch > 0) & (safe_divide(readm, disch) > V1_READM_SHARE),
        disch > V1_HIGH_VOLUME,
        pred <= exp,
    ]
    items = [F.when(c, F.struct(F.lit(i + 1).alias("rule_no"), F.lit(d).alias("risk_driver"),
                                F.lit(im).alias("impact"), F.lit(ex).alias("explanation")))
             for i, (c, (d, im, ex)) in enumerate(zip(conds, DRIVERS_V1))]
    return F.slice(F.array_compact(F.array(*items)), 1, DRIVERS_V1_CAP)


# ---------------------------------------------------------------- R2 drivers v2

def drivers_v2(pred: Column, exp: Column, readm: Column, disch: Column) -> Column:
    ratio = ratio_guarded(pred, exp)
    rpct = readmission_pct(readm, disch)

    def item(no: int, key: str) -> Column:
        d, im, rs = DRIVERS_V2[key]
        return F.struct(F.lit(no).alias("rule_no"), F.lit(d).alias("driver"),
                        F.lit(im).alias("impact"), F.lit(rs).alias("reason"))

    items = [
        F.when(ratio > 1, item(1, "ratio_high")).when(ratio <= 1, item(1, "ratio_ok")),
        F.when(pred > exp, item(2, "pred_high")),
        F.when(rpct > V2_READM_PCT, item(3, "readm_high")),
        F.when(disch < V2_LOW_VOLUME, item(4, "volume_low")).when(disch >= V2_LOW_VOLUME, item(4, "volume_ok")),
    ]
    return F.array_compact(F.array(*items))


# ---------------------------------------------------------------- R3 score, R4 drivers v3

def risk_score_v3(pred: Column, exp: Column, readm: Column, disch: Column, cond: Column) -> Column:
    return score_from(ratio_guarded(pred, exp), readmission_pct(readm, disch), disch, cond)


def score_from(ratio: Column, rpct: Column, disch: Column, cond: Column) -> Column:
    """R3 from an already computed guarded ratio and readmission percentage."""
    raw = ((ratio - 0.9) * 45
           + _pos(rpct - 15) * 3
           + _pos((F.lit(25.0) - disch) / 3) * 12
           + F.when(is_priority_condition(cond), F.lit(30.0)).otherwise(F.lit(0.0)))
    return _cap(raw, SCORE_CAP)


def drivers_v3_from(ratio: Column, rpct: Column, score: Column, disch: Column, cond: Column) -> Column:
    conds_values = [
        (ratio > V3_RATIO, F.concat(fixed(ratio, 2), F.lit("x"))),
        (is_priority_condition(cond), prefix(cond, 25)),
        (disch < V3_LOW_VOLUME, fixed(disch, 0)),
        (rpct > V3_READM_PCT, F.concat(fixed(rpct, 1), F.lit("%"))),
        (score < V3_ELITE_SCORE, F.concat(fixed(score, 0), F.lit("%"))),
    ]
    items = [F.when(c, F.struct(F.lit(rank).alias("rank"), F.lit(factor).alias("factor"),
                                v.alias("value"), F.lit(risk).alias("risk"), F.lit(action).alias("action")))
             for (c, v), (rank, factor, risk, action) in zip(conds_values, DRIVERS_V3)]
    return F.array_sort(F.array_compact(F.array(*items)))


def payment_impact(disch: Column, score: Column) -> Column:
    """Discharges x 5200 x score / 100."""
    return disch * PAYMENT_PER_DISCHARGE_V3 * score / 100


def severity_band(score: Column) -> Column:
    """>75 high, >50 medium, else low."""
    return F.when(score > 75, "high").when(score > 50, "medium").when(score.isNotNull(), "low")


def executive_action(score: Column) -> Column:
    """The action plan key."""
    return F.when(score > 75, "executive_alert").when(score.isNotNull(), "sustain_excellence")


def heuristic_probability(score: Column, noise: Column | None = None) -> Column:
    """min(0.97, score / 105 + noise).  Without ``noise`` (the default) it is deterministic;
    it has no lower bound, so it is no probability for R13 and R16."""
    value = score / HEURISTIC_PROB_DIVISOR
    return _cap(value if noise is None else value + noise, HEURISTIC_PROB_CAP)


def seeded_noise(key: list[str], seed: int = 42, deviation: float = 0.07) -> Column:
    """The normal noise term of R14 from a hash of the row's key (Box-Muller), so a row
    keeps its noise in every run and every recomputed task."""
    def uniform(n: int) -> Column:
        return (F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed), F.lit(n)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2)) * deviation


def probability_band(p: Column) -> Column:
    """[0,30) low, [30,70) medium, [70,100] high on p x 100."""
    pct = p * 100
    return F.when(pct < 30, "low").when(pct < 70, "medium").when(pct.isNotNull(), "high")


def confidence(p: Column) -> Column:
    """max(p, 1 - p)."""
    return F.when(p.isNull(), _null_double()).otherwise(F.greatest(p, 1 - p))


# ---------------------------------------------------------------- R6-R10, R17, R18

def risk_index(pred: Column, exp: Column) -> Column:
    """min(99, max(1, (ratio - 0.9) x 220))."""
    return risk_index_from(ratio_guarded(pred, exp))


def risk_index_from(ratio: Column) -> Column:
    x = (ratio - 0.9) * 220
    return _cap(F.when(x.isNull(), _null_double()).when(x < 1, F.lit(1.0)).otherwise(x), 99)


def risk_index_band(index: Column) -> Column:
    return F.when(index < 50, "Low Probability").when(index.isNotNull(), "High Probability")


def exposure_a(pred: Column, exp: Column, disch: Column) -> tuple[Column, Column]:
    """rate = max(0, ratio - 1) x 0.5; money = rate x discharges x 5000."""
    return exposure_a_from(ratio_guarded(pred, exp), disch)


def exposure_a_from(ratio: Column, disch: Column) -> tuple[Column, Column]:
    rate = _pos(ratio - 1) * 0.5
    return rate, rate * disch * EXPOSURE_A_PER_DISCHARGE


def exposure_b(pred: Column, exp: Column, disch: Column) -> Column:
    """min(max(ratio - 1, 0), 0.03) x discharges x 6000 (unguarded ratio)."""
    return exposure_b_from(ratio_unguarded(pred, exp), disch)


def exposure_b_from(ratio_u: Column, disch: Column) -> Column:
    over = ratio_u - 1
    mult = F.when(over.isNull(), _null_double()).when(over < 0, F.lit(0.0)).otherwise(over)
    return _cap(mult, EXPOSURE_B_CAP) * disch * EXPOSURE_B_PER_DISCHARGE


def gap_tier(pred: Column, exp: Column) -> Column:
    """Mitigation tier by gap = pred - exp; a missing gap stays NULL."""
    gap = pred - exp
    return (F.when(gap.isNull(), F.lit(None).cast("string"))
             .when(gap <= -1, "maintain")
             .when(gap < 1, "precision")
             .when(gap < 3, "targeted")
             .when(gap < 6, "hospital_wide")
             .otherwise("critical"))


def ratio_tier(pred: Column, exp: Column) -> Column:
    """>1.1 immediate, >1.0 medium, else healthy."""
    return ratio_tier_from(ratio_unguarded(pred, exp))


def ratio_tier_from(r: Column) -> Column:
    return F.when(r > 1.1, "immediate").when(r > 1.0, "medium").when(r.isNotNull(), "healthy")


def threshold_flag(pred: Column, exp: Column) -> Column:
    """Ratio above / below 1.0."""
    return threshold_flag_from(ratio_guarded(pred, exp))


def threshold_flag_from(ratio: Column) -> Column:
    return F.when(ratio > 1.0, "Above Threshold").when(ratio.isNotNull(), "Below Threshold")


def implied_readmissions(disch: Column, pred: Column) -> Column:
    """Round-half-even of discharges x predicted / 100."""
    return F.bround(disch * pred / 100, 0)


# ---------------------------------------------------------------- DataFrame-level operators
#
# The operators below compute shared intermediates (ratios, percentage, score,
# probability) in their own projection and refer to them by name.  Catalyst's
# CollapseProject does not re-inline a non-trivial alias used more than once,
# so each intermediate is evaluated once per row and the plan stays small.

def staged(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep... + inputs + _rg (guarded ratio), _ru (unguarded), _rp (readm %),
    _s (score), _pr (heuristic probability)."""
    p, e, r, d, c = _cols()
    base = df.select(*keep, PREDICTED, EXPECTED, READMISSIONS, DISCHARGES, MEASURE,
                     ratio_guarded(p, e).alias("_rg"), ratio_unguarded(p, e).alias("_ru"),
                     readmission_pct(r, d).alias("_rp"))
    scored = base.select("*", score_from(F.col("_rg"), F.col("_rp"), d, c).alias("_s"))
    return scored.select("*", heuristic_probability(F.col("_s")).alias("_pr"))


def driver_report_v1(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per (row, fired driver); rows with none keep one NULL row."""
    p, e, r, d, _ = _cols()
    return df.select(*key, F.inline_outer(drivers_v1(p, e, r, d)))


def driver_report_v2(df: DataFrame, key: list[str]) -> DataFrame:
    """R2: up to 4 rows per input row; a row of which nothing is known keeps one NULL row."""
    p, e, r, d, _ = _cols()
    return df.select(*key, F.inline_outer(drivers_v2(p, e, r, d)))


def driver_report_v3(df: DataFrame, key: list[str]) -> DataFrame:
    """Ranked drivers with value text, weight and action."""
    st = staged(df, key)
    arr = drivers_v3_from(F.col("_rg"), F.col("_rp"), F.col("_s"), F.col(DISCHARGES), F.col(MEASURE))
    return st.select(*key, F.inline_outer(arr))


def score_table(df: DataFrame, key: list[str]) -> DataFrame:
    """R3, R5, R11, R12, R14 and F11 for every row."""
    st = staged(df, key)
    score, prob, d, c = F.col("_s"), F.col("_pr"), F.col(DISCHARGES), F.col(MEASURE)
    return st.select(
        *key,
        score.alias("risk_score"),
        F.col("_rg").alias("excess_ratio"),
        F.col("_rp").alias("readmission_pct"),
        payment_impact(d, score).alias("payment_impact"),
        money(payment_impact(d, score)).alias("payment_text"),
        severity_band(score).alias("severity"),
        executive_action(score).alias("action_plan"),
        prob.alias("heuristic_probability"),
        (prob > HEURISTIC_PROB_THRESHOLD).alias("penalty_predicted"),
        (100 - prob * 100).cast("int").alias("safe_pct_int"),
        is_priority_condition(c).alias("priority_condition"))


def index_exposure_table(df: DataFrame, key: list[str]) -> DataFrame:
    """R6-R10, R17, R18 for every row."""
    p, e, r, d, _ = _cols()
    rg, ru = F.col("_rg"), F.col("_ru")
    base = df.select(*key, PREDICTED, EXPECTED, DISCHARGES,
                     ratio_guarded(p, e).alias("_rg"), ratio_unguarded(p, e).alias("_ru"))
    st = base.select("*", risk_index_from(rg).alias("_idx"))
    idx = F.col("_idx")
    rate_a, money_a = exposure_a_from(rg, d)
    return st.select(
        *key,
        idx.alias("risk_index"),
        risk_index_band(idx).alias("risk_index_band"),
        rate_a.alias("penalty_rate"),
        money_a.alias("exposure_a"),
        exposure_b_from(ru, d).alias("exposure_b"),
        (p - e).alias("gap"),
        gap_tier(p, e).alias("gap_tier"),
        ratio_tier_from(ru).alias("ratio_tier"),
        threshold_flag_from(rg).alias("threshold_flag"),
        implied_readmissions(d, p).alias("implied_readmissions"))


def profile_axes(df: DataFrame, key: list[str], benchmark: str = "benchmark_penalty_rate") -> DataFrame:
    """The five radar axes, long form (key..., axis, value)."""
    st = staged(df, key + [benchmark])
    r, d = F.col(READMISSIONS), F.col(DISCHARGES)
    axes = F.array(
        F.struct(F.lit("Penalty Risk").alias("axis"), F.col("_s").alias("value")),
        F.struct(F.lit("Excess Ratio").alias("axis"), (F.col("_rg") * 55).alias("value")),
        F.struct(F.lit("Volume").alias("axis"), (d / 60).alias("value")),
        F.struct(F.lit("Readmit Rate").alias("axis"),
                 (guarded_ratio(r, d) * 110).alias("value")),
        F.struct(F.lit("Benchmark").alias("axis"), (F.col(benchmark) * 1.2).alias("value")))
    return st.select(*key, F.inline(axes))


# Scenario grid for the what-if sweep: (scenario, change of the predicted rate in
# points, factor on discharges).  A fixed literal of 9 rows.
DEFAULT_SCENARIOS = [
    (f"pred{dp:+.0f}_disch{fd:g}x", float(dp), float(fd))
    for dp in (-1.0, 0.0, 1.0) for fd in (0.5, 1.0, 2.0)
]


def what_if(df: DataFrame, key: list[str], scenarios=DEFAULT_SCENARIOS) -> DataFrame:
    """Every row under every scenario; readmissions follow the sliders (R18), then R1-R18 apply.

    The grid is a literal array exploded per row (a fixed fan-out, no join).
    """
    grid = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(dp).alias("pred_delta"),
                              F.lit(fd).alias("disch_factor")) for n, dp, fd in scenarios])
    base = df.select(*key, PREDICTED, EXPECTED, DISCHARGES, MEASURE, F.inline(grid))
    moved = base.select(*key, "scenario", EXPECTED, MEASURE,
                        (F.col(PREDICTED) + F.col("pred_delta")).alias(PREDICTED),
                        (F.col(DISCHARGES) * F.col("disch_factor")).alias(DISCHARGES))
    moved = moved.withColumn(READMISSIONS, implied_readmissions(F.col(DISCHARGES), F.col(PREDICTED)))
    st = staged(moved, list(dict.fromkeys([*key, "scenario"])))
    p, e, r, d, c = _cols()
    rg, ru, score, prob = F.col("_rg"), F.col("_ru"), F.col("_s"), F.col("_pr")
    index = risk_index_from(rg)
    rate_a, money_a = exposure_a_from(rg, d)
    return st.select(
        *key, "scenario", r.alias("implied_readmissions"), F.col("_rp").alias("readmission_pct"),
        score.alias("risk_score"), payment_impact(d, score).alias("payment_impact"),
        severity_band(score).alias("severity"), executive_action(score).alias("action_plan"),
        prob.alias("heuristic_probability"),
        index.alias("risk_index"), risk_index_band(index).alias("risk_index_band"),
        rate_a.alias("penalty_rate"), money_a.alias("exposure_a"),
        exposure_b_from(ru, d).alias("exposure_b"),
        gap_tier(p, e).alias("gap_tier"), ratio_tier_from(ru).alias("ratio_tier"),
        threshold_flag_from(rg).alias("threshold_flag"),
        F.array_join(F.transform(drivers_v1(p, e, r, d), lambda x: x["rule_no"].cast("string")), ",").alias("drivers_v1"),
        F.array_join(F.transform(drivers_v2(p, e, r, d), lambda x: x["rule_no"].cast("string")), ",").alias("drivers_v2"),
        F.array_join(F.transform(drivers_v3_from(rg, F.col("_rp"), score, d, c), lambda x: x["rank"].cast("string")), ",").alias("drivers_v3"))


def probability_report(scored: DataFrame, keep: list[str], probability: str = "probability",
                       ratio: Column | None = None) -> DataFrame:
    """R13, R16 and the safe share of a model's probability, which lies in [0, 1]."""
    p = F.col(probability)
    out = [p.alias(probability), percent(p, 1).alias("probability_text"), probability_band(p).alias("probability_band"),
           confidence(p).alias("confidence"), (1 - p).alias("safe_probability")]
    if ratio is not None:
        out.append(threshold_flag_from(ratio).alias("threshold_flag"))
    return scored.select(*keep, *out)
