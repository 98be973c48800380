"""Oracle SQL for the rule queries (R1-R20), written as plain DuckDB SQL.

Thresholds, money constants and texts are written out here again and not
imported from the operators, so a wrong constant there shows as a difference.
A missing input gives a missing result.
"""

from __future__ import annotations

from .oracle import sql_list, union_all, with_fixture

KEY = "facility_id, measure_name"
BASE = """rr AS (SELECT facility_id, measure_name, predicted_readmission_rate AS p,
                 expected_readmission_rate AS e, number_of_readmissions AS rd,
                 number_of_discharges AS d FROM hrrp_clean)"""

BENCHMARK = """(VALUES ('Heart Failure (HF)', 32.5e0), ('Acute Myocardial Infarction (AMI)', 28.1e0), ('Pneumonia (PN)', 24.7e0),
  ('COPD', 22.3e0), ('Hip/Knee Arthroplasty', 18.9e0), ('CABG', 15.4e0)) AS bd(measure_name, benchmark_penalty_rate)"""


STATES = """(VALUES
  ('AL', 'Alabama'), ('AK', 'Alaska'), ('AZ', 'Arizona'), ('AR', 'Arkansas'),
  ('CA', 'California'), ('CO', 'Colorado'), ('CT', 'Connecticut'), ('DE', 'Delaware'),
  ('FL', 'Florida'), ('GA', 'Georgia'), ('HI', 'Hawaii'), ('ID', 'Idaho'),
  ('IL', 'Illinois'), ('IN', 'Indiana'), ('IA', 'Iowa'), ('KS', 'Kansas'),
  ('KY', 'Kentucky'), ('LA', 'Louisiana'), ('ME', 'Maine'), ('MD', 'Maryland'),
  ('MA', 'Massachusetts'), ('MI', 'Michigan'), ('MN', 'Minnesota'), ('MS', 'Mississippi'),
  ('MO', 'Missouri'), ('MT', 'Montana'), ('NE', 'Nebraska'), ('NV', 'Nevada'),
  ('NH', 'New Hampshire'), ('NJ', 'New Jersey'), ('NM', 'New Mexico'), ('NY', 'New York'),
  ('NC', 'North Carolina'), ('ND', 'North Dakota'), ('OH', 'Ohio'), ('OK', 'Oklahoma'),
  ('OR', 'Oregon'), ('PA', 'Pennsylvania'), ('RI', 'Rhode Island'), ('SC', 'South Carolina'),
  ('SD', 'South Dakota'), ('TN', 'Tennessee'), ('TX', 'Texas'), ('UT', 'Utah'),
  ('VT', 'Vermont'), ('VA', 'Virginia'), ('WA', 'Washington'), ('WV', 'West Virginia'),
  ('WI', 'Wisconsin'), ('WY', 'Wyoming'), ('DC', 'District of Columbia'), ('PR', 'Puerto Rico'),
  ('VI', 'Virgin Islands'), ('GU', 'Guam'), ('AS', 'American Samoa'), ('MP', 'Northern Mariana Islands'))"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ratio_g(p="p", e="e"):
    return f"(CASE WHEN {p} IS NULL OR {e} IS NULL THEN NULL WHEN {e} > 0 THEN {p} / {e} ELSE 0.0e0 END)"


def ratio_u(p="p", e="e"):
    return f"(CASE WHEN {e} = 0 THEN NULL ELSE {p} / {e} END)"


def rpct(rd="rd", d="d"):
    return f"(CASE WHEN {rd} IS NULL OR {d} IS NULL THEN NULL WHEN {d} > 0 THEN {rd} / {d} * 100 ELSE 0.0e0 END)"


def pos(x):
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) WHEN ({x}) IS NOT NULL THEN 0.0e0 END)"


def cap(x, hi):
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > {hi} THEN {float(hi)}e0 ELSE ({x}) END)"


def priority(c="measure_name"):
    return f"({c} LIKE '%HF%' OR {c} LIKE '%AMI%')"


def score(p="p", e="e", rd="rd", d="d", c="measure_name"):
    raw = (f"({ratio_g(p, e)} - 0.9e0) * 45 + {pos(rpct(rd, d) + ' - 15')} * 3 "
           f"+ {pos(f'(25.0e0 - {d}) / 3')} * 12 + (CASE WHEN {priority(c)} THEN 30.0e0 ELSE 0.0e0 END)")
    return cap(raw, 100)


DRIVERS_V1 = """(VALUES
  (1, 'Predicted readmission rate above CMS benchmark', '↑ Increases Risk',
   'Observed readmission rate is higher than the CMS national expected rate.'),
  (2, 'Excess Readmission Ratio > 1', '↑ Direct CMS Penalty Trigger',
   'CMS penalties are applied when excess readmission ratio exceeds 1.0.'),
  (3, 'High readmissions per discharge', '↑ Increases Risk',
   'A large proportion of discharged patients are readmitted within 30 days.'),
  (4, 'High discharge volume', '↑ Higher Financial Exposure',
   'Higher discharge volume amplifies penalty impact under HRRP.'),
  (5, 'Readmission rate within expected range', '↓ Reduces Risk',
   'Hospital performance aligns with CMS benchmarks.')) AS t(rule_no, risk_driver, impact, explanation)"""
DRIVERS_V2 = """(VALUES
  (11, 1, 'Excess Readmission Ratio > 1.0', '↑ Increases Risk', 'CMS automatically flags hospitals exceeding benchmark'),
  (12, 1, 'Excess Readmission Ratio ≤ 1.0', '↓ Reduces Risk', 'Below CMS threshold'),
  (20, 2, 'Predicted Readmission Rate higher than Expected', '↑ Increases Risk', 'Observed outcomes worse than benchmark'),
  (30, 3, 'High Readmissions per Discharge', '↑ Increases Risk', 'Indicates poor post-discharge care continuity'),
  (41, 4, 'Low Case Volume', '↑ Increases Risk', 'Small hospitals more sensitive to performance swings'),
  (42, 4, 'Adequate Case Volume', '↓ Reduces Risk', 'Stable patient base improves statistical reliability')
  ) AS t(code, rule_no, driver, impact, reason)"""
DRIVERS_V3 = """(VALUES
  (1, '🚨 Excess Ratio CRITICAL', 40, 'Emergency discharge protocol overhaul'),
  (2, '🎯 High Priority Condition', 28, 'Specialty clinic follow-up'),
  (3, '📉 Low Volume Penalty', 22, 'Volume stabilization strategy'),
  (4, '🔥 High Readmission Rate', 18, '72hr follow-up protocol'),
  (5, '🏆 Elite Performance', -8, 'Benchmark excellence')) AS t(rank, factor, risk, action)"""


def fired_v1(p="p", e="e", rd="rd", d="d") -> str:
    """List of the rules that fire, in order (NULL conditions don't)."""
    conds = [f"{p} > {e}", f"{e} > 0 AND {p} / {e} > 1", f"{d} > 0 AND {rd} / {d} > 0.15", f"{d} > 1000", f"{p} <= {e}"]
    return _fired(conds, range(1, 6))


def fired_v2(p="p", e="e", rd="rd", d="d") -> str:
    conds = [f"{ratio_g(p, e)} > 1", f"{ratio_g(p, e)} <= 1", f"{p} > {e}", f"{rpct(rd, d)} > 15", f"{d} < 100", f"{d} >= 100"]
    return _fired(conds, (11, 12, 20, 30, 41, 42))


def fired_v3(p="p", e="e", rd="rd", d="d") -> str:
    conds = [f"{ratio_g(p, e)} > 1.05", priority(), f"{d} < 25", f"{rpct(rd, d)} > 18", f"{score(p, e, rd, d)} < 35"]
    return _fired(conds, range(1, 6))


def _fired(conds, codes) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {n} END" for c, n in zip(conds, codes))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def drivers_v1_sql() -> str:
    return with_fixture(f"""
SELECT facility_id, measure_name, t.rule_no, t.risk_driver, t.impact, t.explanation
FROM (SELECT *, {fired_v1()} AS fired FROM rr) x
LEFT JOIN {DRIVERS_V1} ON list_contains(fired, t.rule_no)""", BASE)


def drivers_v2_sql() -> str:
    return with_fixture(f"""
SELECT facility_id, measure_name, t.rule_no, t.driver, t.impact, t.reason
FROM (SELECT *, {fired_v2()} AS fired FROM rr) x
LEFT JOIN {DRIVERS_V2} ON list_contains(fired, t.code)""", BASE)


def drivers_v3_sql() -> str:
    return with_fixture(f"""
SELECT facility_id, measure_name, t.rank, t.factor,
       CASE t.rank WHEN 1 THEN printf('%.2fx', {ratio_g()}) WHEN 2 THEN substr(measure_name, 1, 25)
            WHEN 3 THEN printf('%.0f', d) WHEN 4 THEN printf('%.1f%%', {rpct()}) WHEN 5 THEN printf('%.0f%%', {score()}) END AS value,
       t.risk, t.action
FROM (SELECT *, {fired_v3()} AS fired FROM rr) x
LEFT JOIN {DRIVERS_V3} ON list_contains(fired, t.rank)""", BASE)


def _severity(s="s"):
    return f"CASE WHEN {s} > 75 THEN 'high' WHEN {s} > 50 THEN 'medium' WHEN {s} IS NOT NULL THEN 'low' END"


def _action(s="s"):
    return f"CASE WHEN {s} > 75 THEN 'executive_alert' WHEN {s} IS NOT NULL THEN 'sustain_excellence' END"


def _threshold(r):
    return f"CASE WHEN {r} > 1.0 THEN 'Above Threshold' WHEN {r} IS NOT NULL THEN 'Below Threshold' END"


def _ratio_tier(r):
    return f"CASE WHEN {r} > 1.1 THEN 'immediate' WHEN {r} > 1.0 THEN 'medium' WHEN {r} IS NOT NULL THEN 'healthy' END"


def _index_band(idx):
    return f"CASE WHEN {idx} < 50 THEN 'Low Probability' WHEN {idx} IS NOT NULL THEN 'High Probability' END"


def score_table_sql() -> str:
    s = score()
    prob = cap(f"{s} / 105", 0.97)
    return with_fixture(f"""
SELECT {KEY}, s AS risk_score, {ratio_g()} AS excess_ratio, {rpct()} AS readmission_pct,
       d * 5200 * s / 100 AS payment_impact, '$' || format('{{:,.0f}}', d * 5200 * s / 100) AS payment_text,
       {_severity()} AS severity, {_action()} AS action_plan,
       pr AS heuristic_probability,
       pr > 0.68 AS penalty_predicted,
       cast(trunc(100 - pr * 100) AS integer) AS safe_pct_int,
       {priority()} AS priority_condition
FROM (SELECT *, {s} AS s, {prob} AS pr FROM rr) x""", BASE)


def _risk_index(p="p", e="e"):
    x = f"(({ratio_g(p, e)} - 0.9e0) * 220)"
    return cap(f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 1 THEN 1.0e0 ELSE {x} END", 99)


def _exposure_b(p="p", e="e", d="d"):
    over = f"({ratio_u(p, e)} - 1)"
    mult = f"CASE WHEN {over} IS NULL THEN NULL WHEN {over} < 0 THEN 0.0e0 ELSE {over} END"
    return f"{cap(mult, 0.03)} * {d} * 6000"


def _gap_tier(p="p", e="e"):
    g = f"({p} - {e})"
    return (f"(CASE WHEN {g} IS NULL THEN NULL WHEN {g} <= -1 THEN 'maintain' WHEN {g} < 1 THEN 'precision' "
            f"WHEN {g} < 3 THEN 'targeted' WHEN {g} < 6 THEN 'hospital_wide' ELSE 'critical' END)")


def index_exposure_sql() -> str:
    rate = f"({pos(ratio_g() + ' - 1')} * 0.5)"
    idx = _risk_index()
    return with_fixture(f"""
SELECT {KEY}, {idx} AS risk_index, {_index_band(idx)} AS risk_index_band,
       {rate} AS penalty_rate, {rate} * d * 5000 AS exposure_a,
       {_exposure_b()} AS exposure_b,
       p - e AS gap, {_gap_tier()} AS gap_tier,
       {_ratio_tier(ratio_u())} AS ratio_tier,
       {_threshold(ratio_g())} AS threshold_flag,
       round_even(d * p / 100, 0) AS implied_readmissions
FROM rr""", BASE)


def profile_axes_sql() -> str:
    rows = [("Penalty Risk", score(c="rr.measure_name")), ("Excess Ratio", f"{ratio_g()} * 55"), ("Volume", "d / 60"),
            ("Readmit Rate", "CASE WHEN rd IS NULL OR d IS NULL THEN NULL WHEN d > 0 THEN rd / d * 110 ELSE 0.0e0 END"),
            ("Benchmark", "bd.benchmark_penalty_rate * 1.2")]
    src = f"rr LEFT JOIN {BENCHMARK} ON rr.measure_name = bd.measure_name"
    parts = [f"SELECT rr.facility_id, rr.measure_name, {q(a)} AS axis, cast({v} AS double) AS value FROM {src}"
             for a, v in rows]
    return with_fixture(union_all(parts), BASE)


SCENARIOS = """(VALUES ('pred-1_disch0.5x', -1.0e0, 0.5e0), ('pred-1_disch1x', -1.0e0, 1.0e0), ('pred-1_disch2x', -1.0e0, 2.0e0),
  ('pred+0_disch0.5x', 0.0e0, 0.5e0), ('pred+0_disch1x', 0.0e0, 1.0e0), ('pred+0_disch2x', 0.0e0, 2.0e0),
  ('pred+1_disch0.5x', 1.0e0, 0.5e0), ('pred+1_disch1x', 1.0e0, 1.0e0), ('pred+1_disch2x', 1.0e0, 2.0e0)
  ) AS sc(scenario, pred_delta, disch_factor)"""


def what_if_sql() -> str:
    idx = _risk_index()
    rate = f"({pos(ratio_g() + ' - 1')} * 0.5)"
    rules = "array_to_string(list_transform({}, lambda x: cast({} AS varchar)), ',')"
    return with_fixture(f"""
SELECT {KEY}, scenario, rd AS implied_readmissions, {rpct()} AS readmission_pct,
       s AS risk_score, d * 5200 * s / 100 AS payment_impact, {_severity()} AS severity, {_action()} AS action_plan,
       {cap('s / 105', 0.97)} AS heuristic_probability,
       {idx} AS risk_index, {_index_band(idx)} AS risk_index_band, {rate} AS penalty_rate, {rate} * d * 5000 AS exposure_a,
       {_exposure_b()} AS exposure_b, {_gap_tier()} AS gap_tier, {_ratio_tier(ratio_u())} AS ratio_tier,
       {_threshold(ratio_g())} AS threshold_flag,
       {rules.format(fired_v1(), 'x')} AS drivers_v1, {rules.format(fired_v2(), 'x // 10')} AS drivers_v2,
       {rules.format(fired_v3(), 'x')} AS drivers_v3
FROM (SELECT *, {score()} AS s FROM moved) x""", BASE + f""",
moved AS (SELECT facility_id, measure_name, scenario, p, e, d, round_even(d * p / 100, 0) AS rd FROM (
  SELECT facility_id, measure_name, scenario, p + pred_delta AS p, e, d * disch_factor AS d FROM rr, {SCENARIOS}) y)""")


# FIXTURES F4, written out again: request id, condition, discharges, predicted, expected, readmissions.
REQUESTS = """(VALUES
  (-1, 'COPD', 500.0e0, 16.0e0, 0.0e0, 50.0e0), (-2, 'COPD', 0.0e0, 16.0e0, 16.0e0, 0.0e0),
  (-3, 'COPD', 25.0e0, 16.0e0, 16.0e0, 4.0e0), (-4, 'COPD', 100.0e0, 16.0e0, 16.0e0, 15.0e0),
  (-5, 'COPD', 1000.0e0, 16.0e0, 16.0e0, 150.0e0), (-6, 'Heart Failure (HF)', 400.0e0, 21.0e0, 20.0e0, 72.0e0),
  (-7, 'Heart Failure (HF)', 400.0e0, 22.0e0, 20.0e0, 60.0e0),
  (-8, 'Acute Myocardial Infarction (AMI)', 400.0e0, 15.0e0, 16.0e0, 60.0e0),
  (-9, 'Pneumonia (PN)', 400.0e0, 17.0e0, 16.0e0, 60.0e0), (-10, 'Pneumonia (PN)', 400.0e0, 19.0e0, 16.0e0, 60.0e0),
  (-11, 'Pneumonia (PN)', 400.0e0, 22.0e0, 16.0e0, 60.0e0), (-12, 'CABG', 400.0e0, 16.0e0, 16.0e0, 60.0e0),
  (-13, NULL, 400.0e0, 16.0e0, 16.0e0, 60.0e0), (-14, 'CABG', NULL, 16.0e0, 16.0e0, 60.0e0),
  (-15, 'CABG', 400.0e0, NULL, 16.0e0, 60.0e0), (-16, 'CABG', 400.0e0, 16.0e0, NULL, 60.0e0),
  (-17, 'CABG', 400.0e0, 16.0e0, 16.0e0, NULL), (-18, 'Unknown condition', 400.0e0, 16.0e0, 16.0e0, 60.0e0)
  ) AS t(request_id, measure_name, d, p, e, rd)"""


def stream_rules_sql() -> str:
    number = """(CASE measure_name WHEN 'Heart Failure (HF)' THEN 1 WHEN 'Acute Myocardial Infarction (AMI)' THEN 2
      WHEN 'Pneumonia (PN)' THEN 3 WHEN 'COPD' THEN 4 WHEN 'Hip/Knee Arthroplasty' THEN 5 WHEN 'CABG' THEN 6 END)"""
    rate = f"({pos(ratio_g() + ' - 1')} * 0.5)"
    return with_fixture(f"""
SELECT request_id, s AS risk_score, d * 5200 * s / 100 AS payment_impact, {_severity()} AS severity,
       {_risk_index()} AS risk_index, {rate} * d * 5000 AS exposure_a, {_exposure_b()} AS exposure_b,
       {_gap_tier()} AS gap_tier, {_ratio_tier(ratio_u())} AS ratio_tier,
       cast(len({fired_v1()}) AS integer) AS n_drivers_v1, cast(len({fired_v2()}) AS integer) AS n_drivers_v2
FROM (SELECT *, {score()} AS s FROM requests) x""", BASE + f""",
requests AS (SELECT cast(facility_id AS bigint) * 10 + {number} AS request_id, measure_name, d, p, e, rd FROM rr
  UNION ALL SELECT * FROM {REQUESTS})""")


__all__ = ["stream_rules_sql", "drivers_v1_sql", "drivers_v2_sql", "drivers_v3_sql", "score_table_sql",
           "index_exposure_sql", "profile_axes_sql", "what_if_sql", "sql_list"]
