"""DuckDB oracle SQL for every registered query.

Each oracle rebuilds the HRRP view from the raw test tables with plain SQL
(FIXTURES.md F1/F2), so it shares nothing with the Spark code path.  Types
are cast explicitly so that DuckDB's HUGEINT sums and DECIMAL literals do not
differ from Spark's BIGINT / DOUBLE.
"""

from __future__ import annotations

FIXTURE_CTES = """
base AS (
  SELECT l.l_suppkey AS sk, s.s_name AS fname, s.s_nationkey AS nk,
         CASE p.p_type WHEN 'ECONOMY' THEN 'Acute Myocardial Infarction (AMI)' WHEN 'LARGE' THEN 'Heart Failure (HF)'
                 WHEN 'MEDIUM' THEN 'Pneumonia (PN)' WHEN 'PROMO' THEN 'COPD'
                 WHEN 'SMALL' THEN 'Hip/Knee Arthroplasty' ELSE 'CABG' END AS pt,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS r
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey),
nat AS (SELECT pt, sum(r) AS nr, count(*) AS nd FROM base GROUP BY pt),
f AS (SELECT sk, fname, nk, pt, count(*) AS d, sum(r) AS rd FROM base GROUP BY sk, fname, nk, pt),
g AS (
  SELECT f.sk, f.fname, f.nk, f.pt, f.rd, f.d,
         50.0e0*f.rd/f.d AS pred, 50.0e0*nat.nr/nat.nd AS expd,
         CASE WHEN f.sk % 7 = 0 THEN cast(floor(2*f.d/16.0e0) AS bigint)
              WHEN f.sk % 7 = 1 THEN 16*f.d
              WHEN f.sk % 7 = 2 THEN cast(floor(2*f.d/4.0e0) AS bigint) ELSE 2*f.d END AS vol,
         CASE WHEN f.sk % 7 = 0 THEN cast(floor(f.rd/16.0e0) AS bigint)
              WHEN f.sk % 7 = 1 THEN 8*f.rd
              WHEN f.sk % 7 = 2 THEN cast(floor(f.rd/4.0e0) AS bigint) ELSE f.rd END AS readm,
         CASE WHEN (f.sk*7 + f.rd) % 17 = 0 THEN 1 ELSE 0 END AS suppressed
  FROM f JOIN nat ON f.pt = nat.pt),
hrrp_raw AS (
  SELECT CASE WHEN sk < 100000 THEN lpad(cast(sk AS varchar), 6, '0') ELSE cast(sk AS varchar) END AS facility_id,
         fname AS facility_name,
         substr('ALAKAZARCACOCTDEFLGAHIIDILINIAKSKYLAMEMDMAMIMNMSMO', cast(nk*2+1 AS int), 2) AS state,
         pt AS measure_name,
         CASE WHEN d % 13 = 0 THEN CASE sk % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' ELSE 'N/A' END
              WHEN d % 11 = 0 THEN cast(vol AS varchar) || '.0' ELSE cast(vol AS varchar) END AS number_of_discharges,
         CASE WHEN suppressed = 1 THEN '5' WHEN (sk*5 + rd) % 7 = 0 THEN '29' ELSE cast(NULL AS varchar) END AS footnote,
         CASE WHEN suppressed = 1 THEN 'N/A' WHEN expd = 0 THEN NULL
              ELSE cast(cast(pred/expd AS decimal(10,4)) AS varchar) END AS excess_readmission_ratio,
         CASE WHEN suppressed = 1 THEN 'N/A' ELSE cast(cast(pred AS decimal(10,4)) AS varchar) END AS predicted_readmission_rate,
         CASE WHEN suppressed = 1 THEN 'N/A' ELSE cast(cast(expd AS decimal(10,4)) AS varchar) END AS expected_readmission_rate,
         CASE WHEN (sk*3 + rd) % 19 = 0 THEN 'Too Few to Report'
              WHEN (sk + rd) % 11 = 0 THEN CASE sk % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' ELSE 'N/A' END
              WHEN (sk + rd) % 13 = 0 THEN cast(readm AS varchar) || 'e0' ELSE cast(readm AS varchar) END AS number_of_readmissions,
         '07/01/2020' AS start_date, '06/30/2023' AS end_date
  FROM g),
hrrp_num AS (
  SELECT facility_id, facility_name, state, measure_name,
         try_cast(number_of_discharges AS double) AS number_of_discharges,
         footnote,
         try_cast(excess_readmission_ratio AS double) AS excess_readmission_ratio,
         try_cast(predicted_readmission_rate AS double) AS predicted_readmission_rate,
         try_cast(expected_readmission_rate AS double) AS expected_readmission_rate,
         try_cast(number_of_readmissions AS double) AS number_of_readmissions,
         start_date, end_date
  FROM hrrp_raw),
hrrp_clean AS (
  SELECT *, cast(excess_readmission_ratio > 1 AS integer) AS is_penalized
  FROM hrrp_num WHERE excess_readmission_ratio IS NOT NULL),
hrrp_model AS (
  SELECT state, measure_name, number_of_discharges, predicted_readmission_rate,
         expected_readmission_rate, number_of_readmissions, is_penalized
  FROM hrrp_clean)"""


def with_fixture(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the fixture CTEs (and optional extra CTEs)."""
    ctes = FIXTURE_CTES + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes.strip() + "\n" + body.strip()


def sql_list(values: list[str]) -> str:
    """Quoted, comma-separated SQL string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(p.strip() for p in parts)
