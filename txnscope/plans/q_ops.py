"""Registered scoring queries (P2-P7) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.functions import scoring as P
from txnscope.functions.common import snap, snap_sql as S
from txnscope.operators.features import engineer_features
from txnscope.plans.catalog import register
from txnscope.plans.sqltext import TXN_CTE, features_cte
from txnscope.schema import FEATURE_NAMES
from txnscope.sources.tables import txn_view

W = f"WITH {TXN_CTE}"
WF = f"WITH {features_cte()}"

_RISK = ("CASE WHEN fraud_score IS NULL THEN NULL WHEN fraud_score < 0.3 THEN 'LOW' "
         "WHEN fraud_score < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END")
_BRISK = ("CASE WHEN fraud_score IS NULL THEN NULL WHEN fraud_score <= 0.3 THEN 'LOW' "
          "WHEN fraud_score <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END")


@register("p2_decide_and_levels", f"""{W}
SELECT transaction_id, {S('fraud_score')} AS fraud_score,
  CAST(coalesce(fraud_score >= 0.75, false) AS INTEGER) AS decision,
  {_RISK} AS risk_level, {_BRISK} AS batch_risk_level FROM txn""")
def p2(spark, sf):
    t = txn_view(spark, sf)
    return t.select("transaction_id", snap(F.col("fraud_score")).alias("fraud_score"),
                    P.decide("fraud_score", 0.75).alias("decision"),
                    P.risk_level("fraud_score").alias("risk_level"),
                    P.batch_risk_level("fraud_score").alias("batch_risk_level"))


_K = len(FEATURE_NAMES)
_TOT = _K * (_K + 1) // 2
_P5_LONG = " UNION ALL ".join(
    f"SELECT transaction_id, {i} AS idx, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feat"
    for i, f in enumerate(FEATURE_NAMES))


@register("p5_top_contributions", f"""{WF}, l AS ({_P5_LONG}),
c AS (SELECT *, abs(value * (CAST({_K} - idx AS DOUBLE) / CAST({_TOT} AS DOUBLE))) AS contribution
      FROM l WHERE value IS NOT NULL AND value <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY contribution DESC, idx) AS rk FROM c),
t AS (SELECT * FROM r WHERE rk <= 5)
SELECT f.transaction_id, coalesce(string_agg(t.feature, ',' ORDER BY t.rk), '') AS top_features,
  {S('max(CASE WHEN t.rk = 1 THEN t.contribution END)')} AS top_contribution, count(t.idx) AS n_top
FROM feat f LEFT JOIN t USING (transaction_id) GROUP BY f.transaction_id""")
def p5(spark, sf):
    f = engineer_features(txn_view(spark, sf))
    arr = P.top_contributions(f, P.rule_importance(), 5)
    x = f.select("transaction_id", arr.alias("top"))
    return x.select("transaction_id",
                    F.array_join(F.transform("top", lambda e: e["feature"]), ",").alias("top_features"),
                    snap(F.col("top")[0]["contribution"]).alias("top_contribution"),
                    F.size("top").cast("long").alias("n_top"))


def _reason_sql(gate: str | None = None) -> str:
    g = [
        "CASE WHEN amount_3x_avg = 1 THEN 'AMOUNT_3X_USER_AVERAGE' WHEN amount_2x_avg = 1 THEN 'AMOUNT_2X_USER_AVERAGE' "
        "WHEN amount_deviation > 2 THEN 'AMOUNT_SIGNIFICANTLY_HIGHER_THAN_USUAL' END",
        "CASE WHEN tx_count_1h >= 5 THEN 'VERY_HIGH_TRANSACTION_VELOCITY' WHEN tx_count_1h >= 3 THEN 'HIGH_TRANSACTION_VELOCITY' END",
        "CASE WHEN high_amount_at_night = 1 THEN 'HIGH_AMOUNT_AT_UNUSUAL_HOUR' WHEN is_night = 1 THEN 'TRANSACTION_AT_NIGHT' END",
        "CASE WHEN device_and_location_changed = 1 THEN 'DEVICE_AND_LOCATION_CHANGED' WHEN device_changed_flag = 1 "
        "THEN 'DEVICE_CHANGE_DETECTED' WHEN location_changed_flag = 1 THEN 'LOCATION_CHANGE_DETECTED' END",
        "CASE WHEN new_receiver_large_amount = 1 THEN 'LARGE_AMOUNT_TO_NEW_RECEIVER' WHEN is_new_receiver = 1 AND amount_raw > 5000 "
        "THEN 'SIGNIFICANT_AMOUNT_TO_NEW_RECEIVER' WHEN is_new_receiver = 1 THEN 'NEW_RECEIVER' END",
        "CASE WHEN time_since_last_tx < 2 THEN 'EXTREMELY_RAPID_SUCCESSIVE_TRANSACTION' WHEN time_since_last_tx < 5 "
        "THEN 'RAPID_SUCCESSIVE_TRANSACTION' END",
        "CASE WHEN device_changed_unusual_amount = 1 THEN 'DEVICE_CHANGE_WITH_UNUSUAL_AMOUNT' END",
        "CASE WHEN high_velocity_large_amount = 1 THEN 'HIGH_VELOCITY_WITH_LARGE_AMOUNT' END",
    ]
    body = f"concat_ws(',', {', '.join(g)})"
    return body if gate is None else f"CASE WHEN {gate} THEN {body} ELSE '' END"


@register("p6_reason_codes", f"{WF} SELECT transaction_id, {_reason_sql()} AS reason_codes FROM feat")
def p6(spark, sf):
    f = engineer_features(txn_view(spark, sf))
    return f.select("transaction_id", F.array_join(P.reason_codes(f), ",").alias("reason_codes"))


@register("p7_batch_score", f"""{WF}
SELECT transaction_id, CAST(coalesce(fraud_score >= 0.5, false) AS INTEGER) AS is_fraud,
  {S('fraud_score')} AS fraud_score, {_BRISK} AS risk_level,
  {_reason_sql('fraud_score >= 0.5')} AS reason_codes FROM feat""")
def p7(spark, sf):
    f = engineer_features(txn_view(spark, sf))
    b = P.batch_score(f, "fraud_score", 0.5, include_reasons=True)
    return b.select("transaction_id", "is_fraud", snap(F.col("fraud_score")).alias("fraud_score"),
                    "risk_level", F.array_join("reason_codes", ",").alias("reason_codes"))
