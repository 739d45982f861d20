"""Metrics golden cases, score edges and reason codes."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from txnscope.functions import scoring as P
from txnscope.operators import metrics as K
from txnscope.schema import FEATURE_NAMES
from txnscope.sources.tables import txn_view


def test_rates_golden_case(spark):
    # A published confusion matrix and its rates.
    cm = spark.createDataFrame([(19628, 4, 5, 467)], "tn long, fp long, fn long, tp long")
    r = K.rates_from_confusion(cm).first()
    assert r["accuracy"] == pytest.approx(0.9995523278949463, abs=1e-15)
    assert r["precision"] == pytest.approx(0.9915074309978769, abs=1e-15)
    assert r["recall"] == pytest.approx(0.989406779661017, abs=1e-15)
    assert r["f1"] == pytest.approx(0.9904559915164369, abs=1e-15)
    assert r["specificity"] == pytest.approx(0.9997962510187449, abs=1e-15)


def test_auc_ap_on_events_fixture(spark):
    t = txn_view(spark, SF_MID)
    r = K.auc_and_ap(t).first()
    assert r["roc_auc"] == pytest.approx(0.49915381, abs=5e-9)
    assert r["average_precision"] == pytest.approx(0.20134991, abs=5e-9)


def test_auc_brute_force_with_ties(spark):
    rows = [(s, y) for s, y in [(0.1, False), (0.4, True), (0.4, False), (0.35, True),
                                (0.8, True), (0.8, True), (0.2, False), (0.9, False)]]
    df = spark.createDataFrame(rows, "fraud_score double, is_fraud boolean")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert K.roc_auc(df, n_bins=4).first()["roc_auc"] == pytest.approx(want)
    # step-wise AP
    ths = sorted({s for s, _ in rows}, reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for s, y in rows if y and s >= t)
        fp = sum(1 for s, y in rows if not y and s >= t)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert K.average_precision(df, n_bins=4).first()["average_precision"] == pytest.approx(ap)


def test_sweep_has_numpy_arange_thresholds(spark):
    t = txn_view(spark, SF_MID)
    assert K.threshold_sweep(t, 0.1, 0.95, 0.05).count() == 17
    assert K.threshold_sweep(t, 0.1, 0.9, 0.05).count() == 16


def test_risk_level_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.5,), (0.75,), (0.2999,)], "fraud_score double")
    got = {r["fraud_score"]: (r["a"], r["b"]) for r in df.select(
        "fraud_score", P.risk_level().alias("a"), P.batch_risk_level().alias("b")).collect()}
    assert got[0.3] == ("MEDIUM", "LOW")
    assert got[0.7] == ("HIGH", "MEDIUM")
    assert got[0.75] == ("HIGH", "HIGH")
    assert got[0.2999] == ("LOW", "LOW")


QUIET_ROW = {f: 0.0 for f in FEATURE_NAMES} | {"time_since_last_tx": 90.0, "amount_raw": 310.0, "hour": 11.0, "user_avg_amount": 275.0}
RISKY_ROW = QUIET_ROW | {
    "amount_raw": 41200.0, "amount_3x_avg": 1.0, "tx_count_1h": 7.0, "tx_amount_24h": 93000.0, "tx_amount_1h": 88000.0,
    "user_total_amount": 120500.0, "is_night": 1.0, "high_amount_at_night": 1.0, "device_and_location_changed": 1.0,
    "is_new_receiver": 1.0, "new_receiver_large_amount": 1.0, "time_since_last_tx": 4.0,
    "device_changed_unusual_amount": 1.0, "high_velocity_large_amount": 1.0}


def _rows(spark, *rows):
    schema = ", ".join(f"{f} double" for f in FEATURE_NAMES)
    return spark.createDataFrame([tuple(float(r[f]) for f in FEATURE_NAMES) for r in rows], schema)


def test_reason_codes_golden_rows(spark):
    df = _rows(spark, RISKY_ROW, QUIET_ROW)
    got = [r["c"] for r in df.select(P.reason_codes(df).alias("c")).collect()]
    assert got[0] == ["AMOUNT_3X_USER_AVERAGE", "VERY_HIGH_TRANSACTION_VELOCITY",
                      "HIGH_AMOUNT_AT_UNUSUAL_HOUR", "DEVICE_AND_LOCATION_CHANGED",
                      "LARGE_AMOUNT_TO_NEW_RECEIVER", "RAPID_SUCCESSIVE_TRANSACTION",
                      "DEVICE_CHANGE_WITH_UNUSUAL_AMOUNT", "HIGH_VELOCITY_WITH_LARGE_AMOUNT"]
    assert got[1] == []


def test_missing_gap_counts_as_zero_and_first_row_switch(spark):
    df = spark.createDataFrame([(1.0,)], "user_tx_number double")
    assert df.select(P.reason_codes(df).alias("c")).first()["c"] == ["EXTREMELY_RAPID_SUCCESSIVE_TRANSACTION"]
    df2 = spark.createDataFrame([(1, 0.0)], "user_tx_number int, time_since_last_tx double")
    assert df2.select(P.reason_codes(df2, suppress_first_row_gap=True).alias("c")).first()["c"] == []


def test_top_contributions_order_and_skip_zero(spark):
    df = _rows(spark, RISKY_ROW)
    imp = {f: 1.0 for f in FEATURE_NAMES}
    top = df.select(P.top_contributions(df, imp, 3).alias("t")).first()["t"]
    assert [x["feature"] for x in top] == ["user_total_amount", "tx_amount_24h", "tx_amount_1h"]
    legit = _rows(spark, QUIET_ROW)
    t2 = legit.select(P.top_contributions(legit, imp, 50).alias("t")).first()["t"]
    assert all(x["value"] != 0 for x in t2)
    assert math.isclose(sum(1 for f in FEATURE_NAMES if QUIET_ROW[f] != 0), len(t2))


def test_batch_score_reasons_only_above_half(spark):
    df = _rows(spark, RISKY_ROW, RISKY_ROW).withColumn(
        "fraud_score", F.when(F.col("hour") >= 0, F.lit(0.4)))
    df = df.limit(1).unionByName(_rows(spark, RISKY_ROW).withColumn("fraud_score", F.lit(0.9)))
    out = [r.asDict() for r in P.batch_score(df, include_reasons=True).collect()]
    assert sorted(len(r["reason_codes"]) for r in out) == [0, 8]
