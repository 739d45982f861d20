"""Schemas, the fixed feature order and other values that must match the
reference's behaviour."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw transaction (input of feature engineering).
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("receiver", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("device_changed", T.BooleanType()),
    T.StructField("location_changed", T.BooleanType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("fraud_pattern", T.StringType()),
])

ID_COLUMNS = ["transaction_id", "user_id", "timestamp"]
LABEL = "is_fraud"

# --- Fixed values (must equal the reference's) ------------------------------
# The 43 model features, in model order.
FEATURE_NAMES = [
    "hour", "day_of_week", "is_weekend", "is_night", "is_early_morning",
    "is_business_hours", "hour_sin", "hour_cos", "day_sin", "day_cos",
    "amount_raw", "amount_log", "amount_very_small", "amount_small",
    "amount_medium", "amount_large", "amount_very_large",
    "tx_count_1h", "tx_count_24h", "tx_amount_1h", "tx_amount_24h",
    "tx_amount_1h_log", "tx_amount_24h_log", "time_since_last_tx",
    "avg_tx_amount_24h",
    "user_tx_number", "user_total_amount", "user_avg_amount",
    "user_std_amount", "amount_deviation", "amount_2x_avg", "amount_3x_avg",
    "is_new_receiver", "receiver_tx_count",
    "device_changed_flag", "location_changed_flag",
    "device_or_location_changed", "device_and_location_changed",
    "high_amount_at_night", "new_receiver_large_amount",
    "device_changed_unusual_amount", "high_velocity_large_amount",
    "night_device_change",
]

# Feature groups used for importance roll-ups (category -> features).
FEATURE_CATEGORIES = {
    "time": FEATURE_NAMES[0:10],
    "amount": FEATURE_NAMES[10:17],
    "velocity": FEATURE_NAMES[17:25],
    "user_history": FEATURE_NAMES[25:32],
    "receiver": FEATURE_NAMES[32:34],
    "device_location": FEATURE_NAMES[34:38],
    "interaction": FEATURE_NAMES[38:43],
}

# Amount bin edges: very_small < 100 <= small < 1000 <= medium < 5000
# <= large < 20000 <= very_large.
AMOUNT_EDGES = (100.0, 1000.0, 5000.0, 20000.0)

# Risk levels: score < 0.3 LOW, < 0.7 MEDIUM, else HIGH.
RISK_LOW, RISK_HIGH = 0.3, 0.7
DEFAULT_THRESHOLD = 0.5
REASON_SCORE_FLOOR = 0.5

# Fraud scenario names.
FRAUD_PATTERNS = ["sim_swap", "velocity_attack", "unusual_amount",
                  "mule_account", "night_transaction"]

# Cost model of the notebook's cost analysis.
COST_FALSE_NEGATIVE = 8500.0
COST_FALSE_POSITIVE = 50.0

# Defaults of the raw scoring request for unknown history.
RAW_REQUEST_DEFAULTS = {
    "user_avg_amount": 500.0,
    "user_std_amount": 200.0,
    "user_tx_number": 1,
    "tx_count_1h": 0,
    "tx_count_24h": 0,
    "tx_amount_1h": 0.0,
    "tx_amount_24h": 0.0,
    "time_since_last_tx": 3600.0,
    "receiver_tx_count": 0,
}
# ---------------------------------------------------------------------------

INT_FEATURES = {
    "hour", "day_of_week", "is_weekend", "is_night", "is_early_morning",
    "is_business_hours", "amount_very_small", "amount_small", "amount_medium",
    "amount_large", "amount_very_large", "amount_2x_avg", "amount_3x_avg",
    "is_new_receiver", "device_changed_flag", "location_changed_flag",
    "device_or_location_changed", "device_and_location_changed",
    "high_amount_at_night", "new_receiver_large_amount",
    "device_changed_unusual_amount", "high_velocity_large_amount",
    "night_device_change",
}
LONG_FEATURES = {"tx_count_1h", "tx_count_24h", "user_tx_number",
                 "receiver_tx_count"}


def feature_type(name: str) -> T.DataType:
    if name in INT_FEATURES:
        return T.IntegerType()
    if name in LONG_FEATURES:
        return T.LongType()
    return T.DoubleType()


def feature_names() -> list[str]:
    """A fresh copy of the 43 names (callers may mutate it)."""
    return list(FEATURE_NAMES)
