"""Adapt an outside transaction table to the raw schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.operators.windows import DEFAULT_BUCKET, previous_values

# The adapter's renames and the columns it drops.
DEFAULT_RENAMES = {"transaction_date": "timestamp", "merchant": "receiver",
                   "device_type": "device_id"}
LOCATION_SOURCE = "country"
DEFAULT_DROP = ["transaction_time", "card_type", "card_last_4", "ip_address", "merchant_category", "user_age",
                "account_age_days", "transaction_count_24h", "avg_transaction_amount", "distance_from_last_transaction",
                "merchant_reputation_score", "is_weekend", "is_international", "country"]


def adapt_transactions(df: DataFrame, renames: dict | None = None,
                       location_source: str = LOCATION_SOURCE,
                       drop: list[str] | None = None, bucket_seconds: int = DEFAULT_BUCKET) -> DataFrame:
    """Rename columns, derive ``device_changed`` / ``location_changed`` from
    the previous row of the same user, drop unused columns (absent ones are
    ignored).

    A user's first row counts as changed (the reference compares against a
    missing value, which is 'not equal'); two NULLs compare as NULL and so
    as changed too. The previous row comes from the skew-safe bucketed lag.
    """
    renames = dict(DEFAULT_RENAMES if renames is None else renames)
    out = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    out = out.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if "location" not in out.columns and location_source in out.columns:
        out = out.withColumn("location", F.col(location_source))
    prev = previous_values(out, ["device_id", "location"], bucket_seconds=bucket_seconds)
    changed = lambda c: F.coalesce(F.col(c) != F.col(f"prev_{c}"), F.lit(True))
    out = (prev.withColumn("device_changed", changed("device_id"))
               .withColumn("location_changed", changed("location"))
               .drop("prev_device_id", "prev_location"))
    drop = DEFAULT_DROP if drop is None else drop
    out = out.drop(*[c for c in drop if c in out.columns])
    return out
