"""D1-D4 device/location flags and I1-I5 interaction features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnscope.functions.common import flag


def device_columns(device_changed: str = "device_changed",
                   location_changed: str = "location_changed") -> list[Column]:
    d = F.coalesce(F.col(device_changed), F.lit(False))
    loc = F.coalesce(F.col(location_changed), F.lit(False))
    return [
        flag(d).alias("device_changed_flag"),
        flag(loc).alias("location_changed_flag"),
        flag(d | loc).alias("device_or_location_changed"),
        flag(d & loc).alias("device_and_location_changed"),
    ]


def interaction_columns(amount: str = "amount") -> list[Column]:
    """Needs is_night, user_avg_amount, is_new_receiver, device_changed_flag,
    amount_2x_avg and tx_count_1h already on the row."""
    a = F.col(amount)
    return [
        flag((a > F.col("user_avg_amount") * F.lit(2.0)) & (F.col("is_night") == 1)).alias("high_amount_at_night"),
        flag((F.col("is_new_receiver") == 1) & (a > F.lit(5000.0))).alias("new_receiver_large_amount"),
        flag((F.col("device_changed_flag") == 1) & (F.col("amount_2x_avg") == 1)).alias("device_changed_unusual_amount"),
        flag((F.col("tx_count_1h") >= 3) & (a > F.lit(3000.0))).alias("high_velocity_large_amount"),
        flag((F.col("is_night") == 1) & (F.col("device_changed_flag") == 1)).alias("night_device_change"),
    ]
