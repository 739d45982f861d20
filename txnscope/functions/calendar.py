"""Calendar features of the transaction timestamp (session TZ UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnscope.functions.common import flag


def calendar_columns(ts: Column | str = "timestamp") -> list[Column]:
    ts = F.col(ts) if isinstance(ts, str) else ts
    hour = F.hour(ts)
    dow = F.weekday(ts)          # Monday 0 ... Sunday 6
    two_pi = 2.0 * math.pi
    return [
        hour.cast("int").alias("hour"),
        dow.cast("int").alias("day_of_week"),
        flag(dow >= 5).alias("is_weekend"),
        flag((hour >= 22) | (hour <= 5)).alias("is_night"),
        flag((hour >= 0) & (hour <= 5)).alias("is_early_morning"),
        flag((hour >= 9) & (hour <= 17)).alias("is_business_hours"),
        F.sin(F.lit(two_pi) * hour / F.lit(24.0)).alias("hour_sin"),
        F.cos(F.lit(two_pi) * hour / F.lit(24.0)).alias("hour_cos"),
        F.sin(F.lit(two_pi) * dow / F.lit(7.0)).alias("day_sin"),
        F.cos(F.lit(two_pi) * dow / F.lit(7.0)).alias("day_cos"),
    ]
