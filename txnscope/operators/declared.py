"""Request columns the reference declares but never computes.

The definitions are ours (from the field descriptions); all windows go
through the skew-safe ``time_window_features``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.functions.common import flag
from txnscope.operators.ranking import exclusive_prefix
from txnscope.operators.windows import time_window_features

X_WINDOWS = (("1h", 3600), ("6h", 6 * 3600), ("24h", 86400), ("7d", 7 * 86400))


def declared_columns(df: DataFrame, n_slices: int | None = None) -> DataFrame:
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double")
    w = time_window_features(
        df, windows=X_WINDOWS, n_slices=n_slices,
        running={"device_change_count": (yes("device_changed"), True),
                 "location_change_count": (yes("location_changed"), True),
                 "_fraud_prior": (yes("is_fraud"), False)},
        first_seen=True)
    a = F.col("amount").cast("double")
    # whole-table mean and std: a one-row aggregate
    stats = df.agg(F.avg("amount").alias("_mu"), F.stddev_samp("amount").alias("_sd"))
    # rank of the amount within the user's rows, two-level
    one = df.select("transaction_id", "user_id", F.col("amount").cast("double").alias("_a"),
                    F.lit(1).cast("long").alias("_one"))
    pr = exclusive_prefix(one, "_a", ["_one"], by=["user_id"], prefix="_lt")
    nu = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_nu"))
    pct = pr.join(nu, "user_id").select(
        "transaction_id",
        F.when(F.col("_nu") > 1, F.col("_lt_one").cast("double") / (F.col("_nu") - 1).cast("double")
               * F.lit(100.0)).otherwise(F.lit(0.0)).alias("amount_percentile"))
    j = w.crossJoin(F.broadcast(stats)).join(pct, "transaction_id")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    k = F.col("user_tx_number")
    avg = F.try_divide(F.col("user_total_amount"), k.cast("double"))
    ts = F.col("timestamp").cast("timestamp")
    return j.select(
        "transaction_id", "user_id",
        F.sqrt(a).alias("amount_sqrt"), (a * a).alias("amount_squared"),
        F.try_divide(a - F.col("_mu"), F.col("_sd")).alias("amount_zscore"),
        "amount_percentile",
        flag(F.try_mod(a, F.lit(100.0)) == 0).alias("is_round_amount"),
        flag(F.dayofmonth(ts) == 1).alias("is_month_start"),
        flag(F.to_date(ts) == F.last_day(ts)).alias("is_month_end"),
        F.col("tx_count_6h"), F.col("tx_count_7d"),
        F.col("tx_count_1h").alias("tx_velocity_1h"), F.col("tx_count_24h").alias("tx_velocity_24h"),
        F.when(k > 1, (us - F.col("user_first_us")).cast("double") / F.lit(60e6) / (k - 1).cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_tx_interval"),
        k.alias("user_tx_count"),
        F.when(avg > 0, (a - avg) / (F.col("user_std_amount") + F.lit(1.0))).otherwise(F.lit(0.0))
         .alias("amount_deviation_from_user"),
        F.when(k > 1, F.col("_fraud_prior") / (k - 1).cast("double")).otherwise(F.lit(0.0)).alias("user_fraud_rate"),
        F.col("device_change_count").cast("long").alias("device_change_count"),
        F.col("location_change_count").cast("long").alias("location_change_count"),
        flag((F.col("receiver_tx_count") == 0) & (a > F.lit(5000.0))).alias("new_receiver_high_amount"),
        flag(F.col("tx_count_1h") >= 3).alias("velocity_spike"),
        (a * F.col("tx_count_1h").cast("double")).alias("amount_velocity_interaction"),
    )
