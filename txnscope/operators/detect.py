"""Q1-Q6: the generator's five fraud scenarios as detectors over real rows.

Hours, amounts and minimum counts follow the scenario definitions; window
lengths come from their spacing; the 80 % pass-on share is ours. Every
time window goes through the skew-safe ``time_window_features``.
Each detector returns the flagged rows: transaction_id, user_id,
timestamp, amount, is_fraud, detector, plus its evidence columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscope.operators.windows import time_window_features

# Scenario parameters.
SIM_SWAP_HOURS = [23, 0, 1, 2, 3, 4, 5]
NIGHT_HOURS = [2, 3, 4]

_OUT = ["transaction_id", "user_id", "timestamp", "amount", "is_fraud"]


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def detect_sim_swap(df: DataFrame, min_count: int = 3, window_s: int = 3600,
                    min_amount: float = 5000.0, hours=SIM_SWAP_HOURS) -> DataFrame:
    """Q1: device and location changed, night hour, large amount, and at
    least ``min_count`` such rows of the user within ``window_s`` (counting
    the row itself)."""
    cand = df.filter(_yes("device_changed") & _yes("location_changed")
                     & F.hour("timestamp").isin(hours) & (F.col("amount") >= min_amount))
    w = time_window_features(cand, windows=[("w", window_s)], history=False, gap=False,
                             receiver_col=None)
    burst = (F.col("tx_count_w") + 1).alias("burst_count")
    return (w.select(*_OUT, burst).filter(F.col("burst_count") >= min_count)
             .withColumn("detector", F.lit("sim_swap")))


def detect_velocity_attack(df: DataFrame, min_count: int = 8, window_s: int = 45 * 60,
                           low: float = 1000.0, high: float = 5000.0,
                           min_receivers: int = 3) -> DataFrame:
    """Q2: at least ``min_count`` medium-amount rows of the user within
    ``window_s`` going to at least ``min_receivers`` distinct receivers."""
    cand = df.filter(F.col("amount").between(low, high))
    w = time_window_features(cand, windows=[("w", window_s)], history=False, gap=False,
                             receiver_col=None, distinct_of="receiver")
    return (w.select(*_OUT, (F.col("tx_count_w") + 1).alias("burst_count"),
                     F.col("distinct_receiver_w").alias("n_receivers"))
             .filter((F.col("burst_count") >= min_count) & (F.col("n_receivers") >= min_receivers))
             .withColumn("detector", F.lit("velocity_attack")))


def detect_unusual_amount(df: DataFrame, min_amount: float = 20000.0) -> DataFrame:
    """Q3: a very large amount to a receiver the user never paid before."""
    first = df.groupBy("user_id", "receiver").agg(
        F.min_by(F.struct(*_OUT), F.struct(F.col("timestamp"), F.col("transaction_id"))).alias("first"))
    return (first.select("first.*", "receiver").filter(F.col("amount") >= min_amount)
                 .withColumn("detector", F.lit("unusual_amount")))


def detect_mule(df: DataFrame, min_senders: int = 5, window_s: int = 48 * 3600,
                pass_share: float = 0.8, account_of_receiver: Column | None = None) -> DataFrame:
    """Q4: an outgoing payment of an account that, within the previous
    ``window_s``, received from at least ``min_senders`` distinct senders
    and has now sent on at least ``pass_share`` of that inflow.

    Incoming and outgoing rows are re-keyed by account and flow through one
    skew-safe time-window pass (no pairwise self-join)."""
    acct = account_of_receiver if account_of_receiver is not None else F.col("receiver")
    incoming = df.select(acct.alias("account"), "timestamp",
                         F.concat(F.lit("I"), F.col("transaction_id")).alias("_eid"),
                         F.col("user_id").alias("sender"),
                         F.col("amount").cast("double").alias("amount_in"),
                         F.lit(0.0).alias("amount_out"),
                         F.lit(None).cast("string").alias("transaction_id"),
                         F.lit(None).cast("boolean").alias("is_fraud"))
    outgoing = df.select(F.col("user_id").alias("account"), "timestamp",
                         F.concat(F.lit("O"), F.col("transaction_id")).alias("_eid"),
                         F.lit(None).cast("string").alias("sender"),
                         F.lit(0.0).alias("amount_in"),
                         F.col("amount").cast("double").alias("amount_out"),
                         "transaction_id", "is_fraud")
    flow = incoming.unionByName(outgoing).filter(F.col("account").isNotNull())
    w = time_window_features(flow, windows=[("w", window_s)],
                             user_col="account", id_col="_eid", amount_col="amount_out",
                             history=False, gap=False, receiver_col=None,
                             sums={"inflow": "amount_in", "outflow": "amount_out"},
                             distinct_of="sender")
    out = w.filter(F.col("transaction_id").isNotNull()).select(
        "transaction_id", F.col("account").alias("user_id"), "timestamp",
        F.col("amount_out").alias("amount"), "is_fraud",
        F.col("inflow_w").alias("inflow"),
        (F.col("outflow_w") + F.col("amount_out")).alias("outflow"),
        F.col("distinct_sender_w").alias("n_senders"))
    return (out.filter((F.col("n_senders") >= min_senders) & (F.col("inflow") > 0)
                       & (F.col("outflow") >= F.lit(pass_share) * F.col("inflow")))
               .withColumn("detector", F.lit("mule_account")))


def detect_night(df: DataFrame, min_amount: float = 3000.0, hours=NIGHT_HOURS) -> DataFrame:
    """Q5: amount at or above ``min_amount`` at hour 2-4."""
    return (df.filter(F.hour("timestamp").isin(hours) & (F.col("amount") >= min_amount))
              .select(*_OUT).withColumn("detector", F.lit("night_transaction")))


def run_detectors(df: DataFrame, account_of_receiver: Column | None = None) -> DataFrame:
    """All five detectors, one row per (transaction, detector) hit."""
    parts = [detect_sim_swap(df), detect_velocity_attack(df), detect_unusual_amount(df),
             detect_mule(df, account_of_receiver=account_of_receiver), detect_night(df)]
    return parts[0].select("transaction_id", "is_fraud", "detector").unionByName(
        parts[1].select("transaction_id", "is_fraud", "detector")).unionByName(
        parts[2].select("transaction_id", "is_fraud", "detector")).unionByName(
        parts[3].select("transaction_id", "is_fraud", "detector")).unionByName(
        parts[4].select("transaction_id", "is_fraud", "detector"))


def pattern_summary(df: DataFrame, account_of_receiver: Column | None = None) -> DataFrame:
    """Q6: hits per detector and how many of them carry the fraud label."""
    hits = run_detectors(df, account_of_receiver)
    return (hits.groupBy("detector")
                .agg(F.count(F.lit(1)).alias("hits"), F.count_if(_yes("is_fraud")).alias("labelled_fraud"))
                .withColumn("label_share", F.col("labelled_fraud").cast("double") / F.col("hits").cast("double")))
