"""The 43-feature job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.functions.amount import amount_columns
from txnscope.functions.calendar import calendar_columns
from txnscope.functions.common import flag, log1p
from txnscope.functions.flags import device_columns, interaction_columns
from txnscope.operators.windows import DEFAULT_WINDOWS, time_window_features
from txnscope.session import checkpoint_dir
from txnscope.schema import FEATURE_NAMES, ID_COLUMNS, LABEL, feature_type


def derived_history_columns() -> list:
    """Columns computed from the window outputs."""
    avg = F.col("user_avg_amount")
    a = F.col("amount")
    return [
        log1p(F.col("tx_amount_1h")).alias("tx_amount_1h_log"),
        log1p(F.col("tx_amount_24h")).alias("tx_amount_24h_log"),
        F.when(F.col("tx_count_24h") > 0,
               F.col("tx_amount_24h") / F.col("tx_count_24h").cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_tx_amount_24h"),
        F.when(avg > 0, (a - avg) / (F.col("user_std_amount") + F.lit(1.0)))
         .otherwise(F.lit(0.0)).alias("amount_deviation"),
        flag(a > F.lit(2.0) * avg).alias("amount_2x_avg"),
        flag(a > F.lit(3.0) * avg).alias("amount_3x_avg"),
        flag(F.col("receiver_tx_count") == 0).alias("is_new_receiver"),
    ]


def engineer_features(df: DataFrame, windows=DEFAULT_WINDOWS,
                      n_slices: int | None = None, checkpoint_input: bool = False) -> DataFrame:
    """raw transactions -> raw columns + the 43 features.

    One shuffle of the rows (by user, and by time slice for busy users, see
    ``time_window_features``); the point features are projections computed
    after the shuffle so they do not travel through it. The input is read
    twice (a sample of the keys, the rows) and its busy users' rows again for
    their carries; with ``checkpoint_input`` it is first written to the shared
    checkpoint folder, which pays if it is itself the result of a shuffle.
    """
    if checkpoint_input:
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    w = time_window_features(df, windows=windows, n_slices=n_slices)
    w = w.select("*", *calendar_columns("timestamp"), *amount_columns("amount"),
                 *device_columns(), *derived_history_columns())
    return w.select("*", *interaction_columns("amount"))


def feature_names() -> list[str]:
    """the 43 names in model order (a fresh list per call)."""
    return list(FEATURE_NAMES)


def select_features(df: DataFrame, keep_label: bool = True) -> DataFrame:
    """F3 / S2 projection: id columns + 43 features (+ label), typed."""
    cols = [F.col(c) for c in ID_COLUMNS if c in df.columns]
    cols += [F.col(n).cast(feature_type(n)).alias(n) for n in FEATURE_NAMES]
    if keep_label and LABEL in df.columns:
        cols.append(F.col(LABEL))
    return df.select(*cols)
