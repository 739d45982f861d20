"""Amount features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnscope.functions.common import flag, log1p
from txnscope.schema import AMOUNT_EDGES


def amount_columns(amount: Column | str = "amount") -> list[Column]:
    a = F.col(amount) if isinstance(amount, str) else amount
    e1, e2, e3, e4 = (F.lit(x) for x in AMOUNT_EDGES)
    return [
        a.cast("double").alias("amount_raw"),
        log1p(a).alias("amount_log"),
        flag(a < e1).alias("amount_very_small"),
        flag((a >= e1) & (a < e2)).alias("amount_small"),
        flag((a >= e2) & (a < e3)).alias("amount_medium"),
        flag((a >= e3) & (a < e4)).alias("amount_large"),
        flag(a >= e4).alias("amount_very_large"),
    ]
