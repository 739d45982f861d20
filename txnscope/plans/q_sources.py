"""Registered source/adapter/row-check/point-feature/declared-column
queries (S1-S4, S6, S7, B1-B3, X) with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txnscope.functions.common import snap_sql as S
from txnscope.operators.declared import declared_columns
from txnscope.operators.features import engineer_features
from txnscope.operators.point import build_point_features, enrich_with_profile, user_profile
from txnscope.plans.catalog import register
from txnscope.plans.checked import snap_doubles
from txnscope.plans.sqltext import TXN_CTE, checked_feature_select, feature_exprs_sql, features_cte, sql_type
from txnscope.schema import FEATURE_NAMES
from txnscope.session import checkpoint_dir
from txnscope.sources.adapt import adapt_transactions
from txnscope.sources.io import read_features, read_transactions, write_features
from txnscope.sources.tables import txn_view
from txnscope.sources.validate import complete_features, validate

W = f"WITH {TXN_CTE}"
WF = f"WITH {features_cte()}"
RAW_COLS = ["transaction_id", "user_id", "timestamp", "amount", "receiver", "device_id",
            "location", "device_changed", "location_changed", "is_fraud", "fraud_pattern"]


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s1_read_csv", f"""{W} SELECT transaction_id, user_id, {S('amount')} AS amount, receiver, device_id, location,
  device_changed, location_changed, is_fraud, fraud_pattern, CAST(epoch_us(timestamp) AS BIGINT) AS us FROM txn""")
def s1(spark, sf):
    path = _scratch(spark, "raw-csv")
    (txn_view(spark, sf).select(*RAW_COLS).write.option("header", True)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    r = read_transactions(spark, path, "csv")
    return snap_doubles(r.select(*[c for c in RAW_COLS if c != "timestamp"],
                                 F.unix_micros("timestamp").alias("us")))


@register("s2_s3_feature_roundtrip", f"""WITH {features_cte()}
SELECT transaction_id, user_id, is_fraud, {checked_feature_select()} FROM feat""")
def s23(spark, sf):
    path = _scratch(spark, "features")
    write_features(engineer_features(txn_view(spark, sf)), path)
    back = read_features(spark, path).drop("event_date")
    return snap_doubles(back.drop("timestamp"))


_OUTSIDE = ("transaction_id", "user_id", "transaction_date", "amount", "merchant", "device_type",
            "country", "is_fraud")


@register("s4_adapt_transactions", f"""{W}
SELECT transaction_id, user_id, receiver, device_id, location,
  coalesce(device_id <> lag(device_id) OVER w, true) AS device_changed,
  coalesce(location <> lag(location) OVER w, true) AS location_changed
FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id)""")
def s4(spark, sf):
    t = txn_view(spark, sf)
    outside = t.select("transaction_id", "user_id", F.col("timestamp").alias("transaction_date"),
                       "amount", F.col("receiver").alias("merchant"),
                       F.col("device_id").alias("device_type"), F.col("location").alias("country"),
                       "is_fraud", F.lit("x").alias("merchant_category"))
    return adapt_transactions(outside).drop("timestamp", "amount", "is_fraud")


def _raw_requests(spark, sf):
    """Raw scoring requests: each transaction with its windowed history as
    the caller-supplied context."""
    f = engineer_features(txn_view(spark, sf))
    return f.select("transaction_id", "user_id", "amount", "timestamp", "receiver", "device_id",
                    "device_changed", "location_changed", "user_avg_amount", "user_std_amount",
                    "user_tx_number", "tx_count_1h", "tx_count_24h", "tx_amount_1h", "tx_amount_24h",
                    "time_since_last_tx", "receiver_tx_count")


@register("s6_validate_requests", f"""{WF}
SELECT transaction_id, concat_ws(';',
  CASE WHEN user_id IS NULL THEN 'user_id: required' END,
  CASE WHEN amount IS NULL THEN 'amount: required' END,
  CASE WHEN timestamp IS NULL THEN 'timestamp: required' END,
  CASE WHEN receiver IS NULL THEN 'receiver: required' END,
  CASE WHEN device_id IS NULL THEN 'device_id: required' END,
  CASE WHEN NOT amount > 0 THEN 'amount: must be > 0.0' END,
  CASE WHEN NOT user_avg_amount > 0 THEN 'user_avg_amount: must be > 0.0' END,
  CASE WHEN NOT user_std_amount >= 0 THEN 'user_std_amount: must be >= 0.0' END,
  CASE WHEN NOT user_tx_number >= 1 THEN 'user_tx_number: must be >= 1' END,
  CASE WHEN NOT tx_count_1h >= 0 THEN 'tx_count_1h: must be >= 0' END,
  CASE WHEN NOT tx_count_24h >= 0 THEN 'tx_count_24h: must be >= 0' END,
  CASE WHEN NOT tx_amount_1h >= 0 THEN 'tx_amount_1h: must be >= 0.0' END,
  CASE WHEN NOT tx_amount_24h >= 0 THEN 'tx_amount_24h: must be >= 0.0' END,
  CASE WHEN NOT time_since_last_tx >= 0 THEN 'time_since_last_tx: must be >= 0.0' END,
  CASE WHEN NOT receiver_tx_count >= 0 THEN 'receiver_tx_count: must be >= 0' END) AS errors,
  CASE WHEN amount > 0 AND user_avg_amount > 0 THEN 'accepted' ELSE 'rejected' END AS status
FROM feat""")
def s6(spark, sf):
    acc, rej = validate(_raw_requests(spark, sf), "raw")
    a = acc.select("transaction_id", F.lit("").alias("errors"), F.lit("accepted").alias("status"))
    r = rej.select("transaction_id", F.array_join("errors", ";").alias("errors"), F.lit("rejected").alias("status"))
    return a.unionByName(r)


# Feature requests with planted faults, told by the event's number.
_S6B = f"""{W}, r AS (SELECT transaction_id, CAST(substr(transaction_id, 2) AS BIGINT) AS e FROM txn)
SELECT transaction_id, concat_ws(';',
  CASE WHEN e % 7 = 0 THEN 'amount: must be a finite number' END,
  CASE WHEN e % 7 <> 0 AND e % 11 = 0 THEN 'amount: must be positive' END,
  CASE WHEN e % 7 = 0 OR (e % 11 <> 0 AND e % 13 = 0) THEN 'amount: exceeds maximum allowed' END,
  CASE WHEN e % 3 = 2 THEN 'velocity_spike: must be in [0, 1]' END,
  CASE WHEN e % 5 = 0 THEN 'tx_count_6h: must be >= 0' END,
  CASE WHEN e % 4 = 0 THEN 'user_tx_count: must be >= 1' END) AS errors
FROM r"""


@register("s6b_feature_requests", _S6B, "feature requests: presence, ranges and numbers that are none")
def s6b(spark, sf):
    from txnscope.functions.calendar import calendar_columns
    from txnscope.sources.validate import with_feature_defaults
    t = txn_view(spark, sf)
    e = F.expr("bigint(substr(transaction_id, 2))")
    amount = (F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 11 == 0, F.lit(-1.0)).when(e % 13 == 0, F.lit(1e9))
              .otherwise(F.col("amount")))
    req = t.select("transaction_id", *calendar_columns("timestamp"), F.log1p("amount").alias("amount_log"),
                   F.sqrt("amount").alias("amount_sqrt"), (F.col("amount") * F.col("amount")).alias("amount_squared"),
                   amount.alias("amount"), (e % 3).alias("velocity_spike"), (e % 5 - 1).alias("tx_count_6h"), (e % 4).alias("user_tx_count"))
    accepted, rejected = validate(with_feature_defaults(req), "feature")
    return (accepted.select("transaction_id", F.lit("").alias("errors"))
            .unionByName(rejected.select("transaction_id", F.array_join("errors", ";").alias("errors"))))


_PARTIAL = FEATURE_NAMES[:25]


@register("s7_complete_features", f"""{WF}
SELECT transaction_id, {', '.join(
    (f"{S(f'CAST({feature_exprs_sql()[n]} AS DOUBLE)')} AS {n}" if sql_type(n) == 'DOUBLE'
     else f"CAST({feature_exprs_sql()[n]} AS {sql_type(n)}) AS {n}") if n in _PARTIAL
    else (f"CAST(0 AS DOUBLE) AS {n}" if sql_type(n) == 'DOUBLE' else f"CAST(0 AS {sql_type(n)}) AS {n}")
    for n in FEATURE_NAMES)} FROM feat""")
def s7(spark, sf):
    f = engineer_features(txn_view(spark, sf)).select("transaction_id", *_PARTIAL)
    done, _filled = complete_features(f)
    return snap_doubles(done)


def _b1_sql(ctx_avg, ctx_std, ctx_n, src):
    """SQL of B1 over a source with raw columns + context columns."""
    e = {}
    hr, dw = "hour(timestamp)", "(isodow(timestamp) - 1)"
    avg = ctx_avg
    b = lambda c: f"CAST(({c}) AS INTEGER)"
    base = feature_exprs_sql()
    for n in FEATURE_NAMES[:17]:
        e[n] = base[n]
    e.update({
        "tx_count_1h": "CAST(cx_count_1h AS BIGINT)", "tx_count_24h": "CAST(cx_count_24h AS BIGINT)",
        "tx_amount_1h": "cx_amount_1h", "tx_amount_24h": "cx_amount_24h",
        "tx_amount_1h_log": "ln(1 + cx_amount_1h)", "tx_amount_24h_log": "ln(1 + cx_amount_24h)",
        "time_since_last_tx": "cx_gap",
        "avg_tx_amount_24h": "CASE WHEN cx_count_24h > 0 THEN cx_amount_24h / CAST(cx_count_24h AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "user_tx_number": f"CAST({ctx_n} AS BIGINT)",
        "user_total_amount": f"CAST({avg} * {ctx_n} AS DOUBLE)",
        "user_avg_amount": f"CAST({avg} AS DOUBLE)", "user_std_amount": f"CAST({ctx_std} AS DOUBLE)",
        "amount_deviation": f"CASE WHEN {avg} > 0 THEN (amount - {avg}) / ({ctx_std} + 1) ELSE CAST(0 AS DOUBLE) END",
        "amount_2x_avg": b(f"coalesce(amount > 2 * {avg}, false)"),
        "amount_3x_avg": b(f"coalesce(amount > 3 * {avg}, false)"),
        "is_new_receiver": b("cx_rcount = 0"), "receiver_tx_count": "CAST(cx_rcount AS BIGINT)",
        "device_changed_flag": base["device_changed_flag"], "location_changed_flag": base["location_changed_flag"],
        "device_or_location_changed": base["device_or_location_changed"],
        "device_and_location_changed": base["device_and_location_changed"],
        "high_amount_at_night": b(f"coalesce(amount > {avg} * 2, false) AND ({hr} >= 22 OR {hr} <= 5)"),
        "new_receiver_large_amount": b("cx_rcount = 0 AND coalesce(amount > 5000, false)"),
        "device_changed_unusual_amount": b(f"coalesce(device_changed, false) AND coalesce(amount > 2 * {avg}, false)"),
        "high_velocity_large_amount": b("cx_count_1h >= 3 AND coalesce(amount > 3000, false)"),
        "night_device_change": b(f"({hr} >= 22 OR {hr} <= 5) AND coalesce(device_changed, false)"),
    })
    del dw
    cols = []
    for n in FEATURE_NAMES:
        t = sql_type(n)
        x = f"CAST({e[n]} AS {t})"
        cols.append(f"{S(x) if t == 'DOUBLE' else x} AS {n}")
    return f"SELECT transaction_id, {', '.join(cols)} FROM {src}"


@register("b1_point_features", f"""{WF}, src AS (
  SELECT *, tx_count_1h AS cx_count_1h, tx_count_24h AS cx_count_24h, tx_amount_1h AS cx_amount_1h,
         tx_amount_24h AS cx_amount_24h, time_since_last_tx AS cx_gap, receiver_tx_count AS cx_rcount FROM feat)
{_b1_sql('user_avg_amount', 'user_std_amount', 'user_tx_number', 'src')}""")
def b1(spark, sf):
    return snap_doubles(build_point_features(_raw_requests(spark, sf)).drop("user_id"))


PROFILE_SQL = f"""{W}, c AS (SELECT user_id, device_id, location, count(*) OVER (PARTITION BY user_id, device_id) AS cd,
    count(*) OVER (PARTITION BY user_id, location) AS cl FROM txn)
SELECT t.user_id, count(*) AS n_tx, {S('avg(amount)')} AS avg_amount, {S('stddev_samp(amount)')} AS std_amount,
  (SELECT device_id FROM c WHERE c.user_id = t.user_id ORDER BY cd DESC, device_id LIMIT 1) AS usual_device_id,
  (SELECT location FROM c WHERE c.user_id = t.user_id ORDER BY cl DESC, location LIMIT 1) AS usual_location
FROM txn t GROUP BY t.user_id"""


@register("b2_user_profile", PROFILE_SQL)
def b2(spark, sf):
    return snap_doubles(user_profile(txn_view(spark, sf)))


@register("b3_enriched_point_features", f"""{W}, p AS (SELECT user_id, avg(amount) AS pa, stddev_samp(amount) AS ps, count(*) AS pn FROM txn GROUP BY user_id),
src AS (SELECT txn.*, coalesce(p.pa, 500.0) AS ca, coalesce(p.ps, 200.0) AS cs, coalesce(p.pn, 1) AS cn,
  0 AS cx_count_1h, 0 AS cx_count_24h, CAST(0 AS DOUBLE) AS cx_amount_1h, CAST(0 AS DOUBLE) AS cx_amount_24h,
  CAST(3600 AS DOUBLE) AS cx_gap, 0 AS cx_rcount FROM txn LEFT JOIN p USING (user_id))
{_b1_sql('ca', 'cs', 'cn', 'src')}""")
def b3(spark, sf):
    t = txn_view(spark, sf)
    e = enrich_with_profile(t, user_profile(t))
    return snap_doubles(build_point_features(e).drop("user_id"))


_XCOLS = ["amount_sqrt", "amount_squared", "amount_zscore", "amount_percentile", "is_round_amount",
          "is_month_start", "is_month_end", "tx_count_6h", "tx_count_7d", "tx_velocity_1h",
          "tx_velocity_24h", "avg_tx_interval", "user_tx_count", "amount_deviation_from_user",
          "user_fraud_rate", "device_change_count", "location_change_count",
          "new_receiver_high_amount", "velocity_spike", "amount_velocity_interaction"]

_X_SQL = f"""{W}, v AS (
  SELECT t.transaction_id,
    count(p.transaction_id) FILTER (WHERE p.us >= t.us - 3600000000) AS c1h,
    count(p.transaction_id) FILTER (WHERE p.us >= t.us - 21600000000) AS c6h,
    count(p.transaction_id) FILTER (WHERE p.us >= t.us - 86400000000) AS c24h,
    count(p.transaction_id) AS c7d
  FROM txn t LEFT JOIN txn p ON p.user_id = t.user_id AND p.us >= t.us - 604800000000
   AND (p.us < t.us OR (p.us = t.us AND p.transaction_id < t.transaction_id))
  GROUP BY t.transaction_id),
h AS (
  SELECT transaction_id, user_id, us, amount, timestamp, is_fraud,
    row_number() OVER w AS k, sum(amount) OVER w AS s, coalesce(stddev_samp(amount) OVER w, 0) AS sd,
    min(us) OVER (PARTITION BY user_id) AS first_us,
    sum(CAST(coalesce(device_changed, false) AS INTEGER)) OVER w AS dcc,
    sum(CAST(coalesce(location_changed, false) AS INTEGER)) OVER w AS lcc,
    coalesce(sum(CAST(coalesce(is_fraud, false) AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY us, transaction_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fprior,
    row_number() OVER (PARTITION BY user_id, receiver ORDER BY us, transaction_id) - 1 AS rc,
    percent_rank() OVER (PARTITION BY user_id ORDER BY amount) AS pr,
    avg(amount) OVER () AS mu, stddev_samp(amount) OVER () AS sdall
  FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT h.*, v.*, s / CAST(k AS DOUBLE) AS av FROM h JOIN v USING (transaction_id))
SELECT transaction_id, user_id,
  {S('sqrt(amount)')} AS amount_sqrt, {S('amount * amount')} AS amount_squared,
  {S('(amount - mu) / sdall')} AS amount_zscore, {S('pr * 100')} AS amount_percentile,
  CAST(coalesce(fmod(amount, 100) = 0, false) AS INTEGER) AS is_round_amount,
  CAST(dayofmonth(timestamp) = 1 AS INTEGER) AS is_month_start,
  CAST(CAST(timestamp AS DATE) = last_day(timestamp) AS INTEGER) AS is_month_end,
  c6h AS tx_count_6h, c7d AS tx_count_7d, c1h AS tx_velocity_1h, c24h AS tx_velocity_24h,
  {S('CASE WHEN k > 1 THEN CAST(us - first_us AS DOUBLE) / 60000000.0 / CAST(k - 1 AS DOUBLE) ELSE 0 END')} AS avg_tx_interval,
  k AS user_tx_count,
  {S('CASE WHEN av > 0 THEN (amount - av) / (sd + 1) ELSE 0 END')} AS amount_deviation_from_user,
  {S('CASE WHEN k > 1 THEN fprior / CAST(k - 1 AS DOUBLE) ELSE 0 END')} AS user_fraud_rate,
  CAST(dcc AS BIGINT) AS device_change_count, CAST(lcc AS BIGINT) AS location_change_count,
  CAST(rc = 0 AND coalesce(amount > 5000, false) AS INTEGER) AS new_receiver_high_amount,
  CAST(c1h >= 3 AS INTEGER) AS velocity_spike,
  {S('amount * CAST(c1h AS DOUBLE)')} AS amount_velocity_interaction
FROM x"""


@register("x_declared_columns", _X_SQL)
def x(spark, sf):
    return snap_doubles(declared_columns(txn_view(spark, sf)).select("transaction_id", "user_id", *_XCOLS))
