"""Registered exploratory aggregations (N1-N15, N17, S8) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.functions.common import snap, snap_sql as S
from txnscope.operators import explore as N
from txnscope.operators.features import engineer_features
from txnscope.plans.catalog import register
from txnscope.plans.checked import snap_doubles
from txnscope.plans.sqltext import TXN_CTE, features_cte, sql_type
from txnscope.schema import FEATURE_NAMES, feature_type
from txnscope.sources.tables import txn_view

W = f"WITH {TXN_CTE}"
WF = f"WITH {features_cte()}"
Y = "coalesce(is_fraud, false)"


def _feat(spark, sf):
    return engineer_features(txn_view(spark, sf))


@register("n1_class_counts", f"""{W}, c AS (SELECT {Y} AS is_fraud, count(*) AS n FROM txn GROUP BY 1)
SELECT is_fraud, n, {S('CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE)')} AS share FROM c""")
def n1(spark, sf):
    return snap_doubles(N.class_counts(txn_view(spark, sf)))


@register("n2_pattern_counts", f"{W} SELECT fraud_pattern, count(*) AS n FROM txn WHERE {Y} GROUP BY fraud_pattern")
def n2(spark, sf):
    return N.pattern_counts(txn_view(spark, sf))


def _hist_sql(src, value, bins, density, label_expr=Y, extra_key=None):
    k = f"{extra_key}, " if extra_key else ""
    dens = f", {S('CAST(count AS DOUBLE) / (CAST(n AS DOUBLE) * wd)')} AS density" if density else ""
    return f"""hx AS (SELECT {k}{label_expr} AS is_fraud, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL),
hr AS (SELECT {k}is_fraud, min(v) AS lo, max(v) AS hi, count(*) AS n FROM hx GROUP BY ALL),
hb AS (SELECT hx.*, hr.lo, hr.hi, hr.n,
        CAST(CASE WHEN hr.hi = hr.lo THEN 0 ELSE least(floor((hx.v - hr.lo) / (hr.hi - hr.lo) * CAST({bins} AS DOUBLE)), {bins - 1}) END AS INTEGER) AS bin
      FROM hx JOIN hr USING ({k}is_fraud)),
hh AS (SELECT {k}is_fraud, bin, count(*) AS count, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM hb GROUP BY ALL),
hw AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / CAST({bins} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS wd FROM hh)
SELECT {k}is_fraud, bin, {S('lo + bin * wd')} AS bin_start, count{dens} FROM hw"""


@register("n3_amount_histogram", f"{W}, {_hist_sql('txn', 'amount', 50, False)}")
def n3(spark, sf):
    return snap_doubles(N.amount_histogram(txn_view(spark, sf), 50))


def _describe_sql(src, v):
    return f"""SELECT is_fraud, count({v}) AS count, {S(f'avg({v})')} AS mean, {S(f'stddev_samp({v})')} AS std,
  {S(f'min({v})')} AS min, {S(f'max({v})')} AS max, {S(f'quantile_cont({v}, 0.25)')} AS q25,
  {S(f'quantile_cont({v}, 0.5)')} AS median, {S(f'quantile_cont({v}, 0.75)')} AS q75
FROM {src} GROUP BY is_fraud"""


@register("n4_amount_describe", f"""{W}, a AS (SELECT {Y} AS is_fraud, CAST(amount AS DOUBLE) AS v FROM txn)
{_describe_sql('a', 'v')}""")
def n4(spark, sf):
    return snap_doubles(N.describe_by_class(txn_view(spark, sf), "amount"))


@register("n5_counts_by_hour", f"{W} SELECT {Y} AS is_fraud, CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM txn GROUP BY ALL")
def n5(spark, sf):
    return N.counts_by_hour(txn_view(spark, sf))


@register("n6_counts_by_weekday", f"{W} SELECT {Y} AS is_fraud, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, count(*) AS n FROM txn GROUP BY ALL")
def n6(spark, sf):
    return N.counts_by_weekday(txn_view(spark, sf))


@register("n7_first_fraud_rows", f"""{W} SELECT transaction_id, user_id, amount, fraud_pattern, device_changed, location_changed
FROM txn WHERE {Y} ORDER BY timestamp, transaction_id LIMIT 5""")
def n7(spark, sf):
    return N.first_fraud_rows(txn_view(spark, sf), 5).select(
        "transaction_id", "user_id", "amount", "fraud_pattern", "device_changed", "location_changed")


@register("n8_flag_shares", f"""{W}, l AS (
  SELECT {Y} AS is_fraud, 'device_changed' AS flag, device_changed AS value FROM txn
  UNION ALL SELECT {Y}, 'location_changed', location_changed FROM txn),
c AS (SELECT is_fraud, flag, value, count(*) AS n FROM l GROUP BY ALL)
SELECT *, {S('CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY is_fraud, flag) AS DOUBLE)')} AS share FROM c""")
def n8(spark, sf):
    return snap_doubles(N.flag_shares(txn_view(spark, sf)))


@register("n9_describe_amount_by_class", f"""{W}, a AS (SELECT {Y} AS is_fraud, amount FROM txn)
{_describe_sql('a', 'amount')}""")
def n9(spark, sf):
    return snap_doubles(N.describe_by_class(txn_view(spark, sf), "amount"))


@register("n10_per_user_counts", f"""{W}, u AS (SELECT user_id, {Y} AS is_fraud, CAST(count(*) AS DOUBLE) AS n_tx FROM txn GROUP BY ALL)
{_describe_sql('u', 'n_tx')}""")
def n10(spark, sf):
    return snap_doubles(N.per_user_counts(txn_view(spark, sf)))


_N11_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {Y} AS is_fraud, CAST({f} AS DOUBLE) AS v FROM feat" for f in N.HIST_FEATURES)


@register("n11_feature_histograms", f"""{WF}, l AS ({_N11_LONG}),
{_hist_sql('l', 'v', 30, True, label_expr='is_fraud', extra_key='feature')}""")
def n11(spark, sf):
    return snap_doubles(N.feature_histograms(_feat(spark, sf), N.HIST_FEATURES, 30))


_N12_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, covar_samp(CAST({f} AS DOUBLE), y) / nullif(stddev_samp(CAST({f} AS DOUBLE)) * stddev_samp(y), 0) AS c FROM f"
    for f in FEATURE_NAMES)


@register("n12_label_correlations", f"""{WF}, f AS (SELECT *, CAST({Y} AS DOUBLE) AS y FROM feat), l AS ({_N12_LONG}),
s AS (SELECT feature, {S('c')} AS correlation FROM l)
SELECT * FROM s ORDER BY abs(correlation) DESC NULLS LAST, feature LIMIT 20""")
def n12(spark, sf):
    r = N.label_correlations(_feat(spark, sf), top=None)
    r = r.select("feature", snap(F.col("correlation")).alias("correlation"))
    return r.orderBy(F.abs("correlation").desc_nulls_last(), F.col("feature")).limit(20)


_N13_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {Y} AS is_fraud, CAST({f} AS DOUBLE) AS v FROM feat" for f in N.COMPARE_FEATURES)


@register("n13_class_comparison", f"""{WF}, l AS ({_N13_LONG}),
a AS (SELECT feature,
  avg(v) FILTER (WHERE NOT is_fraud) AS lm, avg(v) FILTER (WHERE is_fraud) AS fm,
  quantile_cont(v, 0.5) FILTER (WHERE NOT is_fraud) AS lmed, quantile_cont(v, 0.5) FILTER (WHERE is_fraud) AS fmed
  FROM l GROUP BY feature)
SELECT feature, {S('lm')} AS legitimate_mean, {S('fm')} AS fraud_mean, {S('lmed')} AS legitimate_median,
  {S('fmed')} AS fraud_median, {S('fm - lm')} AS mean_diff, {S('fmed - lmed')} AS median_diff FROM a""")
def n13(spark, sf):
    return snap_doubles(N.class_comparison(_feat(spark, sf)))


_N14_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN {f} = 1 THEN CAST({Y} AS DOUBLE) END) AS rate, "
    f"count(*) FILTER (WHERE {f} = 1) AS n, avg(CAST({Y} AS DOUBLE)) AS overall FROM feat" for f in N.INTERACTIONS)


@register("n14_interaction_lift", f"""{WF}, l AS ({_N14_LONG})
SELECT feature, {S('rate')} AS fraud_rate_when_set, {S('overall')} AS overall_fraud_rate,
  {S('CASE WHEN overall > 0 THEN rate / overall ELSE CAST(0 AS DOUBLE) END')} AS lift, n AS count FROM l""")
def n14(spark, sf):
    return snap_doubles(N.interaction_lift(_feat(spark, sf)))


_N15_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{feature_type(f).simpleString()}' AS dtype, count(*) FILTER (WHERE {f} IS NULL) AS missing, "
    f"count(DISTINCT {f}) AS n_unique, avg(CAST({f} AS DOUBLE)) AS mean, stddev_samp(CAST({f} AS DOUBLE)) AS std FROM feat"
    for f in FEATURE_NAMES)


@register("n15_feature_summary", f"""{WF}, l AS ({_N15_LONG})
SELECT feature, dtype, missing, n_unique, {S('mean')} AS mean, {S('std')} AS std FROM l""")
def n15(spark, sf):
    from txnscope.operators.features import select_features
    return snap_doubles(N.feature_summary(select_features(_feat(spark, sf))))


DRIFT_SPLIT = "2024-01-16 00:00:00"
_DRIFT = ("amount_raw", "tx_count_1h", "is_night", "is_new_receiver")
_N17_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN timestamp < TIMESTAMP '{DRIFT_SPLIT}' THEN CAST({f} AS DOUBLE) END) AS b, "
    f"avg(CASE WHEN timestamp >= TIMESTAMP '{DRIFT_SPLIT}' THEN CAST({f} AS DOUBLE) END) AS a FROM feat" for f in _DRIFT)


@register("n17_drift_check", f"""{WF}, l AS ({_N17_LONG}),
r AS (SELECT *, CASE WHEN abs(b) = 0 THEN NULL ELSE (a - b) / abs(b) END AS rel FROM l)
SELECT feature, {S('b')} AS before_mean, {S('a')} AS after_mean, {S('rel')} AS relative_change,
  coalesce(abs(rel) > 0.1, false) AS drifted FROM r""")
def n17(spark, sf):
    return snap_doubles(N.drift_check(_feat(spark, sf), DRIFT_SPLIT))


@register("s8_dataset_statistics", f"""{W}, a AS (SELECT {Y} AS is_fraud, CAST(amount AS DOUBLE) AS amount,
  CAST(device_changed AS DOUBLE) AS dc, CAST(location_changed AS DOUBLE) AS lc FROM txn)
SELECT is_fraud, count(*) AS n, {S('avg(dc)')} AS device_change_rate, {S('avg(lc)')} AS location_change_rate,
  {S('avg(amount)')} AS mean_amount, {S('CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share,
  {S('quantile_cont(amount, 0.5)')} AS median_amount
FROM a GROUP BY is_fraud""")
def s8(spark, sf):
    return snap_doubles(N.dataset_statistics(txn_view(spark, sf)))


del sql_type
