"""Registered feature queries (S, T, A, V, H, R, D, I, F, X, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.functions.amount import amount_columns
from txnscope.functions.calendar import calendar_columns
from txnscope.functions.flags import device_columns
from txnscope.operators.features import engineer_features, feature_names, select_features
from txnscope.plans.catalog import register
from txnscope.plans.checked import snap_doubles
from txnscope.plans.sqltext import TXN_CTE, features_sql
from txnscope.sources.tables import txn_view


def _features(spark, sf):
    f = select_features(engineer_features(txn_view(spark, sf)))
    return snap_doubles(f.select("transaction_id", "user_id", "is_fraud",
                                 *[c for c in f.columns if c not in
                                   ("transaction_id", "user_id", "timestamp", "is_fraud")]))


register("f1_all_features", features_sql(TXN_CTE),
         "all 43 features per transaction")(_features)


from txnscope.operators.windows import time_window_features  # noqa: E402
from txnscope.plans.sqltext import (LINEITEM_CTE, ORDERS_CTE, checked_feature_select,  # noqa: E402
                                    features_cte)
from txnscope.schema import FEATURE_NAMES, feature_type  # noqa: E402
from txnscope.sources.tables import lineitem_view, orders_view  # noqa: E402

_GROUPS = {
    "t_calendar": FEATURE_NAMES[0:10],
    "a_amount": FEATURE_NAMES[10:17],
    "v_velocity": FEATURE_NAMES[17:25],
    "h_user_history": FEATURE_NAMES[25:32],
    "r_receiver": FEATURE_NAMES[32:34],
    "d_device_location": FEATURE_NAMES[34:38],
    "i_interactions": FEATURE_NAMES[38:43],
}


# Pure projections of a row: no shuffle.
_POINT = {"t_calendar": lambda: calendar_columns("timestamp"), "a_amount": lambda: amount_columns("amount"),
          "d_device_location": device_columns}


def _group_query(name, names):
    def build(spark, sf):
        if name in _POINT:
            df = txn_view(spark, sf).select("transaction_id", *_POINT[name]())
            return snap_doubles(df.select("transaction_id", *[F.col(n).cast(feature_type(n)).alias(n) for n in names]))
        return _features(spark, sf).select("transaction_id", *names)
    sql = f"""WITH {features_cte()}
SELECT transaction_id, {checked_feature_select(names)} FROM feat"""
    return build, sql


for _name, _cols in _GROUPS.items():
    _b, _s = _group_query(_name, _cols)
    register(_name, _s, f"feature group {_name}")(_b)


from txnscope.functions.common import snap_sql  # noqa: E402

_ORD_SQL = f"""WITH {ORDERS_CTE}
SELECT t.transaction_id, count(p.transaction_id) AS tx_count_30d,
  {snap_sql('coalesce(sum(p.amount), CAST(0 AS DOUBLE))')} AS tx_amount_30d
FROM txn t LEFT JOIN txn p ON p.user_id = t.user_id AND p.us >= t.us - {30 * 86400 * 1000000}
  AND (p.us < t.us OR (p.us = t.us AND p.transaction_id < t.transaction_id))
GROUP BY t.transaction_id"""


@register("v_velocity_orders_ties_30d", _ORD_SQL, "tie fixture: equal customer-day timestamps")
def v_orders(spark, sf):
    w = time_window_features(orders_view(spark, sf), windows=[("30d", 30 * 86400)],
                             history=False, gap=False, receiver_col=None)
    return snap_doubles(w.select("transaction_id", "tx_count_30d", "tx_amount_30d"))


# Lineitem amounts are ~1000x the event amounts, so the same ~10 significant
# digits means a 1e-4 grid (DuckDB's windowed stddev is itself only good to
# ~2e-14 relative; ours to ~3e-15 against exact rational arithmetic).
_LI_DIGITS = 4
_LI_SQL = f"""WITH {features_cte(LINEITEM_CTE)}
SELECT transaction_id, user_id, is_fraud, {checked_feature_select(digits=_LI_DIGITS)} FROM feat"""


@register("f1_lineitem_features", _LI_SQL, "wide scale fixture: lineitem x orders")
def f1_lineitem(spark, sf):
    f = select_features(engineer_features(lineitem_view(spark, sf), checkpoint_input=True))
    return snap_doubles(f.drop("timestamp"), _LI_DIGITS)


_PRIOR_SQL = f"""WITH {TXN_CTE}, p AS (
  SELECT transaction_id,
    count(*) OVER w AS prior_tx_count,
    coalesce(sum(amount) OVER w, CAST(0 AS DOUBLE)) AS prior_total_amount,
    coalesce(avg(amount) OVER w, CAST(0 AS DOUBLE)) AS prior_avg_amount,
    coalesce(stddev_samp(amount) OVER w, CAST(0 AS DOUBLE)) AS prior_std_amount
  FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, prior_tx_count, {snap_sql('prior_total_amount')} AS prior_total_amount,
  {snap_sql('prior_avg_amount')} AS prior_avg_amount, {snap_sql('prior_std_amount')} AS prior_std_amount FROM p"""


@register("h_prior_history", _PRIOR_SQL, "leak-free history over earlier rows only")
def h_prior(spark, sf):
    w = time_window_features(txn_view(spark, sf), windows=[], history=False, gap=False,
                             receiver_col=None, prior_history=True)
    return snap_doubles(w.select("transaction_id", "prior_tx_count", "prior_total_amount",
                                 "prior_avg_amount", "prior_std_amount"))


# Sums must be exact: 0 where nothing is in the window, never negative.
# Counted on the values themselves, without the output grid.
def _violations(t, windows):
    w = time_window_features(t, windows=windows, history=False, gap=False, receiver_col=None)
    bad = F.lit(False)
    for n, _ in windows:
        bad = bad | (F.col(f"tx_amount_{n}") < 0) | ((F.col(f"tx_count_{n}") == 0) & (F.col(f"tx_amount_{n}") != 0))
    name = windows[-1][0]
    return w.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"tx_count_{name}") == 0).alias("n_empty"),
                 F.count_if(bad).alias("n_bad"))


def _violations_sql(cte, us):
    return f"""WITH {cte}, k AS (SELECT transaction_id, row_number() OVER (PARTITION BY user_id ORDER BY us, transaction_id) AS rn,
  lag(us) OVER (PARTITION BY user_id ORDER BY us, transaction_id) AS prev, us FROM txn)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE prev IS NULL OR prev < us - {us}) AS n_empty, CAST(0 AS BIGINT) AS n_bad FROM k"""


@register("v_exact_sums_lineitem", _violations_sql(LINEITEM_CTE, 86400 * 1000000), "no negative or left-over sums")
def v_exact_lineitem(spark, sf):
    return _violations(lineitem_view(spark, sf), [("1h", 3600), ("24h", 86400)])


@register("v_exact_sums_orders", _violations_sql(ORDERS_CTE, 30 * 86400 * 1000000), "no negative or left-over sums")
def v_exact_orders(spark, sf):
    return _violations(orders_view(spark, sf), [("30d", 30 * 86400)])


# The operator's names against the columns that the feature job makes.
@register("f2_feature_names", f"WITH {TXN_CTE} SELECT n AS n_rows, 43 AS n_names, 43 AS n_made FROM (SELECT count(*) AS n FROM txn)")
def f2(spark, sf):
    made = engineer_features(txn_view(spark, sf))
    names = feature_names()
    return made.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(names)).alias("n_names"), F.lit(sum(n in made.columns for n in names)).alias("n_made"))
