"""SQL twins: the same views and formulas written as plain SQL (DuckDB
dialect) over the raw test tables. Kept independent of the Spark code: the
windows here are ordinary per-user windows and self-joins."""

from __future__ import annotations

from txnscope.schema import FEATURE_NAMES, FRAUD_PATTERNS, feature_type
from txnscope.functions.common import snap_sql

_PAT = ", ".join(f"'{p}'" for p in FRAUD_PATTERNS)

TXN_CTE = f"""txn AS (
  SELECT 'T' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS transaction_id,
         'u' || CAST(user_id AS VARCHAR) AS user_id,
         CAST(ts AS TIMESTAMP) AS timestamp,
         epoch_us(CAST(ts AS TIMESTAMP)) AS us,
         round(value * CAST(100 AS DOUBLE), 2) AS amount,
         'r' || json_extract_string(props, '$.k') AS receiver,
         CASE WHEN event_id % 13 = 0 THEN 'd_alt' ELSE 'd_' || CAST(user_id AS VARCHAR) END AS device_id,
         CASE WHEN event_id % 11 = 0 THEN 'l_alt' ELSE 'l_' || CAST(user_id % 10 AS VARCHAR) END AS location,
         event_id % 13 = 0 AS device_changed,
         event_id % 11 = 0 AS location_changed,
         event_type = 'error' AS is_fraud,
         CASE WHEN event_type = 'error' THEN ([{_PAT}])[CAST(event_id % 5 AS INTEGER) + 1] END AS fraud_pattern,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS fraud_score
  FROM events)"""

ORDERS_CTE = """txn AS (
  SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS transaction_id,
         'c' || CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(o_orderdate AS TIMESTAMP) AS timestamp,
         epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us,
         o_totalprice AS amount,
         o_orderpriority AS receiver,
         false AS device_changed, false AS location_changed,
         o_orderstatus = 'F' AS is_fraud
  FROM orders)"""

H = 3600000000  # one hour in microseconds


def velocity_sql(cte: str = "txn", windows=(("1h", 3600), ("24h", 86400))) -> str:
    """V1-V4 by a self-join: earlier rows (ts, id) of the user within w."""
    wmax = max(s for _, s in windows) * 1000000
    parts = []
    for n, s in windows:
        cond = f"p.us >= t.us - {s * 1000000}"
        parts.append(f"count(p.transaction_id) FILTER (WHERE {cond}) AS tx_count_{n}")
        parts.append(f"coalesce(sum(coalesce(p.amount, 0)) FILTER (WHERE {cond}), CAST(0 AS DOUBLE)) AS tx_amount_{n}")
    return f"""v AS (
  SELECT t.transaction_id, {', '.join(parts)}
  FROM {cte} t LEFT JOIN {cte} p
    ON p.user_id = t.user_id AND p.us >= t.us - {wmax}
   AND (p.us < t.us OR (p.us = t.us AND p.transaction_id < t.transaction_id))
  GROUP BY t.transaction_id)"""


def history_sql(cte: str = "txn") -> str:
    """H1-H4, V7 and R2 with ordinary per-user windows."""
    return f"""h AS (
  SELECT transaction_id,
    row_number() OVER w AS user_tx_number,
    sum(amount) OVER w AS user_total_amount,
    avg(amount) OVER w AS user_avg_amount,
    coalesce(stddev_samp(amount) OVER w, CAST(0 AS DOUBLE)) AS user_std_amount,
    CAST(coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, transaction_id)) // 60000000, 0) AS DOUBLE) AS time_since_last_tx,
    row_number() OVER (PARTITION BY user_id, receiver ORDER BY us, transaction_id) - 1 AS receiver_tx_count
  FROM {cte}
  WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def feature_exprs_sql() -> dict[str, str]:
    """SQL formulas of the 43 features over columns of txn + v + h."""
    hr = "hour(timestamp)"
    dw = "(isodow(timestamp) - 1)"
    b = lambda c: f"CAST(({c}) AS INTEGER)"
    tp = "CAST(6.283185307179586 AS DOUBLE)"
    e = {
        "hour": f"CAST({hr} AS INTEGER)",
        "day_of_week": f"CAST({dw} AS INTEGER)",
        "is_weekend": b(f"{dw} >= 5"),
        "is_night": b(f"{hr} >= 22 OR {hr} <= 5"),
        "is_early_morning": b(f"{hr} >= 0 AND {hr} <= 5"),
        "is_business_hours": b(f"{hr} >= 9 AND {hr} <= 17"),
        "hour_sin": f"sin({tp} * CAST({hr} AS DOUBLE) / CAST(24 AS DOUBLE))",
        "hour_cos": f"cos({tp} * CAST({hr} AS DOUBLE) / CAST(24 AS DOUBLE))",
        "day_sin": f"sin({tp} * CAST({dw} AS DOUBLE) / CAST(7 AS DOUBLE))",
        "day_cos": f"cos({tp} * CAST({dw} AS DOUBLE) / CAST(7 AS DOUBLE))",
        "amount_raw": "amount",
        "amount_log": "CASE WHEN amount > -1 THEN ln(1 + amount) END",
        "amount_very_small": b("coalesce(amount < 100, false)"),
        "amount_small": b("coalesce(amount >= 100 AND amount < 1000, false)"),
        "amount_medium": b("coalesce(amount >= 1000 AND amount < 5000, false)"),
        "amount_large": b("coalesce(amount >= 5000 AND amount < 20000, false)"),
        "amount_very_large": b("coalesce(amount >= 20000, false)"),
        "tx_count_1h": "tx_count_1h", "tx_count_24h": "tx_count_24h",
        "tx_amount_1h": "tx_amount_1h", "tx_amount_24h": "tx_amount_24h",
        "tx_amount_1h_log": "ln(1 + tx_amount_1h)",
        "tx_amount_24h_log": "ln(1 + tx_amount_24h)",
        "time_since_last_tx": "time_since_last_tx",
        "avg_tx_amount_24h": "CASE WHEN tx_count_24h > 0 THEN tx_amount_24h / CAST(tx_count_24h AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "user_tx_number": "user_tx_number",
        "user_total_amount": "user_total_amount",
        "user_avg_amount": "user_avg_amount",
        "user_std_amount": "user_std_amount",
        "amount_deviation": "CASE WHEN user_avg_amount > 0 THEN (amount - user_avg_amount) / (user_std_amount + 1) ELSE CAST(0 AS DOUBLE) END",
        "amount_2x_avg": b("coalesce(amount > 2 * user_avg_amount, false)"),
        "amount_3x_avg": b("coalesce(amount > 3 * user_avg_amount, false)"),
        "is_new_receiver": b("receiver_tx_count = 0"),
        "receiver_tx_count": "receiver_tx_count",
        "device_changed_flag": b("coalesce(device_changed, false)"),
        "location_changed_flag": b("coalesce(location_changed, false)"),
        "device_or_location_changed": b("coalesce(device_changed, false) OR coalesce(location_changed, false)"),
        "device_and_location_changed": b("coalesce(device_changed, false) AND coalesce(location_changed, false)"),
    }
    e["high_amount_at_night"] = b(f"coalesce(amount > user_avg_amount * 2, false) AND ({e['is_night']}) = 1")
    e["new_receiver_large_amount"] = b("receiver_tx_count = 0 AND coalesce(amount > 5000, false)")
    e["device_changed_unusual_amount"] = b(f"coalesce(device_changed, false) AND ({e['amount_2x_avg']}) = 1")
    e["high_velocity_large_amount"] = b("tx_count_1h >= 3 AND coalesce(amount > 3000, false)")
    e["night_device_change"] = b(f"({e['is_night']}) = 1 AND coalesce(device_changed, false)")
    return e


def sql_type(name: str) -> str:
    t = feature_type(name).simpleString()
    return {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}[t]


def checked_feature_select(names=None, digits: int = 6) -> str:
    """Select list of typed (and, for doubles, snapped) feature columns."""
    e = feature_exprs_sql()
    out = []
    for n in names or FEATURE_NAMES:
        t = sql_type(n)
        x = f"CAST({e[n]} AS {t})"
        out.append(f"{snap_sql(x, digits) if t == 'DOUBLE' else x} AS {n}")
    return ",\n  ".join(out)


def features_sql(cte_text: str = TXN_CTE, names=None) -> str:
    """F1 twin: 43 features per transaction (+ id and label)."""
    return f"""WITH {cte_text},
{velocity_sql()},
{history_sql()}
SELECT txn.transaction_id, txn.user_id, txn.is_fraud,
  {checked_feature_select(names)}
FROM txn JOIN v USING (transaction_id) JOIN h USING (transaction_id)"""


def features_cte(cte_text: str = TXN_CTE) -> str:
    """CTE list ending in ``feat``: txn columns + the 43 raw (unsnapped)
    features, for summaries computed over features."""
    e = feature_exprs_sql()
    sel = ",\n    ".join(f"CAST({e[n]} AS {sql_type(n)}) AS {n}" for n in FEATURE_NAMES)
    return f"""{cte_text},
{velocity_sql()},
{history_sql()},
feat AS (
  SELECT txn.*,
    {sel}
  FROM txn JOIN v USING (transaction_id) JOIN h USING (transaction_id))"""


LINEITEM_CTE = """txn AS (
  SELECT 'L' || lpad(CAST(l.l_orderkey AS VARCHAR), 10, '0') || '_' || CAST(l.l_linenumber AS VARCHAR)
           || '_' || CAST(l.l_partkey AS VARCHAR) || '_' || CAST(l.l_suppkey AS VARCHAR) AS transaction_id,
         'c' || CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_shipdate AS TIMESTAMP) AS timestamp,
         epoch_us(CAST(l.l_shipdate AS TIMESTAMP)) AS us,
         CAST(floor(l.l_extendedprice * (CAST(1 AS DOUBLE) - l.l_discount) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS amount,
         's' || CAST(l.l_suppkey AS VARCHAR) AS receiver,
         false AS device_changed, false AS location_changed,
         l.l_returnflag = 'R' AS is_fraud
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
