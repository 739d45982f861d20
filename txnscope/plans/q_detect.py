"""Registered detector queries (Q1-Q6) with SQL twins (self-joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.functions.common import snap_sql as S
from txnscope.operators import detect as Q
from txnscope.plans.catalog import register
from txnscope.plans.checked import snap_doubles
from txnscope.plans.sqltext import TXN_CTE
from txnscope.sources.tables import txn_view

W = f"WITH {TXN_CTE}"
# Fixture rule: receiver 'r<k>' is the account of user 'u<k>', so money can
# flow on (the events table has no account graph of its own).
ACCOUNT_SQL = "regexp_replace(receiver, '^r', 'u')"


def _acct():
    return F.regexp_replace("receiver", "^r", "u")


def _earlier_or_self(p, c, w_us):
    return (f"{p}.user_id = {c}.user_id AND {p}.us >= {c}.us - {w_us} AND "
            f"({p}.us < {c}.us OR ({p}.us = {c}.us AND {p}.transaction_id <= {c}.transaction_id))")


_Q1 = f"""{W}, c AS (SELECT * FROM txn WHERE coalesce(device_changed, false) AND coalesce(location_changed, false)
    AND hour(timestamp) IN (23, 0, 1, 2, 3, 4, 5) AND amount >= 5000),
k AS (SELECT a.transaction_id, count(*) AS burst_count FROM c a JOIN c p ON {_earlier_or_self('p', 'a', 3600000000)} GROUP BY a.transaction_id)
SELECT c.transaction_id, c.user_id, {S('c.amount')} AS amount, c.is_fraud, k.burst_count, 'sim_swap' AS detector
FROM c JOIN k USING (transaction_id) WHERE k.burst_count >= 3"""


@register("q1_detect_sim_swap", _Q1)
def q1(spark, sf):
    return snap_doubles(Q.detect_sim_swap(txn_view(spark, sf)).drop("timestamp"))


_Q1B = f"""{W}, c AS (SELECT * FROM txn WHERE coalesce(device_changed, false) AND coalesce(location_changed, false)
    AND hour(timestamp) >= 0 AND amount >= 500),
k AS (SELECT a.transaction_id, count(*) AS burst_count FROM c a JOIN c p ON {_earlier_or_self('p', 'a', 30 * 86400000000)} GROUP BY a.transaction_id)
SELECT c.transaction_id, c.user_id, {S('c.amount')} AS amount, c.is_fraud, k.burst_count, 'sim_swap' AS detector
FROM c JOIN k USING (transaction_id) WHERE k.burst_count >= 2"""


@register("q1b_sim_swap_30d", _Q1B, "wider parameters, under which the events table has bursts")
def q1b(spark, sf):
    hits = Q.detect_sim_swap(txn_view(spark, sf), min_count=2, window_s=30 * 86400, min_amount=500.0, hours=list(range(24)))
    return snap_doubles(hits.drop("timestamp"))


_Q2 = f"""{W}, c AS (SELECT * FROM txn WHERE amount BETWEEN 1000 AND 5000),
k AS (SELECT a.transaction_id, count(*) AS burst_count, count(DISTINCT p.receiver) AS n_receivers
      FROM c a JOIN c p ON {_earlier_or_self('p', 'a', 2700000000)} GROUP BY a.transaction_id)
SELECT c.transaction_id, c.user_id, {S('c.amount')} AS amount, c.is_fraud, k.burst_count, k.n_receivers,
  'velocity_attack' AS detector
FROM c JOIN k USING (transaction_id) WHERE k.burst_count >= 8 AND k.n_receivers >= 3"""


@register("q2_detect_velocity_attack", _Q2)
def q2(spark, sf):
    return snap_doubles(Q.detect_velocity_attack(txn_view(spark, sf)).drop("timestamp"))


_Q3 = f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, receiver ORDER BY us, transaction_id) - 1 AS rc FROM txn)
SELECT transaction_id, user_id, {S('amount')} AS amount, is_fraud, receiver, 'unusual_amount' AS detector
FROM r WHERE amount >= 20000 AND rc = 0"""


@register("q3_detect_unusual_amount", _Q3)
def q3(spark, sf):
    return snap_doubles(Q.detect_unusual_amount(txn_view(spark, sf)).drop("timestamp"))


_Q4 = f"""{W}, flow AS (
  SELECT {ACCOUNT_SQL} AS account, us, 'I' || transaction_id AS eid, user_id AS sender,
         CAST(amount AS DOUBLE) AS amount_in, CAST(0 AS DOUBLE) AS amount_out, NULL AS transaction_id, NULL AS is_fraud FROM txn
  UNION ALL
  SELECT user_id, us, 'O' || transaction_id, NULL, CAST(0 AS DOUBLE), CAST(amount AS DOUBLE), transaction_id, is_fraud FROM txn),
o AS (SELECT * FROM flow WHERE transaction_id IS NOT NULL),
k AS (SELECT o.eid,
    coalesce(sum(p.amount_in) FILTER (WHERE p.eid < o.eid OR p.us < o.us), 0) AS inflow,
    coalesce(sum(p.amount_out) FILTER (WHERE p.us < o.us OR p.eid < o.eid), 0) AS prior_out,
    count(DISTINCT p.sender) AS n_senders
  FROM o LEFT JOIN flow p ON p.account = o.account AND p.us >= o.us - 172800000000
    AND (p.us < o.us OR (p.us = o.us AND p.eid < o.eid))
  GROUP BY o.eid)
SELECT o.transaction_id, o.account AS user_id, {S('o.amount_out')} AS amount, o.is_fraud, {S('k.inflow')} AS inflow,
  {S('k.prior_out + o.amount_out')} AS outflow, k.n_senders, 'mule_account' AS detector
FROM o JOIN k USING (eid)
WHERE k.n_senders >= 5 AND k.inflow > 0 AND k.prior_out + o.amount_out >= 0.8 * k.inflow"""


@register("q4_detect_mule", _Q4)
def q4(spark, sf):
    return snap_doubles(Q.detect_mule(txn_view(spark, sf), account_of_receiver=_acct()).drop("timestamp"))


_Q5 = f"""{W} SELECT transaction_id, user_id, {S('amount')} AS amount, is_fraud, 'night_transaction' AS detector
FROM txn WHERE hour(timestamp) IN (2, 3, 4) AND amount >= 3000"""


@register("q5_detect_night", _Q5)
def q5(spark, sf):
    return snap_doubles(Q.detect_night(txn_view(spark, sf)).drop("timestamp"))


_Q2B = f"""{W}, c AS (SELECT * FROM txn WHERE amount BETWEEN 1000 AND 5000),
k AS (SELECT a.transaction_id, count(*) AS burst_count, count(DISTINCT p.receiver) AS n_receivers
      FROM c a JOIN c p ON {_earlier_or_self('p', 'a', 21600000000)} GROUP BY a.transaction_id)
SELECT c.transaction_id, c.user_id, {S('c.amount')} AS amount, c.is_fraud, k.burst_count, k.n_receivers,
  'velocity_attack' AS detector
FROM c JOIN k USING (transaction_id) WHERE k.burst_count >= 3 AND k.n_receivers >= 3"""


@register("q2b_velocity_attack_6h", _Q2B, "Q2 with a 6 h window and 3 rows: fires on the test tables")
def q2b(spark, sf):
    return snap_doubles(Q.detect_velocity_attack(txn_view(spark, sf), min_count=3, window_s=6 * 3600,
                                                 min_receivers=3).drop("timestamp"))


def _sub(q):
    """A detector's SQL (its own WITH chain) as a subquery over txn."""
    rest = q.split(W, 1)[1]
    return "WITH " + rest.lstrip()[1:].lstrip() if rest.lstrip().startswith(",") else rest.strip()


_Q6 = f"""{W}, hits AS (
  SELECT transaction_id, is_fraud, detector FROM ({_sub(_Q1)})
  UNION ALL SELECT transaction_id, is_fraud, detector FROM ({_sub(_Q2)})
  UNION ALL SELECT transaction_id, is_fraud, detector FROM ({_sub(_Q3)})
  UNION ALL SELECT transaction_id, is_fraud, detector FROM ({_sub(_Q4)})
  UNION ALL SELECT transaction_id, is_fraud, detector FROM ({_sub(_Q5)}))
SELECT detector, count(*) AS hits, count(*) FILTER (WHERE coalesce(is_fraud, false)) AS labelled_fraud,
  {S('CAST(count(*) FILTER (WHERE coalesce(is_fraud, false)) AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS label_share
FROM hits GROUP BY detector"""


@register("q6_pattern_summary", _Q6)
def q6(spark, sf):
    return snap_doubles(Q.pattern_summary(txn_view(spark, sf), account_of_receiver=_acct()))
