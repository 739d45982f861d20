"""Registered metric queries (K1-K14) on the canonical view's
deterministic score column (no model needed, so every metric has an exact
SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.functions.common import snap_sql as S
from txnscope.operators import metrics as K
from txnscope.operators.features import engineer_features, select_features
from txnscope.plans.catalog import register
from txnscope.plans.checked import snap_doubles
from txnscope.plans.sqltext import TXN_CTE
from txnscope.sources.tables import txn_view

W = f"WITH {TXN_CTE}"
Y = "coalesce(is_fraud, false)"


def _p(t):
    return f"coalesce(fraud_score >= CAST('{t!r}' AS DOUBLE), false)"


def _cm_sql(t):
    return (f"count(*) FILTER (WHERE NOT {Y} AND NOT {_p(t)}) AS tn, "
            f"count(*) FILTER (WHERE NOT {Y} AND {_p(t)}) AS fp, "
            f"count(*) FILTER (WHERE {Y} AND NOT {_p(t)}) AS fn, "
            f"count(*) FILTER (WHERE {Y} AND {_p(t)}) AS tp")


def _div(a, b):
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


@register("k1_confusion", f"{W} SELECT {_cm_sql(0.5)} FROM txn")
def k1(spark, sf):
    return K.confusion(txn_view(spark, sf), 0.5)


_K2 = f"""{W}, cm AS (SELECT {_cm_sql(0.75)} FROM txn),
r AS (SELECT *, {_div('tp', 'tp + fp')} AS pr, {_div('tp', 'tp + fn')} AS re FROM cm)
SELECT tn, fp, fn, tp,
  {S(_div('tp + tn', 'tp + tn + fp + fn'))} AS accuracy,
  {S('pr')} AS precision, {S('re')} AS recall,
  {S(_div('2 * pr * re', 'pr + re'))} AS f1,
  {S(_div('tn', 'tn + fp'))} AS specificity
FROM r"""


@register("k2_rates", _K2)
def k2(spark, sf):
    return snap_doubles(K.classification_metrics(txn_view(spark, sf), 0.75))


_SCORES = f"""{W}, s AS (
  SELECT fraud_score AS score, count(*) FILTER (WHERE {Y}) AS pos,
         count(*) FILTER (WHERE NOT {Y}) AS neg
  FROM txn WHERE fraud_score IS NOT NULL GROUP BY fraud_score),
c AS (
  SELECT score, pos, neg,
    coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_pos,
    coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg,
    sum(pos) OVER () AS "P", sum(neg) OVER () AS "N"
  FROM s)"""

_K3 = f"""{_SCORES}
SELECT {S('sum(CAST(pos AS DOUBLE) * (CAST(below_neg AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (CAST(max("P") AS DOUBLE) * CAST(max("N") AS DOUBLE))')} AS roc_auc FROM c"""


@register("k3_roc_auc", _K3)
def k3(spark, sf):
    return snap_doubles(K.roc_auc(txn_view(spark, sf)))


_TP = 'CAST("P" - below_pos AS DOUBLE)'
_FP = 'CAST("N" - below_neg AS DOUBLE)'
_K4 = f"""{_SCORES}
SELECT {S(f'sum(CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) / CAST("P" AS DOUBLE) * ({_TP} / ({_TP} + {_FP})) END)')} AS average_precision FROM c"""


@register("k4_average_precision", _K4)
def k4(spark, sf):
    return snap_doubles(K.average_precision(txn_view(spark, sf)))


_K5 = f"""{W}, cm AS (SELECT {_cm_sql(0.5)} FROM txn),
r AS (SELECT {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
             {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
             CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0,
             CAST(tp + tn + fp + fn AS DOUBLE) AS n, {_div('tp + tn', 'tp + tn + fp + fn')} AS acc FROM cm),
f AS (SELECT *, {_div('2 * p1 * r1', 'p1 + r1')} AS f1, {_div('2 * p0 * r0', 'p0 + r0')} AS f0 FROM r),
l AS (
  SELECT 'class_0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
  UNION ALL SELECT 'class_1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'macro_avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT 'weighted_avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f)
SELECT label, {S('precision')} AS precision, {S('recall')} AS recall, {S('f1_score')} AS f1_score, {S('support')} AS support FROM l"""


@register("k5_classification_report", _K5)
def k5(spark, sf):
    return snap_doubles(K.classification_report(txn_view(spark, sf), 0.5))


def _sweep_sql(start, stop, step):
    ts = K._thresholds(start, stop, step)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS idx, CAST('{t!r}' AS DOUBLE) AS threshold" for i, t in enumerate(ts))
    return f"""{W}, th AS ({rows}),
tot AS (SELECT count(*) FILTER (WHERE {Y}) AS "P", count(*) FILTER (WHERE NOT {Y}) AS "N" FROM txn),
cnt AS (
  SELECT th.idx, th.threshold,
    (SELECT count(*) FROM txn WHERE {Y} AND coalesce(fraud_score >= th.threshold, false)) AS tp,
    (SELECT count(*) FROM txn WHERE NOT {Y} AND coalesce(fraud_score >= th.threshold, false)) AS fp
  FROM th),
m AS (SELECT cnt.*, tot."P", tot."N", {_div('tp', 'tp + fp')} AS pr, {_div('tp', '"P"')} AS re FROM cnt, tot)"""


def _sweep_select():
    return (f"SELECT idx, {S('threshold')} AS threshold, tp, fp, {S('pr')} AS precision, "
            f"{S('re')} AS recall, {S(_div('2 * pr * re', 'pr + re'))} AS f1, "
            f"{S(_div('fp', '\"N\"'))} AS false_alarm_rate FROM m")


@register("k6_threshold_sweep", f"{_sweep_sql(0.1, 0.95, 0.05)}\n{_sweep_select()}")
def k6(spark, sf):
    return snap_doubles(K.threshold_sweep(txn_view(spark, sf), 0.1, 0.95, 0.05))


@register("k7_best_threshold", f"""{_sweep_sql(0.1, 0.95, 0.05)},
z AS ({_sweep_select()})
SELECT * FROM z ORDER BY f1 DESC, threshold ASC LIMIT 1""")
def k7(spark, sf):
    sw = snap_doubles(K.threshold_sweep(txn_view(spark, sf), 0.1, 0.95, 0.05))
    return K.best_threshold(sw, "f1")


@register("k8_false_alarm_sweep", f"{_sweep_sql(0.1, 0.9, 0.05)}\n{_sweep_select()}")
def k8(spark, sf):
    return snap_doubles(K.threshold_sweep(txn_view(spark, sf), 0.1, 0.9, 0.05))


@register("k9_roc_curve", f"""{_SCORES}
SELECT {S('score')} AS threshold, {S(_div('"N" - below_neg', '"N"'))} AS fpr,
       {S(_div('"P" - below_pos', '"P"'))} AS tpr FROM c
UNION ALL SELECT NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""")
def k9(spark, sf):
    return snap_doubles(K.roc_curve(txn_view(spark, sf)))


@register("k10_precision_recall_curve", f"""{_SCORES}
SELECT {S('score')} AS threshold, {S(_div('"P" - below_pos', '("P" - below_pos) + ("N" - below_neg)'))} AS precision,
       {S(_div('"P" - below_pos', '"P"'))} AS recall FROM c
UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")
def k10(spark, sf):
    return snap_doubles(K.precision_recall_curve(txn_view(spark, sf)))


_K11 = f"""{W}, x AS (SELECT {Y} AS cls, CAST(fraud_score AS DOUBLE) AS s FROM txn WHERE fraud_score IS NOT NULL),
r AS (SELECT cls, min(s) AS lo, max(s) AS hi, count(*) AS n FROM x GROUP BY cls),
b AS (SELECT x.cls, r.lo, r.hi, r.n,
        CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((x.s - r.lo) / (r.hi - r.lo) * CAST(50 AS DOUBLE)), 49) END AS INTEGER) AS bin
      FROM x JOIN r USING (cls)),
h AS (SELECT cls, bin, count(*) AS count, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM b GROUP BY cls, bin),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / CAST(50 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS wd FROM h)
SELECT cls, bin, {S('lo + bin * wd')} AS bin_start, count, {S('CAST(count AS DOUBLE) / (CAST(n AS DOUBLE) * wd)')} AS density FROM w"""


@register("k11_score_histogram", _K11)
def k11(spark, sf):
    return snap_doubles(K.score_histogram(txn_view(spark, sf), 50))


@register("k12_cost_analysis", f"""{W}, cm AS (SELECT {_cm_sql(0.5)} FROM txn)
SELECT fn, fp, {S('CAST(fn AS DOUBLE) * 8500')} AS missed_fraud_cost, {S('CAST(fp AS DOUBLE) * 50')} AS false_alarm_cost,
  {S('CAST(fn AS DOUBLE) * 8500 + CAST(fp AS DOUBLE) * 50')} AS total_cost FROM cm""")
def k12(spark, sf):
    return snap_doubles(K.cost_analysis(K.confusion(txn_view(spark, sf), 0.5)))


@register("k13_business_impact", f"""{W}, cm AS (SELECT {_cm_sql(0.75)} FROM txn)
SELECT tn, fp, fn, tp, {S(_div('tp', 'tp + fn'))} AS fraud_caught_rate, {S(_div('fp', 'fp + tn'))} AS false_alarm_rate,
  {S(_div('tp', 'tp + fp'))} AS flagged_precision FROM cm""")
def k13(spark, sf):
    return snap_doubles(K.business_impact(K.confusion(txn_view(spark, sf), 0.75)))


@register("k14_recall_by_pattern", f"""{W}
SELECT fraud_pattern, count(*) AS n, count(*) FILTER (WHERE {_p(0.5)}) AS caught,
  {S('CAST(count(*) FILTER (WHERE ' + _p(0.5) + ') AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS recall
FROM txn WHERE {Y} GROUP BY fraud_pattern""")
def k14(spark, sf):
    return snap_doubles(K.recall_by_pattern(txn_view(spark, sf), 0.5))




from txnscope.operators import splits as L  # noqa: E402

_POS = f"""{W}, p AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) AS pos, count(*) OVER () AS n FROM txn)"""


@register("l1_time_split", f"""{_POS}
SELECT transaction_id, pos, CASE WHEN pos <= floor(CAST(n AS DOUBLE) * CAST('{1.0 - 0.2!r}' AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM p""")
def l1(spark, sf):
    return L.time_split(txn_view(spark, sf), 0.2).select("transaction_id", "pos", "split")


@register("l5_smote_balance", f"""WITH {TXN_CTE}, c AS (SELECT count(*) FILTER (WHERE is_fraud) AS p, count(*) FILTER (WHERE NOT is_fraud) AS n FROM txn)
SELECT y AS is_fraud, greatest(p, n) AS n_rows, CASE WHEN y THEN p ELSE n END AS n_given, CAST(0 AS BIGINT) AS n_outside
FROM c, (VALUES (true), (false)) v(y)""", "minority rows up to parity, all between given rows")
def l5(spark, sf):
    f = select_features(engineer_features(txn_view(spark, sf)))
    names = [c for c in f.columns if c not in ("transaction_id", "user_id", "timestamp", "is_fraud")]
    out = L.resample(f, "smote", 42)
    # a new row lies within the minority's range in every feature
    of = f.filter("is_fraud").agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in names], *[F.max(c).cast("double").alias(f"hi_{c}") for c in names])
    outside = F.lit(False)
    for c in names:
        outside = outside | (F.col(c) < F.col(f"lo_{c}") - 1e-9) | (F.col(c) > F.col(f"hi_{c}") + 1e-9)
    new = F.col("transaction_id").contains("~")
    return (out.crossJoin(F.broadcast(of)).groupBy("is_fraud")  # one row
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~new).alias("n_given"), F.count_if(new & outside).alias("n_outside")))


@register("l7_time_series_folds", f"""{_POS}, q AS (SELECT *, n // 6 AS sz, n - 5 * (n // 6) AS st FROM p)
SELECT transaction_id, pos, CAST(coalesce(CASE WHEN sz > 0 AND pos > st THEN floor((pos - 1 - st) / sz) END, -1) AS INTEGER) AS test_fold FROM q""")
def l7(spark, sf):
    # -1 marks rows that only ever train (NULL in the operator's output)
    f = L.time_series_folds(txn_view(spark, sf), 5)
    return f.select("transaction_id", "pos", F.coalesce("test_fold", F.lit(-1)).alias("test_fold"))


@register("l3_class_weight", f"""{W}, t AS (SELECT count(*) FILTER (WHERE {Y}) AS p, count(*) FILTER (WHERE NOT {Y}) AS n FROM txn)
SELECT transaction_id, {S(f'CASE WHEN {Y} THEN CAST(n AS DOUBLE) / CAST(p AS DOUBLE) ELSE CAST(1 AS DOUBLE) END')} AS weight FROM txn, t""")
def l3(spark, sf):
    return snap_doubles(L.class_weight(txn_view(spark, sf)).select("transaction_id", "weight"))


@register("k15_split_summary", f"""{_POS}, s AS (SELECT *, CASE WHEN pos <= floor(CAST(n AS DOUBLE) * CAST('{1.0 - 0.2!r}' AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM p)
SELECT split, count(*) AS n, count(*) FILTER (WHERE {Y}) AS n_fraud,
  {S(f'CAST(count(*) FILTER (WHERE {Y}) AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS fraud_rate FROM s GROUP BY split""")
def k15(spark, sf):
    return snap_doubles(K.split_summary(L.time_split(txn_view(spark, sf), 0.2, position=False)))


_HASHED = f"""{W}, h AS (SELECT *, {Y} AS cls, CAST('0x' || substr(md5('42:' || transaction_id), 1, 12) AS BIGINT) AS hash FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY hash, transaction_id) AS rk, count(*) OVER (PARTITION BY cls) AS nc FROM h)"""


@register("l2_stratified_split", f"""{_HASHED}
SELECT transaction_id, is_fraud, CASE WHEN rk <= round(nc * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r""")
def l2(spark, sf):
    return L.stratified_split(txn_view(spark, sf), 0.2, 42).select("transaction_id", "is_fraud", "split")


_L4 = f"""{_HASHED} SELECT transaction_id, is_fraud FROM r WHERE rk <= (SELECT min(nc) FROM r)"""


@register("l4_undersample", _L4)
def l4(spark, sf):
    return L.undersample(txn_view(spark, sf), 42).select("transaction_id", "is_fraud")


@register("l6_resample", _L4, "the dispatch by strategy name")
def l6(spark, sf):
    return L.resample(txn_view(spark, sf), "undersample", 42).select("transaction_id", "is_fraud")


@register("l8_sample_per_class", f"""{_HASHED} SELECT transaction_id, is_fraud, fraud_score FROM r WHERE rk <= 5""")
def l8(spark, sf):
    return L.sample_rows(txn_view(spark, sf), 5, 42, per_class=True).select(
        "transaction_id", "is_fraud", "fraud_score")
