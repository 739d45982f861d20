"""Classifier metrics over a (label, score) DataFrame.

Everything is one aggregate over the rows (map-side combined) or an
aggregate per distinct score followed by the two-level prefix of
``ranking.exclusive_prefix``; no metric collects rows or uses an
unpartitioned window over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscope.functions.common import safe_div
from txnscope.operators.ranking import exclusive_prefix
from txnscope.schema import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE


def _is_true(label="is_fraud"):
    """Row filter on the label: NULL and false both drop the row, and the
    plain boolean lets a simple label predicate reach the parquet scan."""
    return F.col(label).cast("boolean")


def _y(label: str):
    return F.coalesce(F.col(label).cast("boolean"), F.lit(False))


def confusion(df: DataFrame, threshold: float = 0.5, label: str = "is_fraud",
              score: str = "fraud_score") -> DataFrame:
    """K1: one row (tn, fp, fn, tp) with prediction ``score >= threshold``."""
    y = _y(label)
    p = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    return df.agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def rates_from_confusion(cm: DataFrame) -> DataFrame:
    """K2: accuracy, precision, recall, F1, specificity (0 on a zero
    denominator) next to the counts."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec = safe_div(tp, tp + fp, 0.0)
    rec = safe_div(tp, tp + fn, 0.0)
    return cm.select(
        "tn", "fp", "fn", "tp",
        safe_div(tp + tn, tp + tn + fp + fn, 0.0).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        safe_div(F.lit(2.0) * prec * rec, prec + rec, 0.0).alias("f1"),
        safe_div(tn, tn + fp, 0.0).alias("specificity"))


def classification_metrics(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    return rates_from_confusion(confusion(df, threshold, **kw))


def score_table(df: DataFrame, label: str = "is_fraud", score: str = "fraud_score",
                n_bins: int | None = None) -> DataFrame:
    """One row per distinct score: pos, neg, and pos/neg strictly below it.

    Also carries the totals P and N (a one-row aggregate, cross-joined)."""
    y = _y(label)
    per = (df.filter(F.col(score).isNotNull())
             .groupBy(F.col(score).alias("score"))
             .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    pre = exclusive_prefix(per, "score", ["pos", "neg"], n_bins, prefix="below_")
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return pre.crossJoin(F.broadcast(tot))


def roc_auc(df: DataFrame, **kw) -> DataFrame:
    """K3: area under ROC with ties counted half (Mann-Whitney form)."""
    t = score_table(df, **kw)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    num = F.sum(pos * (F.col("below_neg").cast("double") + neg / F.lit(2.0)))
    return t.agg(safe_div(num, F.first("P").cast("double") * F.first("N").cast("double"))
                 .alias("roc_auc"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    """K4: step-wise average precision sum_s (dR) * P(s), no interpolation."""
    t = score_table(df, **kw)
    tp = (F.col("P") - F.col("below_pos")).cast("double")
    fp = (F.col("N") - F.col("below_neg")).cast("double")
    term = F.col("pos").cast("double") / F.col("P").cast("double") * (tp / (tp + fp))
    return t.agg(F.sum(F.when(F.col("pos") > 0, term)).alias("average_precision"))


def auc_and_ap(df: DataFrame, **kw) -> DataFrame:
    """K3 and K4 from one score table in one aggregate."""
    t = score_table(df, **kw)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = (F.col("P") - F.col("below_pos")).cast("double")
    fp = (F.col("N") - F.col("below_neg")).cast("double")
    auc = safe_div(F.sum(pos * (F.col("below_neg").cast("double") + neg / F.lit(2.0))),
                   F.first("P").cast("double") * F.first("N").cast("double"))
    ap = F.sum(F.when(F.col("pos") > 0, pos / F.col("P").cast("double") * (tp / (tp + fp))))
    return t.agg(auc.alias("roc_auc"), ap.alias("average_precision"))


def roc_curve(df: DataFrame, **kw) -> DataFrame:
    """K9: (threshold, fpr, tpr) at every distinct score (score >= t), and the
    starting point (0, 0) with a NULL threshold."""
    t = score_table(df, **kw)
    tp = (F.col("P") - F.col("below_pos")).cast("double")
    fp = (F.col("N") - F.col("below_neg")).cast("double")
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return t.select(F.col("score").alias("threshold"),
                    safe_div(fp, F.col("N")).alias("fpr"),
                    safe_div(tp, F.col("P")).alias("tpr")).unionByName(start)


def precision_recall_curve(df: DataFrame, **kw) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the final
    point (precision 1, recall 0) with a NULL threshold."""
    t = score_table(df, **kw)
    tp = (F.col("P") - F.col("below_pos")).cast("double")
    fp = (F.col("N") - F.col("below_neg")).cast("double")
    pts = t.select(F.col("score").alias("threshold"),
                   safe_div(tp, tp + fp, 0.0).alias("precision"),
                   safe_div(tp, F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _thresholds(start: float, stop: float, step: float) -> list[float]:
    """numpy.arange semantics: start + i*step while < stop (in doubles)."""
    out, i = [], 0
    while start + i * step < stop:
        out.append(start + i * step)
        i += 1
    return out


def threshold_sweep(df: DataFrame, start: float = 0.1, stop: float = 0.95,
                    step: float = 0.05, label: str = "is_fraud",
                    score: str = "fraud_score") -> DataFrame:
    """K6/K8: precision, recall, F1 and false-alarm rate at each threshold.

    One pass over the rows: a conditional count per threshold inside a
    single aggregate, then ``stack`` to long form (the threshold list is a
    fixed, short parameter)."""
    ts = _thresholds(start, stop, step)
    y = _y(label)
    aggs = [F.count_if(y).alias("P"), F.count_if(~y).alias("N")]
    for i, t in enumerate(ts):
        p = F.coalesce(F.col(score) >= F.lit(t), F.lit(False))
        aggs += [F.count_if(y & p).alias(f"tp{i}"), F.count_if(~y & p).alias(f"fp{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{i}, CAST({t!r} AS DOUBLE), tp{i}, fp{i}" for i, t in enumerate(ts))
    long = wide.selectExpr("P", "N", f"stack({len(ts)}, {stack}) AS (idx, threshold, tp, fp)")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    prec = safe_div(tp, tp + fp, 0.0)
    rec = safe_div(tp, P, 0.0)
    return long.select(
        "idx", "threshold", "tp", "fp",
        prec.alias("precision"), rec.alias("recall"),
        safe_div(F.lit(2.0) * prec * rec, prec + rec, 0.0).alias("f1"),
        safe_div(fp, N, 0.0).alias("false_alarm_rate"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """K7: the first maximum (lowest threshold on ties). A top-1 report."""
    return sweep.orderBy(F.col(metric).desc(), F.col("threshold").asc()).limit(1)


def classification_report(df: DataFrame, threshold: float = 0.5, label: str = "is_fraud",
                          score: str = "fraud_score") -> DataFrame:
    """K5: per class, macro and weighted averages, accuracy (long form)."""
    cm = confusion(df, threshold, label, score)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p1, r1 = safe_div(tp, tp + fp, 0.0), safe_div(tp, tp + fn, 0.0)
    p0, r0 = safe_div(tn, tn + fn, 0.0), safe_div(tn, tn + fp, 0.0)
    f1 = safe_div(F.lit(2.0) * p1 * r1, p1 + r1, 0.0)
    f0 = safe_div(F.lit(2.0) * p0 * r0, p0 + r0, 0.0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    w = cm.select(p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                  p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
                  n.alias("n"), safe_div(tp + tn, n, 0.0).alias("acc"))
    return w.selectExpr(
        "stack(5,"
        " 'class_0', p0, r0, f0, s0,"
        " 'class_1', p1, r1, f1, s1,"
        " 'macro_avg', (p0 + p1) / 2D, (r0 + r1) / 2D, (f0 + f1) / 2D, n,"
        " 'weighted_avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,"
        "   (f0 * s0 + f1 * s1) / n, n,"
        " 'accuracy', acc, acc, acc, n)"
        " AS (label, precision, recall, f1_score, support)")


def score_histogram(df: DataFrame, bins: int = 50, label: str = "is_fraud",
                    score: str = "fraud_score") -> DataFrame:
    """Density histogram of scores per class, ``bins`` equal bins over
    the class's [min, max] (last bin closed), like a plotting histogram."""
    y = _y(label).alias("cls")
    x = df.select(y, F.col(score).cast("double").alias("s")).filter(F.col("s").isNotNull())
    rng = x.groupBy("cls").agg(F.min("s").alias("lo"), F.max("s").alias("hi"),
                               F.count(F.lit(1)).alias("n"))
    raw = F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(raw, F.lit(bins - 1))).cast("int")
    # one row per class: bounded broadcast
    h = (x.join(F.broadcast(rng), "cls").withColumn("bin", b)
          .groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("count"),
                                     F.first("lo").alias("lo"), F.first("n").alias("n"),
                                     F.first("hi").alias("hi")))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))).otherwise(F.lit(1.0))
    return h.select(
        "cls", "bin",
        (F.col("lo") + F.col("bin") * w).alias("bin_start"),
        "count",
        (F.col("count").cast("double") / (F.col("n").cast("double") * w)).alias("density"))


def cost_analysis(cm: DataFrame, fn_cost: float = COST_FALSE_NEGATIVE,
                  fp_cost: float = COST_FALSE_POSITIVE) -> DataFrame:
    """Cost of missed fraud and false alarms from K1."""
    return cm.select(
        "fn", "fp",
        (F.col("fn").cast("double") * F.lit(fn_cost)).alias("missed_fraud_cost"),
        (F.col("fp").cast("double") * F.lit(fp_cost)).alias("false_alarm_cost"),
        (F.col("fn").cast("double") * F.lit(fn_cost)
         + F.col("fp").cast("double") * F.lit(fp_cost)).alias("total_cost"))


def business_impact(cm: DataFrame) -> DataFrame:
    """Share of fraud caught, false-alarm share, flagged precision."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return cm.select(
        "tn", "fp", "fn", "tp",
        safe_div(tp, tp + fn, 0.0).alias("fraud_caught_rate"),
        safe_div(fp, fp + tn, 0.0).alias("false_alarm_rate"),
        safe_div(tp, tp + fp, 0.0).alias("flagged_precision"))


def recall_by_pattern(df: DataFrame, threshold: float = 0.5, label: str = "is_fraud",
                      score: str = "fraud_score", pattern: str = "fraud_pattern") -> DataFrame:
    """Detection rate per fraud pattern among the positive rows."""
    p = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    return (df.filter(_is_true(label)).groupBy(F.col(pattern).alias("fraud_pattern"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(p).alias("caught"))
              .withColumn("recall", F.col("caught").cast("double") / F.col("n").cast("double")))


def split_summary(df: DataFrame, split_col: str = "split", label: str = "is_fraud") -> DataFrame:
    """Size, positives and positive rate per split."""
    return (df.groupBy(split_col)
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(_y(label)).alias("n_fraud"))
              .withColumn("fraud_rate", F.col("n_fraud").cast("double") / F.col("n").cast("double")))


def metrics_table(spark: SparkSession, values: dict) -> DataFrame:
    """Small helper: a one-row DataFrame of named metric values."""
    return spark.createDataFrame([tuple(values.values())], list(values.keys()))
