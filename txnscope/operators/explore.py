"""Label-aware summaries.

Each summary is one aggregate (with map-side combine) or a two-level
aggregate; medians and quartiles are exact via ``ranking.exact_quantiles``.
Many-feature summaries put every feature into a single aggregate and
``stack`` the result to long form instead of running one job per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.functions.common import safe_div
from txnscope.operators.ranking import exact_quantiles
from txnscope.schema import FEATURE_NAMES

HIST_FEATURES = ["hour", "is_night", "amount_raw", "amount_log", "tx_count_1h",
                 "tx_count_24h", "time_since_last_tx", "amount_deviation",
                 "is_new_receiver", "device_changed_flag", "location_changed_flag"]
COMPARE_FEATURES = ["hour", "amount_raw", "tx_count_1h", "tx_count_24h",
                    "amount_deviation", "time_since_last_tx", "is_night",
                    "is_new_receiver", "device_changed_flag"]
#: Whole numbers from 0 below this are counted by a bitmap.
BITMAP = 63
INTERACTIONS = ["high_amount_at_night", "new_receiver_large_amount",
                "device_changed_unusual_amount", "high_velocity_large_amount",
                "night_device_change"]


def _is_true(label="is_fraud"):
    """Row filter on the label: NULL and false both drop the row, and the
    plain boolean lets a simple label predicate reach the parquet scan."""
    return F.col(label).cast("boolean")


def _y(label="is_fraud"):
    return F.coalesce(F.col(label).cast("boolean"), F.lit(False))


def class_counts(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows per class and the class share."""
    c = df.groupBy(_y(label).alias("is_fraud")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_t"))  # one row
    return (c.crossJoin(F.broadcast(tot))
             .withColumn("share", F.col("n").cast("double") / F.col("_t").cast("double")).drop("_t"))


def pattern_counts(df: DataFrame, label: str = "is_fraud",
                   pattern: str = "fraud_pattern") -> DataFrame:
    """Fraud rows per pattern, most frequent first."""
    return (df.filter(_is_true(label)).groupBy(pattern).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(pattern)))


def value_histogram(df: DataFrame, value: str, bins: int = 50, label: str = "is_fraud",
                    density: bool = False) -> DataFrame:
    """N3/N11 core: equal-width bins over each class's [min, max]."""
    x = df.select(_y(label).alias("is_fraud"), F.col(value).cast("double").alias("v")) \
          .filter(F.col("v").isNotNull())
    rng = x.groupBy("is_fraud").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    F.count(F.lit(1)).alias("n"))
    raw = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    h = (x.join(F.broadcast(rng), "is_fraud")  # one row per class
          .groupBy("is_fraud", b.cast("int").alias("bin"))
          .agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
               F.first("hi").alias("hi"), F.first("n").alias("n")))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))) \
         .otherwise(F.lit(1.0))
    cols = [F.col("is_fraud"), F.col("bin"), (F.col("lo") + F.col("bin") * w).alias("bin_start"),
            F.col("count")]
    if density:
        cols.append((F.col("count").cast("double") / (F.col("n").cast("double") * w)).alias("density"))
    return h.select(*cols)


def amount_histogram(df: DataFrame, bins: int = 50, amount: str = "amount") -> DataFrame:
    """Amount histogram per class."""
    return value_histogram(df, amount, bins)


def describe_by_class(df: DataFrame, value: str, label: str = "is_fraud") -> DataFrame:
    """Count, mean, std, min, quartiles, max of ``value`` per class."""
    y = _y(label).alias("is_fraud")
    base = df.select(y, F.col(value).cast("double").alias("v"))
    agg = base.groupBy("is_fraud").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(base, "v", [0.25, 0.5, 0.75], by=["is_fraud"], few_groups=True)
    qw = q.groupBy("is_fraud").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"))
    return agg.join(qw, "is_fraud", "left")


def counts_by(df: DataFrame, key: str, label: str = "is_fraud") -> DataFrame:
    """Rows per (class, key)."""
    return df.groupBy(_y(label).alias("is_fraud"), key).agg(F.count(F.lit(1)).alias("n"))


def counts_by_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return counts_by(df.withColumn("hour", F.hour(ts)), "hour")


def counts_by_weekday(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return counts_by(df.withColumn("day_of_week", F.weekday(ts)), "day_of_week")


def first_fraud_rows(df: DataFrame, n: int = 5, label: str = "is_fraud") -> DataFrame:
    """The first ``n`` fraud rows in time order (a top-n report)."""
    return (df.filter(_is_true(label))
              .orderBy(F.col("timestamp"), F.col("transaction_id")).limit(n))


def flag_shares(df: DataFrame, flags=("device_changed", "location_changed"),
                label: str = "is_fraud") -> DataFrame:
    """Share of each flag value within each class (long form)."""
    y = _y(label).alias("is_fraud")
    stack = ", ".join(f"'{f}', CAST({f} AS BOOLEAN)" for f in flags)
    long = df.select(y, *flags).selectExpr("is_fraud", f"stack({len(flags)}, {stack}) AS (flag, value)")
    c = long.groupBy("is_fraud", "flag", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("is_fraud", "flag")
    return c.withColumn("share", F.col("n").cast("double") / F.sum("n").over(w).cast("double"))


def per_user_counts(df: DataFrame, user: str = "user_id", label: str = "is_fraud") -> DataFrame:
    """Describe of transactions per (user, class), per class."""
    c = df.groupBy(user, _y(label).alias("is_fraud")).agg(F.count(F.lit(1)).alias("n_tx"))
    return describe_by_class(c, "n_tx")


def feature_histograms(feat: DataFrame, features=HIST_FEATURES, bins: int = 30,
                       label: str = "is_fraud") -> DataFrame:
    """Density histograms of several features per class, long form."""
    stack = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    long = feat.select(_y(label).alias("is_fraud"), *features).selectExpr(
        "is_fraud", f"stack({len(features)}, {stack}) AS (feature, v)").filter("v IS NOT NULL")
    rng = long.groupBy("feature", "is_fraud").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    raw = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    # rng has features x classes rows: bounded broadcast
    h = (long.join(F.broadcast(rng), ["feature", "is_fraud"])
             .groupBy("feature", "is_fraud", b.cast("int").alias("bin"))
             .agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                  F.first("hi").alias("hi"), F.first("n").alias("n")))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))) \
         .otherwise(F.lit(1.0))
    return h.select("feature", "is_fraud", "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    "count", (F.col("count").cast("double") / (F.col("n").cast("double") * w)).alias("density"))


def label_correlations(feat: DataFrame, features=FEATURE_NAMES, label: str = "is_fraud",
                       top: int | None = 20) -> DataFrame:
    """Pearson correlation of each feature with the label, by |corr|.

    All features in one aggregate of sums; a constant column gives NULL
    (Spark's ``corr`` would raise under ANSI division rules)."""
    y = _y(label).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.covar_samp(x, y).alias(f"cv_{f}"), F.stddev_samp(x).alias(f"sx_{f}")]
    aggs.append(F.stddev_samp(y).alias("_sy"))
    wide = feat.agg(*aggs)
    stack = ", ".join(f"'{f}', `cv_{f}`, `sx_{f}`" for f in features)
    long = wide.selectExpr("_sy", f"stack({len(features)}, {stack}) AS (feature, cv, sx)")
    r = long.select("feature", F.try_divide(F.col("cv"), F.col("sx") * F.col("_sy")).alias("correlation"))
    r = r.withColumn("correlation", F.when(F.col("correlation").isNotNull() & ~F.isnan("correlation"),
                                           F.col("correlation")))
    r = r.orderBy(F.abs("correlation").desc_nulls_last(), F.col("feature"))
    return r.limit(top) if top else r


def class_comparison(feat: DataFrame, features=COMPARE_FEATURES, label: str = "is_fraud") -> DataFrame:
    """Mean and median per class and their fraud-minus-legit gaps."""
    stack = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    long = feat.select(_y(label).alias("is_fraud"), *features).selectExpr(
        "is_fraud", f"stack({len(features)}, {stack}) AS (feature, v)")
    means = long.groupBy("feature").agg(
        F.avg(F.when(~F.col("is_fraud"), F.col("v"))).alias("legitimate_mean"),
        F.avg(F.when(F.col("is_fraud"), F.col("v"))).alias("fraud_mean"))
    med = exact_quantiles(long, "v", [0.5], by=["feature", "is_fraud"], few_groups=True)
    medw = med.groupBy("feature").agg(
        F.max(F.when(~F.col("is_fraud"), F.col("q"))).alias("legitimate_median"),
        F.max(F.when(F.col("is_fraud"), F.col("q"))).alias("fraud_median"))
    j = means.join(medw, "feature", "left")
    return j.select("feature", "legitimate_mean", "fraud_mean", "legitimate_median", "fraud_median",
                    (F.col("fraud_mean") - F.col("legitimate_mean")).alias("mean_diff"),
                    (F.col("fraud_median") - F.col("legitimate_median")).alias("median_diff"))


def interaction_lift(feat: DataFrame, features=INTERACTIONS, label: str = "is_fraud") -> DataFrame:
    """Fraud rate where the flag is set, overall rate, lift, count."""
    y = _y(label).cast("double")
    aggs = [F.avg(y).alias("overall")]
    for f in features:
        on = F.col(f) == 1
        aggs += [F.avg(F.when(on, y)).alias(f"r_{f}"), F.count_if(on).alias(f"n_{f}")]
    wide = feat.agg(*aggs)
    stack = ", ".join(f"'{f}', `r_{f}`, `n_{f}`" for f in features)
    long = wide.selectExpr("overall", f"stack({len(features)}, {stack}) AS (feature, rate, n)")
    return long.select("feature", F.col("rate").alias("fraud_rate_when_set"),
                       F.col("overall").alias("overall_fraud_rate"),
                       F.when(F.col("overall") > 0, F.col("rate") / F.col("overall"))
                        .otherwise(F.lit(0.0)).alias("lift"),
                       F.col("n").alias("count"))


#: Values below this are counted by a bitmap.
BITMAP = 63


def feature_summary(feat: DataFrame, features=FEATURE_NAMES) -> DataFrame:
    """Type, missing, distinct, mean, std per feature, in two levels.

    Every task reduces its rows to one row per feature (counts, moments, and
    the small whole numbers, such as flags, hours and most counts, as a
    bitmap) and, batch by batch, one row for each other distinct value. Only
    these are shuffled, so the distinct counts are exact without a row per
    feature and row. -0.0 is 0.0 and all NaN are one value."""
    names, types, n = list(features), dict(feat.dtypes), len(features)

    def merged(one, two):
        """Count, mean and squared deviations of both parts together."""
        k = one[0] + two[0]
        d = two[1] - one[1]
        return (k, one[1] + d * two[0] / k, one[2] + two[2] + d * d * one[0] * two[0] / k) if one[0] and two[0] else (one if one[0] else two)

    def run(batches):
        bits, missing, moments = [0] * n, [0] * n, [(0, 0.0, 0.0)] * n
        for batch in batches:
            index, values = [], []
            for i in range(n):
                column = batch.column(i)
                x = column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                value = np.unique(x)
                whole = (value >= 0) & (value < BITMAP) & (value == np.floor(value))
                bits[i] |= int(np.bitwise_or.reduce(np.int64(1) << value[whole].astype(np.int64), initial=np.int64(0)))
                missing[i] += column.null_count
                mean = float(x.mean()) if len(x) else 0.0
                moments[i] = merged(moments[i], (len(x), mean, float(((x - mean) ** 2).sum())))
                values.append(value[~whole])
                index.append(np.full(len(values[-1]), i, np.int32))
            yield frame(np.concatenate(index), pa.array(np.concatenate(values)))
        yield frame(np.arange(n, dtype=np.int32), pa.nulls(n, pa.float64()), bits, missing, [dict(zip(("n", "mean", "m2"), m)) for m in moments])

    def frame(index, value, *stats):
        kinds = pa.int64(), pa.int64(), pa.struct([("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())])
        stats = [pa.array(c, t) for c, t in zip(stats, kinds)] or [pa.nulls(len(index), t) for t in kinds]
        return pa.RecordBatch.from_arrays([pa.array(index), value, *stats], names=["i", "value", "bits", "missing", "part"])

    # doubles hold the features' integers exactly up to 2^53
    parts = feat.select(*[F.col(f).cast("double").alias(f) for f in names]).mapInArrow(
        run, "i int, value double, bits long, missing long, part struct<n: long, mean: double, m2: double>")
    # a row per value, and one per feature (value NULL) with a part from each task
    values = parts.groupBy("i", "value").agg(F.bit_or("bits").alias("bits"), F.sum("missing").alias("missing"), F.collect_list("part").alias("parts"))
    own = F.col("value").isNull()
    all_ = values.groupBy("i").agg(
        (F.count("value") + F.sum(F.when(own, F.bit_count("bits")).otherwise(0))).alias("n_unique"),
        F.sum("missing").alias("missing"), F.flatten(F.collect_list(F.when(own, F.col("parts")))).alias("parts"))

    def together(a, p):
        k, d = a["n"] + p["n"], p["mean"] - a["mean"]
        both = F.struct(k.alias("n"), (a["mean"] + d * p["n"] / k).alias("mean"), (a["m2"] + p["m2"] + d * d * a["n"] * p["n"] / k).alias("m2"))
        return F.when(p["n"] == 0, a).when(a["n"] == 0, p).otherwise(both)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    all_ = all_.withColumn("m", F.reduce("parts", zero, together))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("i") + 1)
    seen = all_.select(pick(names).alias("feature"), pick([types[f] for f in names]).alias("dtype"), "missing", "n_unique",
                       F.when(F.col("m.n") > 0, F.col("m.mean")).alias("mean"),
                       F.when(F.col("m.n") > 1, F.sqrt(F.col("m.m2") / (F.col("m.n") - 1))).alias("std"))
    # a table without rows has no batches: every feature still has its row
    listed = feat.sparkSession.createDataFrame([(f, types[f]) for f in names], "feature string, dtype string")
    return listed.join(F.broadcast(seen.drop("dtype")), "feature", "left").select(
        "feature", "dtype", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "mean", "std")


def drift_check(feat: DataFrame, split_ts, ts: str = "timestamp", tolerance: float = 0.10,
                features=("amount_raw", "tx_count_1h", "is_night", "is_new_receiver")) -> DataFrame:
    """Relative change of feature means between the rows before and
    after ``split_ts``; flag when above ``tolerance``."""
    later = F.col(ts) >= F.lit(split_ts).cast("timestamp")
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(~later, F.col(f).cast("double"))).alias(f"b_{f}"),
                 F.avg(F.when(later, F.col(f).cast("double"))).alias(f"a_{f}")]
    wide = feat.agg(*aggs)
    stack = ", ".join(f"'{f}', `b_{f}`, `a_{f}`" for f in features)
    long = wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, before_mean, after_mean)")
    rel = safe_div(F.col("after_mean") - F.col("before_mean"), F.abs(F.col("before_mean")))
    return long.select("feature", "before_mean", "after_mean", rel.alias("relative_change"),
                       F.coalesce(F.abs(rel) > F.lit(tolerance), F.lit(False)).alias("drifted"))


def dataset_statistics(df: DataFrame, label: str = "is_fraud", amount: str = "amount") -> DataFrame:
    """Per class: rows, share, change-flag rates, mean and median amount."""
    y = _y(label).alias("is_fraud")
    base = df.select(y, F.col(amount).cast("double").alias("amount"),
                     F.col("device_changed").cast("double").alias("dc"),
                     F.col("location_changed").cast("double").alias("lc"))
    a = base.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dc").alias("device_change_rate"),
        F.avg("lc").alias("location_change_rate"), F.avg("amount").alias("mean_amount"))
    tot = a.agg(F.sum("n").alias("_t"))  # one row
    a = (a.crossJoin(F.broadcast(tot))
          .withColumn("share", F.col("n").cast("double") / F.col("_t").cast("double")).drop("_t"))
    med = exact_quantiles(base, "amount", [0.5], by=["is_fraud"], few_groups=True).select(
        "is_fraud", F.col("q").alias("median_amount"))
    return a.join(med, "is_fraud", "left")
