"""Time-ordered splits, folds, class weights, resampling, samples.

Cuts at a rank come from ``ranking.select_keys``: the cut key is selected from
counts of the keys, and the rows are compared with it where they are, so no
row moves and no job runs while the plan is built. Only positions of all rows
(``pos``, on request) need ``ranking.global_row_number`` (range-partitioned, no
single-partition window). Random choices use a seeded hash of the row id,
never ``rand()``, so results do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.operators.ranking import global_row_number, select_keys, with_reached

STRATEGIES = ("none", "class_weight", "undersample", "smote")


def _is_true(label="is_fraud"):
    """Row filter on the label: NULL and false both drop the row, and the
    plain boolean lets a simple label predicate reach the parquet scan."""
    return F.col(label).cast("boolean")


def _y(label="is_fraud"):
    return F.coalesce(F.col(label).cast("boolean"), F.lit(False))


def _seeded(seed: int, id_col: str):
    """48 bits of a digest that any SQL engine has, so that the choice can be
    made again elsewhere; ties go by id."""
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def time_position(df: DataFrame, ts: str = "timestamp", id_col: str = "transaction_id") -> DataFrame:
    """1-based position in (timestamp, id) order, as ``pos``."""
    k = df.withColumn("_ts_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return global_row_number(k, ["_ts_us", id_col], name="pos").drop("_ts_us")


def _key(ts: str, id_col: str):
    return F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts_us"), F.col(id_col))


def time_split(df: DataFrame, test_size: float = 0.2, ts: str = "timestamp",
               id_col: str = "transaction_id", position: bool = True) -> DataFrame:
    """L1: first ``int(n * (1 - test_size))`` rows in time order are
    'train', the rest 'test' (column ``split``). With ``position`` also each
    row's place in that order (``pos``), which takes a sort of all rows."""
    if position:
        df = time_position(df, ts, id_col)
    frac = 1.0 - float(test_size)
    keys = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts_us"), id_col)
    cut = select_keys(keys, ["_ts_us", id_col], lambda n: F.array(F.floor(n.cast("double") * F.lit(frac))))
    cut = cut.agg(F.max("key").alias("_cut"))  # one row; NULL if no row is for training
    first = F.col("_cut").isNotNull() & (_key(ts, id_col) <= F.col("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(first, F.lit("train")).otherwise(F.lit("test"))).drop("_cut")


def time_series_folds(df: DataFrame, k: int = 5, ts: str = "timestamp",
                      id_col: str = "transaction_id", position: bool = True) -> DataFrame:
    """Expanding-window folds. Block size ``n // (k+1)``; the last ``k``
    blocks are the test sets of folds 0..k-1 (column ``test_fold``, NULL for
    rows that are only ever training rows). Fold i trains on every row
    before its test block. ``position`` as in ``time_split``."""
    if position:
        df = time_position(df, ts, id_col)
    keys = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts_us"), id_col)

    def starts(n):
        size = F.floor(n / F.lit(k + 1))
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: n - (F.lit(k) - i) * size + 1)).otherwise(F.array().cast("array<long>"))
    cuts = select_keys(keys, ["_ts_us", id_col], starts).agg(F.array_sort(F.collect_list("key")).alias("_cuts"))  # k keys
    rows = with_reached(df.crossJoin(F.broadcast(cuts)).withColumn("_fold_key", _key(ts, id_col)), "_fold_key", "_cuts", k, "_reached")
    fold = F.col("_reached") - 1
    return rows.withColumn("test_fold", F.when(fold >= 0, fold).cast("int")).drop("_cuts", "_fold_key", "_reached")


def fold_frames(folded: DataFrame, i: int, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of fold ``i`` from ``time_series_folds``."""
    test = folded.filter(F.col("test_fold") == i)
    train = folded.filter(F.col("test_fold").isNull() | (F.col("test_fold") < i))
    return train, test


def _class_cuts(df: DataFrame, seed: int, label: str, id_col: str, ranks) -> DataFrame:
    """``df`` with each row's class, seeded hash, and the (hash, id) key at
    the rank of its class (``_cut``; NULL if there is none)."""
    h = df.withColumn("_cls", _y(label)).withColumn("_h", _seeded(seed, id_col))
    cuts = select_keys(h.select("_cls", "_h", id_col), ["_h", id_col], ranks, by=["_cls"]).select(F.col("_cls").alias("_of"), F.col("key").alias("_cut"))
    return h.join(F.broadcast(cuts), F.col("_cls") == F.col("_of"), "left").drop("_of")  # two rows


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     label: str = "is_fraud", id_col: str = "transaction_id") -> DataFrame:
    """L2: per class, the ``round(n_c * test_size)`` rows with the smallest
    seeded hash are 'test'; class shares are kept."""
    j = _class_cuts(df, seed, label, id_col, lambda n: F.array(F.round(n.cast("double") * F.lit(float(test_size))).cast("long")))
    test = F.col("_cut").isNotNull() & (F.struct("_h", id_col) <= F.col("_cut"))
    return j.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_cls", "_h", "_cut")


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """L3: ``weight`` = negatives/positives for positives, 1 for negatives
    (the boosted-tree ``scale_pos_weight``)."""
    tot = df.agg(F.count_if(_y(label)).alias("_p"), F.count_if(~_y(label)).alias("_n"))
    w = F.when(_y(label), F.try_divide(F.col("_n").cast("double"), F.col("_p").cast("double"))) \
         .otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(tot)).withColumn("weight", w).drop("_p", "_n")


def undersample(df: DataFrame, seed: int = 42, label: str = "is_fraud",
                id_col: str = "transaction_id") -> DataFrame:
    """L4: keep every minority row and as many majority rows (smallest
    seeded hash first, no replacement) as there are minority rows."""
    j = _class_cuts(df, seed, label, id_col, lambda n: F.array(F.min(n).over(Window.partitionBy())))  # a row per bin
    return j.filter(F.struct("_h", id_col) <= F.col("_cut")).drop("_cls", "_h", "_cut")


def resample(df: DataFrame, strategy: str = "class_weight", seed: int = 42, **kw) -> DataFrame:
    """Dispatch. 'class_weight' and 'none' pass rows through (weights
    are applied by the trainer for 'class_weight'); 'undersample' drops
    majority rows; unknown names raise. 'smote' adds
    minority rows up to parity (``neighbours.smote``)."""
    if strategy in ("none", "class_weight", None):
        return df
    if strategy == "undersample":
        return undersample(df, seed, **kw)
    if strategy == "smote":
        from txnscope.operators.neighbours import smote
        return smote(df, seed=seed, **kw)
    raise ValueError(f"unknown resampling strategy: {strategy!r}")


def sample_rows(df: DataFrame, n: int, seed: int = 42, per_class: bool = False,
                label: str = "is_fraud", id_col: str = "transaction_id") -> DataFrame:
    """``n`` rows with the smallest seeded hash, overall or per class.

    A sampling operator, so the limit is the feature: each part is a
    top-``n`` (bounded per task), not a sort of the data."""
    h = df.withColumn("_h", _seeded(seed, id_col))
    if not per_class:
        return h.orderBy("_h", id_col).limit(n).drop("_h")
    pos, neg = _is_true(label), ~_y(label)
    parts = [h.filter(c).orderBy("_h", id_col).limit(n) for c in (pos, neg)]
    return parts[0].unionByName(parts[1]).drop("_h")
