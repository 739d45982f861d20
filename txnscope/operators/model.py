"""Boosted-tree training, tuning, importance,
attributions and model-backed scoring with Spark ML.

Training is distributed by Spark ML; the only driver-side loops are over
trials and folds (a handful of fits), never over rows. Attributions are
Shapley values, computed inside ``mapInPandas`` with the (bounded) leaves of
the trees broadcast.
"""

from __future__ import annotations

import functools
import json
import math
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnscope.functions import scoring as P
from txnscope.operators import metrics as K
from txnscope.operators.splits import class_weight, fold_frames, time_series_folds
from txnscope.schema import DEFAULT_THRESHOLD, FEATURE_CATEGORIES, FEATURE_NAMES
from txnscope.session import checkpoint_dir

# Default training parameters (reference defaults; XGBoost names mapped to
# Spark ML: n_estimators->maxIter, max_depth->maxDepth,
# learning_rate->stepSize, subsample->subsamplingRate).
DEFAULT_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "0.8"}
# The random-search grid (min_child_weight and gamma under
# Spark ML's names; its trees have no L1 and L2 penalties).
PARAM_GRID = {
    "maxIter": [100, 200, 300, 500],
    "maxDepth": [3, 5, 7, 10, 15],
    "stepSize": [0.01, 0.05, 0.1, 0.2, 0.3],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.6", "0.7", "0.8", "0.9", "1.0"],
    "minInstancesPerNode": [1, 3, 5, 7],
    "minInfoGain": [0.0, 0.1, 0.2, 0.3, 0.4],
}
#: Fits that a search runs at a time; each persists its own rows' bins.
PARALLEL_FITS = 4


def _label(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.withColumn("_label", F.coalesce(F.col(label).cast("boolean"), F.lit(False)).cast("double"))


def assembler(features=FEATURE_NAMES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _prep(df: DataFrame, features=FEATURE_NAMES) -> DataFrame:
    # NULL/NaN features -> 0, as the reference fills before fitting
    return df.fillna(0, subset=[f for f in features if f in df.columns])


def train(df: DataFrame, params: dict | None = None, features=FEATURE_NAMES,
          label: str = "is_fraud", weighted: bool = True, seed: int = 42) -> PipelineModel:
    """M1: assembler + gradient-boosted trees, positives weighted by
    negatives/positives."""
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    data = _label(_prep(df, features), label)
    if weighted:
        data = class_weight(data, label)
    gbt = GBTClassifier(featuresCol="features", labelCol="_label", seed=seed,
                        weightCol="weight" if weighted else None, **p)
    return Pipeline(stages=[assembler(features), gbt]).fit(data)


def train_random_forest(df: DataFrame, features=FEATURE_NAMES, label: str = "is_fraud",
                        num_trees: int = 100, max_depth: int = 10, seed: int = 42) -> PipelineModel:
    """M5: random forest for a first importance ranking (NULL -> 0). Rows keep
    their node in every tree, so that no pass walks the trees again from the
    root; the trees are the same."""
    data = _label(_prep(df, features), label)
    rf = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[assembler(features), rf]).fit(data)


def score(model: PipelineModel, df: DataFrame, features=FEATURE_NAMES) -> DataFrame:
    """``fraud_score`` = probability of the positive class."""
    out = model.transform(_prep(df, features))
    return out.withColumn("fraud_score", vector_to_array("probability")[1]) \
              .drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, spark: SparkSession | None = None,
                       features=FEATURE_NAMES) -> DataFrame:
    """M6: (feature, importance) sorted descending (43 rows of model
    metadata)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = spark or SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
                .orderBy(F.col("importance").desc(), F.col("feature"))


def importance_map(model: PipelineModel, features=FEATURE_NAMES) -> dict[str, float]:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return dict(zip(features, imp))


def compare_importance(a: DataFrame, b: DataFrame, top: int = 10,
                       names=("importance_a", "importance_b")) -> DataFrame:
    """M9: inner join of two importance tables on feature, top ``top`` by
    the first (a top-n report)."""
    j = a.select("feature", F.col("importance").alias(names[0])).join(
        b.select("feature", F.col("importance").alias(names[1])), "feature")
    return j.orderBy(F.col(names[0]).desc(), F.col("feature")).limit(top)


def importance_by_category(imp: DataFrame, categories: dict | None = None) -> DataFrame:
    """Importance summed over the named feature groups, with each
    group's share and the combined share of the top three groups."""
    cats = categories or FEATURE_CATEGORIES
    spark = imp.sparkSession
    m = spark.createDataFrame([(f, c) for c, fs in cats.items() for f in fs], "feature string, category string")
    g = (imp.join(F.broadcast(m), "feature")  # 43-row map: bounded broadcast
            .groupBy("category").agg(F.sum("importance").alias("importance")))
    tot = g.agg(F.sum("importance").alias("_t"))
    g = g.crossJoin(F.broadcast(tot)).withColumn("share", F.try_divide(F.col("importance"), F.col("_t")))
    # seven rows: an unpartitioned window over the group table is bounded
    w = g.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("category"))))
    top3 = w.filter(F.col("_rk") <= 3).agg(F.sum("share").alias("top3_share"))
    return w.crossJoin(F.broadcast(top3)).drop("_t", "_rk")


# --------------------------------------------------------------------------
# evaluation, cross-validation, tuning

def evaluate(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, label: str = "is_fraud") -> dict:
    """K1-K4 on a scored frame, as a small dict (one row each)."""
    s = scored.select(label, "fraud_score").persist()
    m = K.classification_metrics(s, threshold, label=label).first().asDict()
    m.update(K.auc_and_ap(s, label=label).first().asDict())
    s.unpersist()
    return m


def cross_validate(df: DataFrame, k: int = 5, params: dict | None = None,
                   resample_fn=None, label: str = "is_fraud", weighted: bool = True) -> DataFrame:
    """M3: expanding time folds; train and test precision, recall, F1, ROC
    AUC, AP per fold (long form). Resampling, if any, runs inside each
    training fold."""
    spark = df.sparkSession
    folded = time_series_folds(df, k, position=False).persist()
    rows = []
    for i in range(k):
        tr, te = fold_frames(folded, i, k)
        if resample_fn is not None:
            tr = resample_fn(tr)
        model = train(tr, params, weighted=weighted, label=label)
        for split, part in (("train", tr), ("test", te)):
            m = evaluate(score(model, part), label=label)
            for key in ("precision", "recall", "f1", "roc_auc", "average_precision"):
                rows.append((i, split, key, float(m[key]) if m[key] is not None else None))
    folded.unpersist()
    return spark.createDataFrame(rows, "fold int, split string, metric string, value double")


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and std of each metric over folds."""
    return cv.groupBy("split", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def sample_params(n_iter: int, seed: int = 42, grid: dict | None = None) -> list[dict]:
    """``n_iter`` distinct points of the grid (all of it, if it has fewer)."""
    g = grid or PARAM_GRID
    total = math.prod(map(len, g.values()))
    out = []
    for point in random.Random(seed).sample(range(total), min(n_iter, total)):
        params = {}
        for k, v in g.items():
            point, at = divmod(point, len(v))
            params[k] = v[at]
        out.append(params)
    return out


def tune(df: DataFrame, n_iter: int = 30, k: int = 5, scoring: str = "f1", seed: int = 42,
         grid: dict | None = None, label: str = "is_fraud", strategy: str = "class_weight") -> tuple[PipelineModel, DataFrame]:
    """M2: random search over ``grid`` with expanding time folds, refit the
    best trial on all rows. The balance strategy holds in every fit, and
    resampling sees training rows only. ``PARALLEL_FITS`` fits run at a time:
    one alone leaves cores idle between its passes. Returns (model, trials)."""
    from txnscope.operators.splits import resample
    spark = df.sparkSession
    weighted = strategy == "class_weight"
    folded = time_series_folds(df, k, position=False).persist()

    def fold_score(params, i):
        tr, te = fold_frames(folded, i, k)
        m = evaluate(score(train(resample(tr, strategy, seed), params, weighted=weighted, label=label), te), label=label)
        return float(m[scoring] or 0.0)

    trials = []
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fits = [(params, [pool.submit(inheritable_thread_target(spark)(fold_score), params, i) for i in range(k)])
                for params in sample_params(n_iter, seed, grid)]
        try:
            for t, (params, folds) in enumerate(fits):
                scores = [f.result() for f in folds]
                trials.append((t, json.dumps(params, sort_keys=True), float(np.mean(scores)), float(np.std(scores))))
        except BaseException:
            pool.shutdown(cancel_futures=True)  # no other fit begins
            raise
    tdf = spark.createDataFrame(trials, "trial int, params string, mean_score double, std_score double")
    best = max(trials, key=lambda r: (r[2], -r[0]))
    # the persisted rows, not another evaluation of the input for every pass of the fit
    model = train(resample(folded.drop("test_fold"), strategy, seed), json.loads(best[1]), weighted=weighted, label=label)
    folded.unpersist()
    return model, tdf


def top_trials(trials: DataFrame, n: int = 5) -> DataFrame:
    """M4: the ``n`` best trials (a top-n report)."""
    return trials.orderBy(F.col("mean_score").desc(), F.col("trial")).limit(n)


# --------------------------------------------------------------------------
# Shapley values

def tree_tables(model: PipelineModel) -> tuple[pd.DataFrame, list[float]]:
    """Node table of every tree (bounded by trees x 2^(depth+1)) and the
    tree weights, read from the model's saved form."""
    spark = SparkSession.getActiveSession()
    gbt = model.stages[-1]
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-nodes-{uuid.uuid4().hex}"
    gbt.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", F.col("nodeData.rawCount").alias("rows"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr")).toPandas()
    weights = list(gbt.treeWeights)
    return nodes, weights


@dataclass
class Leaf:
    """A tree's leaf: the intervals (low, high] that its path allows for each
    feature on it, the share of the training rows that stay on the path at
    that feature's splits, and the leaf's (weighted) value."""
    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(nodes: pd.DataFrame, weights: list[float]) -> list[Leaf]:
    """The leaves of all trees."""
    out = []
    for tree, table in nodes.groupby("treeID"):
        node = table.set_index("id")
        left, right, feature, rows, value = (node[c].to_dict() for c in ("leftChild", "rightChild", "featureIndex", "rows", "prediction"))
        threshold = {i: float(t[0]) if len(t) else math.nan for i, t in node["thr"].items()}
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            if left[at] < 0:
                names = sorted(path)
                bounds = np.array([path[f] for f in names]).reshape(-1, 3)
                out.append(Leaf(weights[tree] * value[at], np.array(names, np.int64), bounds[:, 0], bounds[:, 1], bounds[:, 2]))
                continue
            low, high, share = path.get(feature[at], (-math.inf, math.inf, 1.0))
            t = threshold[at]
            for child, bound in ((left[at], (low, min(high, t))), (right[at], (max(low, t), high))):
                todo.append((child, {**path, feature[at]: (*bound, share * rows[child] / rows[at])}))
    return out


def leaf_shapley(share: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Shapley values of the features of one path for a leaf of value 1; or,
    with ``share`` (leaves x features), of several paths at once.

    ``inside`` (rows x features): whether a row keeps to the path at all of a
    feature's splits. A coalition S of known features gives the leaf the
    product of ``inside`` over S and of ``share`` over the rest, so the sums
    over coalitions of a size are the coefficients of the product of
    (share + inside t) over the other features."""
    n, m = inside.shape
    known = inside.astype(float)
    share = share[..., None, :]
    size = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty((*share.shape[:-2], n, m))
    for i in range(m):
        poly = np.zeros((*share.shape[:-2], n, m))
        poly[..., 0] = 1.0
        for j in range(m):
            if j != i:
                poly[..., 1:] = share[..., j:j + 1] * poly[..., 1:] + known[:, j:j + 1] * poly[..., :-1]
                poly[..., 0] *= share[..., j]
        out[..., i] = (poly @ size) * (known[:, i] - share[..., i])
    return out


#: Paths of at most so many features have a table of all patterns' values.
TABLE_FEATURES = 8
TABLE_LEAVES = 256


def pattern_tables(trees: list[Leaf]) -> list[np.ndarray | None]:
    """Per leaf its Shapley values by feature and pattern (which features keep
    to the path, as bits); None for paths of more than ``TABLE_FEATURES``
    features, whose patterns are too many."""
    out: list[np.ndarray | None] = [None] * len(trees)
    for m in range(1, TABLE_FEATURES + 1):
        inside = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        of = [i for i, leaf in enumerate(trees) if len(leaf.features) == m]
        for at in range(0, len(of), TABLE_LEAVES):
            some = of[at:at + TABLE_LEAVES]
            values = leaf_shapley(np.stack([trees[i].share for i in some]), inside)
            for i, v in zip(some, values):
                out[i] = np.ascontiguousarray(trees[i].value * v.T)
    return out


#: A group of leaves has at most so many states (bounds of its paths passed or
#: not); its leaves' values are added up in one table.
GROUP_STATES = 256


@dataclass
class Group:
    """Leaves that are looked up together: for each of ``features`` the
    numbers of the bounds on the leaves' paths, the state's step by one bound,
    and the values of every feature in every state."""
    features: np.ndarray
    bounds: list[list[int]]
    steps: list[int]
    values: np.ndarray


@dataclass
class Grouped:
    """The bounds of every feature, rising; the groups of the leaves that have
    tables; the other leaves; the base value."""
    bounds: dict[int, np.ndarray]
    groups: list[Group]
    rest: list[Leaf]
    base: float


def grouped_tables(trees: list[Leaf], tables: list[np.ndarray | None]) -> Grouped:
    """The leaves in groups, in the trees' order: neighbours share most of
    their path."""
    of: dict[int, set] = {}
    for leaf in trees:
        for f, low, high in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), strict=True):
            of.setdefault(f, set()).update(b for b in (low, high) if math.isfinite(b))
    bounds = {f: np.array(sorted(q)) for f, q in of.items()}
    number = {f: {b: i for i, b in enumerate(q.tolist())} for f, q in bounds.items()}
    groups, rest, members, have = [], [], [], {}

    def close():
        if members:
            groups.append(group_of(members, have, number))

    for leaf, table in zip(trees, tables, strict=True):
        if table is None:
            if len(leaf.features):
                rest.append(leaf)
            continue
        mine = {f: {number[f][b] for b in (low, high) if math.isfinite(b)}
                for f, low, high in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), strict=True)}
        both = {f: have.get(f, set()) | mine.get(f, set()) for f in {*have, *mine}}
        if members and math.prod(len(q) + 1 for q in both.values()) > GROUP_STATES:
            close()
            members, both = [], mine
        members.append((leaf, table))
        have = both
    close()
    return Grouped(bounds, groups, rest, sum(leaf.value * float(np.prod(leaf.share)) for leaf in trees))


@dataclass
class Trees:
    """Leaves with their tables, which a Python worker makes once for all of
    its tasks, as it keeps what is broadcast."""
    leaves: list[Leaf]

    @functools.cached_property
    def tables(self) -> Grouped:
        return grouped_tables(self.leaves, pattern_tables(self.leaves))


def group_of(members: list, have: dict, number: dict) -> Group:
    features = sorted(have)
    bounds = [sorted(have[f]) for f in features]
    sizes = [len(q) + 1 for q in bounds]
    steps = [math.prod(sizes[:i]) for i in range(len(sizes))]
    state = np.arange(math.prod(sizes))
    passed = {f: state // step % size for f, step, size in zip(features, steps, sizes, strict=True)}
    at = {f: {b: i for i, b in enumerate(q)} for f, q in zip(features, bounds, strict=True)}
    values = np.zeros((len(features), len(state)))
    for leaf, table in members:
        pattern = np.zeros(len(state), np.int64)
        for k, (f, low, high) in enumerate(zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), strict=True)):
            inside = np.ones(len(state), bool)
            if high < math.inf:
                inside &= passed[f] <= at[f][number[f][high]]
            if low > -math.inf:
                inside &= passed[f] > at[f][number[f][low]]
            pattern |= inside.astype(np.int64) << k
        for k, f in enumerate(leaf.features.tolist()):
            values[features.index(f)] += table[k].take(pattern)
    return Group(np.array(features, np.int64), bounds, steps, values)


def by_leaf(trees: list[Leaf], columns: np.ndarray, out: np.ndarray) -> None:
    """Add the Shapley values (features x rows) of one leaf after another."""
    for leaf in trees:
        if not len(leaf.features):
            continue
        pattern = np.zeros(columns.shape[1], np.int64)
        for k, f in enumerate(leaf.features):
            inside = columns[f] <= leaf.high[k]
            if leaf.low[k] > -math.inf:
                inside &= columns[f] > leaf.low[k]
            pattern |= inside.astype(np.int64) << k
        seen, pattern = np.unique(pattern, return_inverse=True)  # rows with the same pattern share one computation
        table = leaf.value * leaf_shapley(leaf.share, (seen[:, None] >> np.arange(len(leaf.features))) & 1).T
        for f, values in zip(leaf.features, table):
            out[f] += values.take(pattern)


def shapley_values(trees: list[Leaf], x: np.ndarray, tables: list | Grouped | None = None) -> tuple[np.ndarray, float]:
    """Shapley values of every row and feature, and the base value: what the
    trees give when no feature is known (the mean over their training rows'
    paths). A row's values for a group of leaves are looked up by the bounds
    that it passes on their paths (``tables``: the trees' ``pattern_tables``,
    or these in groups, for calls with many batches)."""
    if not isinstance(tables, Grouped):
        tables = grouped_tables(trees, pattern_tables(trees) if tables is None else tables)
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    passed = {}
    for f, bounds in tables.bounds.items():
        n = np.searchsorted(bounds, columns[f])  # a value passes the bounds below it
        passed[f] = n.astype(np.uint8 if len(bounds) < 256 else np.int32)
    for group in tables.groups:
        state = np.zeros(len(x), np.uint16 if group.values.shape[1] > 256 else np.uint8)
        for f, bounds, step in zip(group.features.tolist(), group.bounds, group.steps, strict=True):
            for b in bounds:
                state += (passed[f] > b).view(np.uint8) * state.dtype.type(step)
        state = state.astype(np.intp)
        for f, values in zip(group.features.tolist(), group.values):
            out[f] += values.take(state)
    by_leaf(tables.rest, columns, out)
    if (none := np.isnan(columns).any(axis=0)).any():  # a missing value is on neither side of a bound
        some = np.zeros((len(columns), int(none.sum())))
        by_leaf(trees, columns[:, none], some)
        out[:, none] = some
    return np.ascontiguousarray(out.T), tables.base


def attributions(model: PipelineModel, df: DataFrame, features=FEATURE_NAMES,
                 id_col: str = "transaction_id") -> DataFrame:
    """M7 core: per row, the Shapley value of each feature for the model's raw
    margin, where unknown features follow the training rows down the trees.
    Values plus ``__base__`` equal the margin. Long form: (id, feature,
    contribution) plus one ('__base__') row per id. The trees (bounded by the
    model's size) are broadcast; rows are handled in Arrow batches."""
    bc = df.sparkSession.sparkContext.broadcast(Trees(leaves(*tree_tables(model))))
    fnames = list(features)

    def run(batches):
        for pdf in batches:
            contrib, base = shapley_values(bc.value.leaves, pdf[fnames].astype("float64").fillna(0.0).to_numpy(), bc.value.tables)
            out = pd.DataFrame(contrib, columns=fnames)
            out.insert(0, "__base__", base)
            out.insert(0, id_col, pdf[id_col].to_numpy())
            yield out

    schema = T.StructType([T.StructField(id_col, T.StringType()), T.StructField("__base__", T.DoubleType())]
                          + [T.StructField(f, T.DoubleType()) for f in fnames])
    wide = _prep(df, features).select(id_col, *fnames).mapInPandas(run, schema)
    stack = ", ".join(f"'{f}', `{f}`" for f in ["__base__"] + fnames)
    return wide.selectExpr(id_col, f"stack({len(fnames) + 1}, {stack}) AS (feature, contribution)")


def attribution_importance(model: PipelineModel, df: DataFrame, features=FEATURE_NAMES) -> DataFrame:
    """M7: mean absolute contribution per feature over the given rows
    (callers pass a sample from ``sample_rows`` to bound the cost)."""
    a = attributions(model, df, features).filter(F.col("feature") != "__base__")
    return (a.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
             .orderBy(F.col("mean_abs_contribution").desc(), F.col("feature")))


def row_attribution(model: PipelineModel, df: DataFrame, transaction_id: str,
                    features=FEATURE_NAMES) -> DataFrame:
    """M8: one row's contributions (the waterfall data), by id."""
    one = df.filter(F.col("transaction_id") == F.lit(transaction_id))
    return attributions(model, one, features).orderBy(F.abs("contribution").desc())


# --------------------------------------------------------------------------
# persistence and scoring services

@dataclass
class ModelBundle:
    model: PipelineModel
    threshold: float = DEFAULT_THRESHOLD
    metadata: dict = field(default_factory=dict)


def save_model(bundle: ModelBundle, path: str) -> None:
    """Spark ML persistence + one-row JSON metadata (feature order,
    threshold, params, metrics, sizes)."""
    bundle.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    meta = dict(bundle.metadata)
    meta.update({"threshold": bundle.threshold, "feature_names": list(FEATURE_NAMES)})
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "metadata string") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str, threshold: float | None = None) -> ModelBundle:
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/model")
    row = spark.read.json(f"{path}/metadata").first()
    meta = json.loads(row["metadata"]) if row else {}
    thr = threshold if threshold is not None else meta.get("threshold", DEFAULT_THRESHOLD)
    return ModelBundle(model, float(thr), meta)


def model_info(bundle: ModelBundle, path: str = "") -> DataFrame:
    """One row: path, feature count, threshold, metadata JSON."""
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(
        [(path, len(FEATURE_NAMES), float(bundle.threshold), json.dumps(bundle.metadata, sort_keys=True))],
        "model_path string, n_features int, threshold double, metadata string")


def score_with_levels(bundle: ModelBundle, features_df: DataFrame) -> DataFrame:
    """P1-P3 on feature rows."""
    s = score(bundle.model, features_df)
    return s.withColumn("is_fraud_pred", P.decide("fraud_score", bundle.threshold)) \
            .withColumn("risk_level", P.risk_level("fraud_score")) \
            .withColumn("threshold", F.lit(float(bundle.threshold)))


def score_raw(bundle: ModelBundle, raw_requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6 -> B1 -> P1-P3. Returns (scored accepted rows, rejected rows)."""
    from txnscope.operators.point import build_point_features
    from txnscope.sources.validate import validate
    ok, bad = validate(raw_requests, "raw")
    feats = build_point_features(ok)
    s = score_with_levels(bundle, feats)
    return s.select("transaction_id", "is_fraud_pred", "fraud_score", "risk_level", "threshold"), bad


def score_detailed(bundle: ModelBundle, features_df: DataFrame, top_n: int = 5) -> DataFrame:
    """P1-P3 plus top contributions (model importances) and reason
    codes."""
    imp = importance_map(bundle.model)
    s = score_with_levels(bundle, features_df)
    return s.select("transaction_id", "is_fraud_pred", "fraud_score", "risk_level", "threshold",
                    P.top_contributions(s, imp, top_n).alias("top_features"),
                    P.reason_codes(s).alias("reason_codes"))


def train_and_evaluate(features_df: DataFrame, test_size: float = 0.2, validation_share: float = 0.1,
                   strategy: str = "class_weight", params: dict | None = None, tune_trials: int = 0,
                   k: int = 5, threshold_metric: str = "f1", path: str | None = None,
                   seed: int = 42, cross_validation: bool = True) -> dict:
    """Time split -> validation block from the end of train ->
    cross-validation -> tune or train (resampling in training rows only) ->
    evaluate at 0.5 -> pick the threshold on the validation block (the
    reference picks it on test; pass ``validation_share=0`` for that) ->
    evaluate -> importance, attribution -> save, with the parameters used
    and the balance strategy."""
    from txnscope.operators.splits import resample, time_split
    sp = time_split(features_df, test_size, position=False).persist()
    train_part = sp.filter(F.col("split") == "train").drop("split")
    test = sp.filter(F.col("split") == "test").drop("split")
    if validation_share > 0:
        vs = time_split(train_part, validation_share, position=False)
        fit_rows = vs.filter(F.col("split") == "train").drop("split")
        val = vs.filter(F.col("split") == "test").drop("split")
    else:
        fit_rows, val = train_part, test
    weighted = strategy == "class_weight"
    if tune_trials:
        model, trials = tune(fit_rows, tune_trials, k, seed=seed, strategy=strategy)
        best_row = top_trials(trials, 1).first()
        used = json.loads(best_row["params"])
    else:
        model, trials = train(resample(fit_rows, strategy, seed), params, weighted=weighted), None
        used = {**DEFAULT_PARAMS, **(params or {})}
    cv = None
    if cross_validation:
        cv = cv_summary(cross_validate(fit_rows, k, used, resample_fn=lambda t: resample(t, strategy, seed), weighted=weighted))
    sweep = K.threshold_sweep(score(model, val))
    best = K.best_threshold(sweep, threshold_metric).first()
    thr = float(best["threshold"]) if best else DEFAULT_THRESHOLD
    scored_test = score(model, test)
    at_half = evaluate(scored_test, DEFAULT_THRESHOLD)
    at_best = evaluate(scored_test, thr)
    sizes = K.split_summary(sp).collect()  # two rows
    meta = {"best_params": used, "balance_strategy": strategy, "threshold_metric": threshold_metric, "metrics_at_0_5": at_half, "metrics_at_best": at_best,
            "splits": {r["split"]: {"n": r["n"], "fraud_rate": r["fraud_rate"]} for r in sizes}}
    bundle = ModelBundle(model, thr, meta)
    if path:
        save_model(bundle, path)
    sp.unpersist()
    return {"bundle": bundle, "trials": trials, "cross_validation": cv, "sweep": sweep, "importance": feature_importance(model),
            "attribution": attribution_importance(model, test), "test_scores": scored_test}
