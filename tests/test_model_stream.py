"""Model on a planted signal, attribution additivity, stream = batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_MID, make_txn
from txnscope.operators import metrics as K
from txnscope.operators import model as M
from txnscope.operators.features import engineer_features, select_features
from txnscope.plans.checked import snap_doubles
from txnscope.schema import TRANSACTION_SCHEMA
from txnscope.sources.tables import txn_view
from txnscope.streaming.features import run_feature_stream, write_in_time_order
from txnscope.session import checkpoint_dir

QUICK = {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def signal(spark):
    """is_fraud planted from amount, night and velocity (a few % positive)."""
    f = select_features(engineer_features(txn_view(spark, SF_MID)))
    y = ((F.col("amount_very_large") == 1) & (F.col("is_night") == 1)) | (F.col("tx_count_1h") >= 2)
    return f.withColumn("is_fraud", y).persist()


def test_planted_signal_is_learned(spark, signal):
    rate = signal.agg(F.avg(F.col("is_fraud").cast("double"))).first()[0]
    assert 0.005 < rate < 0.05
    sp = signal.withColumn("_h", F.xxhash64("transaction_id") % 5)
    tr, te = sp.filter("_h != 0").drop("_h"), sp.filter("_h = 0").drop("_h")
    model = M.train(tr, QUICK)
    auc = K.roc_auc(M.score(model, te)).first()["roc_auc"]
    assert auc > 0.95


def test_attributions_add_up_to_margin(spark, signal):
    model = M.train(signal, QUICK)
    rows = signal.limit(50)
    contrib = M.attributions(model, rows).groupBy("transaction_id").agg(F.sum("contribution").alias("s"))
    raw = model.transform(M._prep(rows)).select("transaction_id",
                                                vector_to_array("rawPrediction")[1].alias("m"))
    j = contrib.join(raw, "transaction_id").toPandas()
    # Spark's GBT raw prediction for class 1 is the margin
    assert len(j) == 50
    assert np.allclose(j["s"], j["m"], atol=1e-9)


def test_shapley_values_equal_the_sum_over_all_subsets(spark, signal):
    """Against the definition: every subset of the features on a tree, unknown
    features following the training rows; small trees, all features at once."""
    import itertools
    import math
    model = M.train(signal, {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5})
    nodes, weights = M.tree_tables(model)
    names = M.FEATURE_NAMES
    rows = M._prep(signal.orderBy("transaction_id").limit(12)).select(*names).toPandas().astype(float).to_numpy()

    def value(t, node, x, known):
        n = t.loc[node]
        if n.leftChild < 0:
            return n.prediction
        left, right = int(n.leftChild), int(n.rightChild)
        if n.featureIndex in known:
            return value(t, left if x[int(n.featureIndex)] <= n.thr[0] else right, x, known)
        return (t.loc[left].rows * value(t, left, x, known) + t.loc[right].rows * value(t, right, x, known)) / n.rows

    got, base = M.shapley_values(M.leaves(nodes, weights), rows)
    want, want_base = np.zeros_like(rows), 0.0
    for tree, table in nodes.groupby("treeID"):
        t = table.set_index("id")
        used = sorted({int(f) for f, c in zip(t.featureIndex, t.leftChild) if c >= 0})
        assert len(used) > 2
        want_base += weights[tree] * value(t, 0, rows[0], ())
        for r, x in enumerate(rows):
            of = {s: value(t, 0, x, s) for k in range(len(used) + 1) for s in itertools.combinations(used, k)}
            for i in used:
                rest = [f for f in used if f != i]
                for k in range(len(rest) + 1):
                    w = math.factorial(k) * math.factorial(len(used) - 1 - k) / math.factorial(len(used))
                    for s in itertools.combinations(rest, k):
                        want[r, i] += weights[tree] * w * (of[tuple(sorted((*s, i)))] - of[s])
    assert np.allclose(got, want, atol=1e-12) and abs(base - want_base) < 1e-12


def test_shapley_values_come_from_tables_of_patterns(monkeypatch):
    """Batches look their values up; paths of many features, which have no
    table, give the same values by their patterns."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 12))
    trees = [M.Leaf(0.7, np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0))]
    for m in (1, 3, 6, 8, 10):
        low = np.where(rng.random(m) < 0.5, -np.inf, -0.5)
        trees.append(M.Leaf(rng.normal(), np.sort(rng.choice(12, m, replace=False)), low, low + np.where(np.isinf(low), 0, 1.2) + (low == -np.inf), rng.random(m)))
        trees[-1].high[np.isinf(trees[-1].high)] = 0.4
    want, base = np.zeros(x.shape), 0.0
    for leaf in trees:
        base += leaf.value * np.prod(leaf.share)
        v = x[:, leaf.features]
        if len(leaf.features):
            want[:, leaf.features] += leaf.value * M.leaf_shapley(leaf.share, (v > leaf.low) & (v <= leaf.high))
    tables = M.pattern_tables(trees)
    assert [t is None for t in tables] == [True, False, False, False, False, True]
    calls, real = [], M.leaf_shapley
    monkeypatch.setattr(M, "leaf_shapley", lambda *a: calls.append(1) or real(*a))
    got, got_base = M.shapley_values(trees, x, tables)
    assert len(calls) == 1 and np.allclose(got, want, atol=1e-12) and abs(base - got_base) < 1e-12


def test_forest_keeps_the_rows_nodes(spark, signal):
    """Without walking the trees again; they are the same trees."""
    rf = M.train_random_forest(signal, num_trees=5, max_depth=4).stages[-1]
    assert rf.getCacheNodeIds()
    data = M._label(M._prep(signal))
    again = M.RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=5, maxDepth=4, seed=42).fit(M.assembler().transform(data))
    assert rf.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]


def test_the_best_trial_is_fitted_on_the_rows_of_the_folds(spark, monkeypatch):
    """The last fit reads what the search has persisted, all rows of it."""
    df = txn_view(spark, SF_MID).select("transaction_id", "timestamp", "is_fraud")
    used = []
    monkeypatch.setattr(M, "train", lambda rows, *a, **k: used.append(
        (rows._jdf.queryExecution().executedPlan().toString(), rows.columns, rows.count())))
    monkeypatch.setattr(M, "score", lambda model, rows: rows)
    monkeypatch.setattr(M, "evaluate", lambda rows, **k: {"f1": 0.5})
    M.tune(df, n_iter=1, k=2, grid={"maxIter": [2]})
    plan, columns, n = used[-1]
    assert len(used) == 3 and "InMemoryTableScan" in plan
    assert columns == df.columns and n == df.count()


def test_importance_tables(spark, signal):
    model = M.train(signal, QUICK)
    imp = M.feature_importance(model, spark)
    assert imp.count() == 43
    cat = M.importance_by_category(imp).collect()
    assert len(cat) == 7 and abs(sum(r["share"] for r in cat) - 1.0) < 1e-9


def test_save_load_roundtrip(spark, signal):
    model = M.train(signal, {"maxIter": 3, "maxDepth": 2})
    path = f"{checkpoint_dir(spark)}/model-test"
    M.save_model(M.ModelBundle(model, 0.75, {"note": "t"}), path)
    back = M.load_model(path)
    assert back.threshold == 0.75 and back.metadata["note"] == "t"
    a = M.score(model, signal.limit(20)).select("fraud_score").collect()
    b = M.score(back.model, signal.limit(20)).select("fraud_score").collect()
    assert a == b


def _raw(spark):
    return txn_view(spark, SF_SMALL).select(*[f.name for f in TRANSACTION_SCHEMA])


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _checked(feats):
    return snap_doubles(select_features(feats).drop("timestamp"))


@pytest.mark.parametrize("chunk_days,files,per_trigger", [(3, 1, 3), (60, 4, 1)])
def test_stream_equals_batch(spark, chunk_days, files, per_trigger):
    """In time order, and as one chunk of four files in no order."""
    src = f"{checkpoint_dir(spark)}/stream-src-{files}"
    write_in_time_order(_raw(spark), src, chunk_days, files)
    feats, late = run_feature_stream(spark, src, f"{checkpoint_dir(spark)}/stream-out-{files}", per_trigger)
    assert late.count() == 0
    assert _same(_checked(feats), _checked(engineer_features(txn_view(spark, SF_SMALL))))


def test_stream_goes_on_after_a_restart(spark):
    """Two runs over a growing folder, the second with older rows too: those
    behind the watermark are late, all others as if seen at once."""
    src, out = f"{checkpoint_dir(spark)}/grow-src", f"{checkpoint_dir(spark)}/grow-out"
    raw = _raw(spark)
    cut = F.to_timestamp(F.lit("2024-01-16"))
    raw.filter(F.col("timestamp") < cut).repartition(2).write.parquet(f"{src}/chunk=1")
    run_feature_stream(spark, src, out, 2, delay="3 days", close=False)
    again = raw.filter("timestamp < timestamp'2024-01-02'")  # repeated long after
    raw.filter(F.col("timestamp") >= cut).unionByName(again).repartition(2).write.parquet(f"{src}/chunk=2")
    feats, late = run_feature_stream(spark, src, out, 2, delay="32 days")
    assert sorted(r[0] for r in late.select("transaction_id").collect()) == sorted(r[0] for r in again.select("transaction_id").collect())
    assert _same(_checked(feats), _checked(engineer_features(txn_view(spark, SF_SMALL))))


def test_only_rows_behind_the_watermark_are_late(spark):
    def row(i, user, at, amount, receiver="r"):
        return (i, user, at, amount, receiver, False, False, False)
    src, out = f"{checkpoint_dir(spark)}/late-src", f"{checkpoint_dir(spark)}/late-out"
    files = [
        [row("c", "u", "2024-01-01 12:00:00", 3.0), row("n", None, "2024-01-01 12:00:00", None)],
        [row("a", "u", "2024-01-01 11:00:00", 1.0), row("b2", "u", "2024-01-01 11:30:00", None), row("b1", "u", "2024-01-01 11:30:00", 2.0)],
        [row("d", "u", "2024-01-01 13:30:00.000001", 1e15, "s")],
        [row("e", "u", "2024-01-01 12:30:00", 0.1, None), row("x", "u", "2024-01-01 12:29:59.999", 9.0), row("z", "u", None, 1.0)],
    ]
    for n, rows in enumerate(files):
        make_txn(spark, rows).select(*[f.name for f in TRANSACTION_SCHEMA]).coalesce(1).write.parquet(f"{src}/chunk={n}")
    feats, late = run_feature_stream(spark, src, out, 1, delay="1 hour")
    assert {r[0] for r in late.select("transaction_id").collect()} == {"x", "z"}
    rows = [r for f in files for r in f if r[0] not in ("x", "z")]
    assert _same(_checked(feats), _checked(engineer_features(make_txn(spark, rows))))


def test_profile_stream_equals_batch_and_survives_retries(spark):
    from txnscope.operators.point import user_profile
    from txnscope.streaming.features import compact_profile, read_profile, run_profile_stream
    src, out = f"{checkpoint_dir(spark)}/profile-src", f"{checkpoint_dir(spark)}/profile-out"
    raw = _raw(spark)
    write_in_time_order(raw.filter("timestamp < timestamp'2024-01-20'"), src, 7)
    run_profile_stream(spark, src, out)
    first = compact_profile(spark, out)
    assert _same(snap_doubles(read_profile(spark, out)), snap_doubles(user_profile(raw.filter("timestamp < timestamp'2024-01-20'"))))
    raw.filter("timestamp >= timestamp'2024-01-20'").write.parquet(f"{src}/chunk=99")
    run_profile_stream(spark, src, out)
    want = snap_doubles(user_profile(raw))
    assert _same(snap_doubles(read_profile(spark, out)), want)
    # a batch that is tried again writes the same folder, a compaction the same snapshot
    last = spark.read.parquet(f"{out}/changes").agg(F.max("batch_id")).first()[0]
    batch = spark.createDataFrame(spark.read.parquet(f"{out}/changes/batch_id={last}").collect(), spark.read.parquet(f"{out}/changes/batch_id={last}").schema)
    batch.write.mode("overwrite").parquet(f"{out}/changes/batch_id={last}")
    assert compact_profile(spark, out) == compact_profile(spark, out) == last > first
    assert _same(snap_doubles(read_profile(spark, out)), want)


class _State:
    """Value, list and map state in memory, and the timers of one key."""

    def __init__(self):
        self.value, self.timers = None, set()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _List(_State):
    def get(self):
        return iter(self.value or [])

    def appendValue(self, value):
        self.value = [*(self.value or []), value]


class _Map(_State):
    def containsKey(self, key):
        return key in (self.value or {})

    def getValue(self, key):
        return self.value[key]

    def updateValue(self, key, value):
        self.value = {**(self.value or {}), key: value}


class _Handle:
    def __init__(self):
        self.timers = set()
        self.getValueState, self.getListState, self.getMapState = (lambda *_: _State()), (lambda *_: _List()), (lambda *_: _Map())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _stream_group(batches, columns):
    """One group's output over micro-batches of (rows, watermark in ms)."""
    from txnscope.streaming.features import UserFeatures
    p = UserFeatures(columns)
    p.init(handle := _Handle())
    out = []
    for rows, ms in batches:
        if len(rows):
            out += list(p.handleInputRows((0,), iter([rows]), _Watermark(ms)))
        for due in sorted(t for t in handle.timers if t <= ms):
            handle.timers.discard(due)
            out += list(p.handleExpiredTimer((0,), _Watermark(ms), None))
    return pd.concat(out, ignore_index=True).sort_values("transaction_id", ignore_index=True)


def test_stream_group_keeps_its_users_apart():
    """State is held by groups of users: a group that is released in steps
    gives what each of its users gives alone and at once."""
    from decimal import Decimal
    rng = np.random.default_rng(5)
    n, hour = 600, 3600 * 10**6
    us = 10**15 + np.sort(rng.integers(0, 400, n)) * (hour // 4)  # many equal times
    amount = np.round(rng.uniform(-5, 900, n), 2)
    amount[rng.random(n) < 0.1] = np.nan
    pick = lambda names: rng.choice(np.array(names, object), n)
    rows = pd.DataFrame({"transaction_id": [f"t{i:04d}" for i in rng.permutation(n)], "user_id": pick([None, *[f"u{i}" for i in range(25)]]),
                         "receiver": pick([None, "r1", "r2", "r3", "r4"]), "event_us": us, "event_amount": amount,
                         "event_units": [None if v != v else Decimal(str(v)).quantize(Decimal(1).scaleb(-12)) for v in amount]})
    pair = rows.user_id.fillna("-") + rows.receiver.fillna("-")
    rows["event_bucket"] = [sum(map(ord, v)) % 3 for v in pair]
    columns, end = ["transaction_id", "user_id", "receiver"], int(us.max()) // 1000 + 1
    cuts = [0, 150, 160, 400, n]
    steps = [(rows[a:b], int(us[a]) // 1000) for a, b in zip(cuts, cuts[1:])] + [(rows[:0], end)]
    got = _stream_group(steps, columns)
    alone = [_stream_group([(part, 0), (part[:0], end)], columns) for _, part in rows.groupby("user_id", dropna=False)]
    want = pd.concat(alone, ignore_index=True).sort_values("transaction_id", ignore_index=True)
    assert len(got) == n and not got["late"].any()
    pd.testing.assert_frame_equal(got, want[got.columns], check_exact=True)
    # running numbers and receivers against a plain loop
    seen, paid = {}, {}
    by_id = got.set_index("transaction_id")
    for r in rows.sort_values(["event_us", "transaction_id"]).itertuples():
        user = r.user_id or "-"
        seen[user] = seen.get(user, 0) + 1
        assert by_id.at[r.transaction_id, "user_tx_number"] == seen[user]
        assert by_id.at[r.transaction_id, "receiver_tx_count"] == paid.get((user, r.receiver), 0)
        paid[user, r.receiver] = paid.get((user, r.receiver), 0) + 1


def test_the_trials_query_runs_the_whole_search(spark, monkeypatch):
    """30 trials of the full grid in 5 folds, then the best one on all rows."""
    from txnscope.operators.splits import time_series_folds
    from txnscope.plans import q_model
    rows = spark.range(240).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), (F.col("id") % 7 == 0).alias("is_fraud"))
    used = []
    monkeypatch.setattr(q_model, "_split", lambda *_: (rows, rows))
    monkeypatch.setattr(M, "train", lambda df, params, **k: used.append((params, df)))
    monkeypatch.setattr(M, "score", lambda model, df: df)
    monkeypatch.setattr(M, "evaluate", lambda df, **k: {"f1": 0.5})
    got = q_model.m4(spark, "none").collect()
    draws = M.sample_params(30, 42)
    assert len(used) == 30 * 5 + 1 and len(got) == 5
    assert all(sum(p == d for p, _ in used[:-1]) == 5 for d in draws)
    assert used[-1][1].count() == 240
    sizes = {df.count() for _, df in used[:10]}
    folds = time_series_folds(rows, 5, position=False)
    assert sizes == {folds.filter(F.col("test_fold").isNull() | (F.col("test_fold") < i)).count() for i in range(5)}


def test_a_searchs_fits_run_at_a_time(spark, monkeypatch):
    """Several at once; the trials are listed in their order."""
    import threading
    df = spark.range(60).select(
        F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds("id").alias("timestamp"), (F.col("id") % 7 == 0).alias("is_fraud"))
    two = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(M, "train", lambda rows, params, **k: params["maxIter"])
    monkeypatch.setattr(M, "score", lambda model, rows: model)

    def evaluate(m, **k):
        two.wait()
        return {"f1": m / 10}
    monkeypatch.setattr(M, "evaluate", evaluate)
    best, trials = M.tune(df, n_iter=3, k=2, grid={"maxIter": [2, 3, 4]})
    draws = M.sample_params(3, 42, {"maxIter": [2, 3, 4]})
    rows = trials.orderBy("trial").collect()
    assert [r["mean_score"] for r in rows] == [d["maxIter"] / 10 for d in draws] and best == 4


def test_leaves_are_looked_up_in_groups():
    """One lookup for several leaves of a tree, by the bounds that a row passes."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.integers(0, 5, (400, 6)).astype(float), [[np.inf, -np.inf, 0, 1, 2, 3], [np.nan] * 6]])
    inf, trees = np.inf, []
    for _ in range(20):  # two features cut twice: 4 x 2 leaves in a path
        f = np.sort(rng.choice(6, 3, replace=False))
        cuts = np.sort(rng.choice(4, (3, 2)) + 0.5, axis=1)
        for i in range(3):
            low, high = [-inf, cuts[0][0], cuts[0][1]][i], [cuts[0][0], cuts[0][1], inf][i]
            for j in range(2):
                trees.append(M.Leaf(rng.normal(), f, np.array([low, [-inf, cuts[1][0]][j], -inf]),
                                    np.array([high, [cuts[1][0], inf][j], cuts[2][1]]), rng.random(3)))
    want = np.zeros(x.shape)
    for leaf in trees:
        v = x[:, leaf.features]
        want[:, leaf.features] += leaf.value * M.leaf_shapley(leaf.share, ((v > leaf.low) | (leaf.low == -np.inf)) & (v <= leaf.high))
    grouped = M.grouped_tables(trees, M.pattern_tables(trees))
    assert len(grouped.groups) <= len(trees) // 4 and not grouped.rest
    assert all(g.values.shape[1] <= M.GROUP_STATES for g in grouped.groups)
    got, _ = M.shapley_values(trees, x, grouped)
    assert np.allclose(got, want, atol=1e-12)


def test_importances_are_compared_after_two_fits_at_a_time(spark, monkeypatch):
    import threading
    from txnscope.plans import q_model
    both = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(q_model, "_features", lambda *_: "features")
    monkeypatch.setattr(q_model, "_model", lambda *_: both.wait() * 0 + 1)
    monkeypatch.setattr(M, "train_random_forest", lambda f, num_trees, max_depth: both.wait() * 0 + num_trees)
    monkeypatch.setattr(M, "feature_importance", lambda m, s: s.createDataFrame(
        [(f"f{i}", float(m * i)) for i in range(12)], "feature string, importance double"))
    rows = q_model.m9(spark, "none").collect()
    assert [tuple(r) for r in rows] == [(f"f{i}", float(i), 100.0 * i) for i in range(11, 1, -1)]
