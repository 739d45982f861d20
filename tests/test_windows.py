"""Window features: tie and edge semantics, bucket-size invariance and a
brute-force check on a hot user."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_txn
from txnscope.operators.features import engineer_features
from txnscope.operators.windows import previous_values, time_window_features


def _by_id(df, cols):
    return {r["transaction_id"]: tuple(r[c] for c in cols) for r in df.select("transaction_id", *cols).collect()}


def test_ties_count_only_earlier_ids(spark):
    rows = [(i, "u1", "2024-01-01 10:00:00", 10.0, "r1", False, False, False) for i in ("a", "b", "c")]
    out = _by_id(time_window_features(make_txn(spark, rows)), ["tx_count_1h", "tx_amount_1h",
                                                                   "user_tx_number", "receiver_tx_count"])
    assert out == {"a": (0, 0.0, 1, 0), "b": (1, 10.0, 2, 1), "c": (2, 20.0, 3, 2)}


def test_window_edges_and_gap_minutes(spark):
    rows = [
        ("a", "u1", "2024-01-01 10:00:00", 1.0, "r", False, False, False),
        ("b", "u1", "2024-01-01 11:00:00", 2.0, "r", False, False, False),          # exactly 1 h: counted
        ("c", "u2", "2024-01-01 10:00:00", 1.0, "r", False, False, False),
        ("d", "u2", "2024-01-01 11:00:00.000001", 2.0, "r", False, False, False),   # 1 h + 1 us: not
        ("e", "u3", "2024-01-01 10:00:00", 1.0, "r", False, False, False),
        ("f", "u3", "2024-01-01 10:01:59", 1.0, "r", False, False, False),          # 119 s -> 1 min
        ("g", "u3", "2024-01-01 10:03:59", 1.0, "r", False, False, False),          # 120 s -> 2 min
    ]
    out = _by_id(time_window_features(make_txn(spark, rows)), ["tx_count_1h", "time_since_last_tx"])
    assert out["b"] == (1, 60.0)
    assert out["d"] == (0, 60.0)
    assert out["f"][1] == 1.0 and out["g"][1] == 2.0
    assert out["a"][1] == 0.0 and out["e"] == (0, 0.0)


def _brute(pdf, w_s):
    pdf = pdf.sort_values(["user_id", "timestamp", "transaction_id"]).reset_index(drop=True)
    res = {}
    for _, g in pdf.groupby("user_id"):
        ts = g["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        am = g["amount"].to_numpy()
        ids = g["transaction_id"].to_numpy()
        rec = g["receiver"].to_numpy()
        for i in range(len(g)):
            m = ts[:i] >= ts[i] - w_s * 1_000_000
            std = float(np.std(am[: i + 1], ddof=1)) if i > 0 else 0.0
            res[ids[i]] = (int(m.sum()), float(am[:i][m].sum()), i + 1, float(am[: i + 1].sum()),
                           std, int((rec[:i] == rec[i]).sum()))
    return res


def test_slices_do_not_matter_on_a_hot_user(spark):
    """One user holds most rows; the result must not depend on the
    slices that split the user's work, and must equal brute force."""
    rng = np.random.default_rng(7)
    n = 600
    base = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(n):
        user = "hot" if i % 5 else f"u{i % 7}"
        t = base + pd.Timedelta(seconds=int(rng.integers(0, 3 * 86400)))
        rows.append((f"T{i:05d}", user, str(t), float(rng.integers(1, 100000)) / 100.0,
                     f"r{rng.integers(0, 6)}", False, False, False))
    df = make_txn(spark, rows)
    cols = ["tx_count_24h", "tx_amount_24h", "user_tx_number", "user_total_amount",
            "user_std_amount", "receiver_tx_count"]
    want = _brute(df.toPandas(), 86400)
    for n in (1, 2, 8, 16, 60):
        got = _by_id(time_window_features(df, n_slices=n), cols)
        for k, v in want.items():
            g = got[k]
            assert g[0] == v[0] and g[2] == v[2] and g[5] == v[5], (n, k, g, v)
            assert abs(g[1] - v[1]) < 1e-6 and abs(g[3] - v[3]) < 1e-6, (n, k, g, v)
            assert abs(g[4] - v[4]) < 1e-6 * max(1.0, v[4]), (n, k, g, v)


@pytest.mark.parametrize("n_slices", [1, 9, 40])
def test_distinct_counts_match_brute_force(spark, n_slices):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    rows = [(f"T{i:04d}", f"u{i % 3}", str(base + pd.Timedelta(minutes=int(rng.integers(0, 600)))),
             1.0, f"r{rng.integers(0, 4)}", False, False, False) for i in range(300)]
    df = make_txn(spark, rows)
    got = _by_id(time_window_features(df, windows=[("w", 3600)], n_slices=n_slices, history=False,
                                      gap=False, receiver_col=None, distinct_of="receiver"),
                 ["distinct_receiver_w"])
    pdf = df.toPandas().sort_values(["user_id", "timestamp", "transaction_id"])
    for _, g in pdf.groupby("user_id"):
        ts = g["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        rec, ids = g["receiver"].to_numpy(), g["transaction_id"].to_numpy()
        for i in range(len(g)):
            m = ts[: i + 1] >= ts[i] - 3600 * 1_000_000
            assert got[ids[i]][0] == len(set(rec[: i + 1][m])), ids[i]


def test_previous_values_across_buckets(spark):
    rows = [("a", "u1", "2024-01-01 10:00:00", 1.0, "r1", False, False, False),
            ("b", "u1", "2024-01-03 10:00:00", 1.0, "r2", False, False, False),
            ("c", "u1", "2024-01-03 10:00:00", 1.0, "r3", False, False, False)]
    for bucket in (3600, 30 * 86400):
        out = _by_id(previous_values(make_txn(spark, rows), ["receiver"], bucket), ["prev_receiver"])
        assert out == {"a": (None,), "b": ("r1",), "c": ("r2",)}


def test_feature_properties(spark):
    from tests_support import txn_small
    f = engineer_features(txn_small(spark))
    bad = f.filter(
        (F.col("amount_very_small") + F.col("amount_small") + F.col("amount_medium")
         + F.col("amount_large") + F.col("amount_very_large") != 1)
        | ((F.col("is_new_receiver") == 1) != (F.col("receiver_tx_count") == 0))
        | (F.col("tx_count_1h") > F.col("tx_count_24h"))
        | (F.col("device_and_location_changed") > F.col("device_or_location_changed")))
    assert bad.count() == 0


def test_one_row_exchange_plan(spark):
    """Only one exchange moves the full rows: the REPARTITION_BY_COL one."""
    from tests_support import txn_small
    plan = engineer_features(txn_small(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1


def test_feature_names_are_stable():
    from txnscope.operators.features import feature_names
    a, b = feature_names(), feature_names()
    assert a == b and len(a) == 43 and len(set(a)) == 43
    a.append("x")
    assert len(feature_names()) == 43  # a fresh list per call


def test_carry_scans_read_only_needed_columns(spark):
    """Column pruning reaches parquet: only the row scan reads every
    column; the carry scans read a subset."""
    from tests_support import txn_small
    w = time_window_features(txn_small(spark))
    plan = w._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert len(schemas) >= 2
    assert any("event_type" not in s for s in schemas)


def test_prior_only_history_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2024-01-01")
    rows = [(f"T{i:04d}", "hot" if i % 4 else "cold", str(base + pd.Timedelta(minutes=int(rng.integers(0, 5000)))),
             float(rng.integers(100, 90000)) / 100.0, "r", False, False, False) for i in range(400)]
    df = make_txn(spark, rows)
    pdf = df.toPandas().sort_values(["user_id", "timestamp", "transaction_id"])
    want = {}
    for _, g in pdf.groupby("user_id"):
        am, ids = g["amount"].to_numpy(), g["transaction_id"].to_numpy()
        for i in range(len(g)):
            prev = am[:i]
            want[ids[i]] = (i, float(prev.sum()), float(prev.mean()) if i else 0.0,
                            float(np.std(prev, ddof=1)) if i > 1 else 0.0)
    cols = ["prior_tx_count", "prior_total_amount", "prior_avg_amount", "prior_std_amount"]
    for n in (1, 12):
        got = _by_id(time_window_features(df, windows=[], n_slices=n, history=False, gap=False,
                                          receiver_col=None, prior_history=True), cols)
        for k, v in want.items():
            g = got[k]
            assert g[0] == v[0] and abs(g[1] - v[1]) < 1e-6 and abs(g[2] - v[2]) < 1e-6, (k, g, v)
            assert abs(g[3] - v[3]) < 1e-6 * max(1.0, v[3]), (k, g, v)


def test_column_pruned_selections(spark):
    """Selecting a few columns prunes most of the plan; it must still run
    (a pruning regression)."""
    from tests_support import txn_small
    t = txn_small(spark)
    for n in (1, 60):
        w = time_window_features(t, n_slices=n)
        assert w.select("transaction_id").count() == 1000
        assert w.select("amount", "tx_count_1h").count() == 1000
    assert engineer_features(t).select("hour").count() == 1000


def test_sums_of_mixed_magnitudes_are_exact(spark):
    """A large amount that enters and leaves a window leaves nothing."""
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")
    values = [0.1, 9_999_999.99, 0.2, 0.3, 1e15, 1e-6, 123.456789]
    rows = [(f"T{i:04d}", f"u{i % 2}", str(base + pd.Timedelta(minutes=int(rng.integers(0, 3000)))),
             values[int(rng.integers(0, len(values)))], "r", False, False, False) for i in range(400)]
    df = make_txn(spark, rows)
    got = _by_id(time_window_features(df, history=False, receiver_col=None), ["tx_count_1h", "tx_amount_1h", "tx_count_24h", "tx_amount_24h"])
    pdf = df.toPandas().sort_values(["user_id", "timestamp", "transaction_id"])
    empty = 0
    for _, g in pdf.groupby("user_id"):
        ts = g["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        am, ids = [Fraction(repr(float(x))) for x in g["amount"]], g["transaction_id"].to_numpy()
        for i in range(len(g)):
            for k, w in ((0, 3600), (2, 86400)):
                live = [am[j] for j in range(i) if ts[j] >= ts[i] - w * 1_000_000]
                n, a = got[ids[i]][k:k + 2]
                assert n == len(live) and a == float(sum(live))
                empty += n == 0 and a == 0.0
    assert empty > 10


def test_numbers_that_are_none(spark):
    rows = [(f"t{i}", "u", f"2024-01-01 10:0{i}:00", a, "r", False, False, False)
            for i, a in enumerate([1.0, float("nan"), float("inf"), -float("inf"), 1e30, None, 2.0])]
    out = _by_id(time_window_features(make_txn(spark, rows)), ["tx_count_1h", "tx_amount_1h", "user_total_amount", "user_tx_number"])
    assert out["t6"] == (6, 1.0, 3.0, 7)


def test_one_user_of_one_day_is_spread_over_tasks(spark):
    """90 % of the rows belong to one user and one day."""
    df = spark.range(5000).selectExpr(
        "cast(id as string) as transaction_id", "if(id % 10 < 9, 'hot', concat('u', id)) as user_id",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (id * 7919) % 86400) as timestamp", "1.5D as amount", "'r' as receiver")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so few rows would else share one task
    try:
        out = time_window_features(df, n_slices=24).withColumn("p", F.spark_partition_id()).filter("user_id = 'hot'")
        per = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set(coalesce, "true")
    assert len(per) >= 5 and max(per) < 0.5 * 4500


def test_no_job_runs_while_the_plan_is_built(spark):
    from tests_support import txn_small
    t = txn_small(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    engineer_features(t)
    time_window_features(t, distinct_of="receiver")
    assert len(tracker.getJobIdsForGroup("plan-only")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_groups_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """The groups follow the rows' count, not only the shuffle partitions, and
    so do the slices of a busy user; the results are the same."""
    from txnscope.operators import windows as W
    rows = [(f"t{i:05d}", "hot" if i % 2 else f"u{i % 40}", f"2024-01-01 {i // 250 % 24:02d}:{i // 5 % 60:02d}:{i % 60:02d}", float(i % 97), f"r{i % 7}", False, False, False)
            for i in range(4000)]
    df = make_txn(spark, rows).persist()
    cols = ["tx_count_1h", "tx_amount_1h", "user_tx_number", "user_total_amount", "receiver_tx_count"]
    want = _by_id(time_window_features(df), cols)
    monkeypatch.setattr(W, "GROUP_ROWS", 100)
    assert _by_id(time_window_features(df), cols) == want
    keys = df.selectExpr("user_id AS u", "unix_micros(timestamp) AS us", "transaction_id AS id")
    assert W.group_count(keys, 8).first()["_w_g"] == 40
    assert len(sum(W.busy_cuts(keys, 8, W.group_count(keys, 8)).filter("_cu = 'hot'").first()["_cuts"], [])) >= 8
    df.unpersist()
