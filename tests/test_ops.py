"""Validation, adapter, splits, resampling, point features, detectors."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID, make_txn
from txnscope.operators import detect as Q
from txnscope.operators import splits as L
from txnscope.operators.point import build_point_features, enrich_with_profile, user_profile
from txnscope.sources.adapt import adapt_transactions
from txnscope.sources.tables import txn_view
from txnscope.sources.validate import complete_features, validate


def test_validate_rejects_nulls_and_ranges(spark):
    df = spark.createDataFrame(
        [("t1", "u1", 10.0, "2024-01-01 00:00:00", "r", "d"),
         ("t2", None, 10.0, "2024-01-01 00:00:00", "r", "d"),
         ("t3", "u1", None, "2024-01-01 00:00:00", None, "d"),
         ("t4", "u1", -100.0, "2024-01-01 00:00:00", "r", "d")],
        "transaction_id string, user_id string, amount double, timestamp string, receiver string, device_id string")
    ok, bad = validate(df, "raw")
    assert [r["transaction_id"] for r in ok.collect()] == ["t1"]
    errs = {r["transaction_id"]: r["errors"] for r in bad.collect()}
    assert errs["t2"] == ["user_id: required"]
    assert set(errs["t3"]) == {"amount: required", "receiver: required"}
    assert errs["t4"] == ["amount: must be > 0.0"]


def test_complete_features_fills_zero_and_reports(spark):
    df = spark.createDataFrame([("t", 3.0)], "transaction_id string, amount_raw double")
    out, filled = complete_features(df)
    assert len(out.columns) == 44 and len(filled) == 42
    with pytest.raises(ValueError):
        complete_features(df, strict=True)


def test_adapter_flags_first_row_changed(spark):
    df = spark.createDataFrame(
        [("a", "u", "2024-01-01 00:00:00", "m1", "phone", "KE"),
         ("b", "u", "2024-01-02 00:00:00", "m1", "phone", "UG"),
         ("c", "u", "2024-01-03 00:00:00", "m2", "web", "UG")],
        "transaction_id string, user_id string, transaction_date string, merchant string, "
        "device_type string, country string")
    out = {r["transaction_id"]: (r["device_changed"], r["location_changed"])
           for r in adapt_transactions(df).collect()}
    assert out == {"a": (True, True), "b": (False, True), "c": (True, False)}


def test_time_split_and_folds(spark):
    t = txn_view(spark, SF_MID)
    sp = L.time_split(t, 0.2)
    assert sp.filter("split = 'train'").count() == 8000
    # the same sizes when the split feeds an aggregate (plan shape differs)
    from txnscope.operators.metrics import split_summary
    assert {r["split"]: r["n"] for r in split_summary(sp).collect()} == {"train": 8000, "test": 2000}
    last_train = sp.filter("split = 'train'").agg(F.max("pos")).first()[0]
    first_test = sp.filter("split = 'test'").agg(F.min("pos")).first()[0]
    assert last_train + 1 == first_test
    f = L.time_series_folds(t, 5)
    sizes = {r["test_fold"]: r["n"] for r in f.groupBy("test_fold").agg(F.count("*").alias("n")).collect()}
    assert all(sizes[i] == 10000 // 6 for i in range(5))
    mx = {r["test_fold"]: (r["lo"], r["hi"]) for r in f.filter("test_fold IS NOT NULL").groupBy("test_fold")
          .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    for i in range(4):
        assert mx[i][1] < mx[i + 1][0]


def test_selected_keys_against_a_sort(spark):
    """Heavy ties, hot groups, ranks at both ends and outside."""
    from txnscope.operators.ranking import select_keys
    rng = np.random.default_rng(5)
    rows = [("x" if i % 10 else "y", int(rng.integers(0, 40)) if i % 3 else 7, f"k{int(rng.integers(0, 10**9)):09d}{i}") for i in range(3000)]
    rows += [(None, 1, "only")]
    df = spark.createDataFrame(rows, "g string, v long, id string")
    ranks = lambda n: F.array(F.lit(0), F.lit(1), F.floor(n * 0.5), F.lit(1500), n, n + 1)
    for n_bins in (1, 7, 300):
        got = {(r.g, r["rank"], r.key.v, r.key.id) for r in select_keys(df, ["v", "id"], ranks, ["g"], n_bins).collect()}
        want = set()
        for g in ("x", "y", None):
            keys = sorted((v, i) for a, v, i in rows if a == g)
            want |= {(g, k, *keys[k - 1]) for k in (1, len(keys) // 2, 1500, len(keys)) if 1 <= k <= len(keys)}
        assert got == want
        one = select_keys(df, ["v", "id"], lambda n: F.array(F.lit(2000)), n_bins=n_bins).collect()
        assert [tuple(r.key) for r in one] == [sorted((v, i) for _, v, i in rows)[1999]]


def test_cuts_are_searched_without_interpreted_lambdas(spark):
    """The rows' bins and folds come from compiled steps, and are exact for
    no, few and full cuts, equal and NULL keys."""
    from txnscope.operators.ranking import select_keys, with_reached
    keys = [None, -5, 0, 1, 1, 2, 7, 9, 10**6]
    for cuts, most in (([], 1), ([1], 1), ([0, 1, 7], 3), (list(range(8)), 8), ([0, 1, 1, 1, 9], 200)):
        rows = spark.createDataFrame([(k, cuts) for k in keys], "k long, c array<long>")
        rows = rows.select(F.struct("k").alias("key"), F.transform("c", lambda x: F.struct(x.alias("k"))).alias("cuts"))
        got = [(r.key.k, r.n) for r in with_reached(rows, "key", "cuts", most, "n").collect()]
        assert got == [(k, sum(k is not None and c <= k for c in cuts)) for k in keys]
    none = spark.createDataFrame([(1, None)], "k long, c array<long>")
    assert with_reached(none, "k", "c", 4, "n").first()["n"] == 0
    t = txn_view(spark, SF_MID)
    for df in (select_keys(t.select("timestamp", "transaction_id"), ["timestamp", "transaction_id"], lambda n: F.array(n)),
               L.time_series_folds(t, 5, position=False)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows = [line for line in plan.splitlines() if "filter(" in line and "lambdafunction" in line]
        assert not rows


def test_splits_move_no_rows_and_run_no_job(spark):
    t = txn_view(spark, SF_MID)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split-plan", "")
    made = [L.time_split(t, 0.2, position=False), L.time_series_folds(t, 5, position=False), L.stratified_split(t, 0.2, 7), L.undersample(t, 7)]
    assert len(tracker.getJobIdsForGroup("split-plan")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        chain = plan[:plan.index("FileScan")]  # from the result down to the scan of the rows
        assert "Join" in chain and "Exchange" not in chain and "Sort" not in chain and "Window" not in chain
    a = L.time_split(t, 0.2).select("transaction_id", "split")
    assert a.exceptAll(made[0].select("transaction_id", "split")).count() == 0
    small = L.time_series_folds(t.limit(4), 5, position=False)
    assert small.filter("test_fold is not null").count() == 0 and L.time_split(t.limit(1), 0.5, position=False).first()["split"] == "test"


def test_undersample_and_stratified(spark):
    t = txn_view(spark, SF_MID)
    u = L.undersample(t, 7)
    c = {r["is_fraud"]: r["n"] for r in u.groupBy("is_fraud").agg(F.count("*").alias("n")).collect()}
    assert c[True] == c[False] == t.filter("is_fraud").count()
    s = L.stratified_split(t, 0.2, 7)
    share = s.groupBy("is_fraud").agg(F.avg((F.col("split") == "test").cast("double")).alias("r")).collect()
    assert all(abs(r["r"] - 0.2) < 1e-3 for r in share)
    with pytest.raises(ValueError):
        L.resample(t, "bogus")


def test_point_features_defaults(spark):
    df = spark.createDataFrame([("t", "u", 600.0, "2024-01-06 23:30:00", "r", "d", True, False)],
                               "transaction_id string, user_id string, amount double, timestamp string, "
                               "receiver string, device_id string, device_changed boolean, location_changed boolean")
    r = build_point_features(df).first()
    assert r["user_total_amount"] == 500.0 and r["is_new_receiver"] == 1 and r["is_weekend"] == 1
    assert r["time_since_last_tx"] == 3600.0 and r["night_device_change"] == 1
    prof = user_profile(txn_view(spark, SF_MID))
    e = enrich_with_profile(df, prof).first()
    assert e["user_avg_amount"] == 500.0 and e["user_tx_number"] == 1  # unknown user -> defaults


def _scenario(spark):
    R = []
    # Q1: three night rows with both changes within an hour (+ a near miss: only two)
    for i, m in enumerate(["01:00:00", "01:10:00", "01:20:00"]):
        R.append((f"s{i}", "sim", f"2024-01-01 {m}", 9000.0, f"m{i}", True, True, True))
    R += [("n0", "sim2", "2024-01-01 01:00:00", 9000.0, "m", True, True, False),
          ("n1", "sim2", "2024-01-01 01:30:00", 9000.0, "m", True, True, False)]
    # Q2: eight medium rows in 45 min to many receivers (+ near miss: same receiver)
    for i in range(8):
        R.append((f"v{i}", "vel", f"2024-01-02 10:{i * 5:02d}:00", 2000.0, f"rv{i}", False, False, True))
        R.append((f"w{i}", "vel2", f"2024-01-02 10:{i * 5:02d}:00", 2000.0, "same", False, False, False))
    # Q3: huge amount to a new receiver (+ near miss: known receiver)
    R += [("x0", "big", "2024-01-03 10:00:00", 30000.0, "new", False, False, True),
          ("x1", "big2", "2024-01-03 09:00:00", 10.0, "old", False, False, False),
          ("x2", "big2", "2024-01-03 10:00:00", 30000.0, "old", False, False, False)]
    # Q4: mule receives from five senders then sends on 90 % (+ near miss: four senders)
    for i in range(5):
        R.append((f"in{i}", f"snd{i}", f"2024-01-04 0{i}:00:00", 1000.0, "mule", False, False, False))
        if i < 4:
            R.append((f"jn{i}", f"snd{i}", f"2024-01-04 0{i}:00:00", 1000.0, "mule2", False, False, False))
    R += [("out", "mule", "2024-01-04 10:00:00", 4500.0, "final", False, False, True),
          ("out2", "mule2", "2024-01-04 10:00:00", 3900.0, "final", False, False, False)]
    # Q5: night amount (+ near miss: hour 5)
    R += [("z0", "nite", "2024-01-05 03:00:00", 3500.0, "r", False, False, True),
          ("z1", "nite", "2024-01-05 05:00:00", 3500.0, "r", False, False, False)]
    return make_txn(spark, R)


def test_detectors_positive_and_near_miss(spark):
    df = _scenario(spark)
    ids = lambda d: {r["transaction_id"] for r in d.collect()}
    assert ids(Q.detect_sim_swap(df)) == {"s2"}
    assert ids(Q.detect_velocity_attack(df)) == {"v7"}
    assert ids(Q.detect_unusual_amount(df)) == {"x0"}
    assert ids(Q.detect_mule(df)) == {"out"}
    assert ids(Q.detect_night(df)) == {"z0"}
    summ = {r["detector"]: r["hits"] for r in Q.pattern_summary(df).collect()}
    assert summ == {"sim_swap": 1, "velocity_attack": 1, "unusual_amount": 1, "mule_account": 1,
                    "night_transaction": 1}


def test_global_row_number_with_a_heavy_timestamp(spark):
    """A third of the rows share one timestamp: ranks are still exact and
    the heavy value is spread over several range partitions."""
    from txnscope.operators.ranking import global_row_number
    rows = [(f"id{i:05d}", 1000 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "transaction_id string, ts long")
    r = global_row_number(df, ["ts", "transaction_id"], n_parts=8).toPandas()
    want = sorted(rows, key=lambda x: (x[1], x[0]))
    got = r.sort_values("row_number")
    assert list(got["transaction_id"]) == [w[0] for w in want]
    assert list(got["row_number"]) == list(range(1, 3001))
    heavy = df.filter("ts = 1000").repartitionByRange(8, "ts", "transaction_id")
    assert heavy.rdd.glom().map(len).filter(lambda k: k > 0).count() > 1


def test_numbers_that_are_none_are_null_on_reading(spark, tmp_path):
    from txnscope.sources.io import read_transactions
    head = "transaction_id,user_id,timestamp,amount,receiver,device_id,location,device_changed,location_changed,is_fraud,fraud_pattern"
    rows = [f"t{i},u,2024-01-01 10:00:00,{a},r,d,l,false,false,false," for i, a in enumerate(["NaN", "Infinity", "-Infinity", "12.5", "x"])]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]))
    got = {r.transaction_id: r.amount for r in read_transactions(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"t0": None, "t1": None, "t2": None, "t3": 12.5, "t4": None}


def test_requests_with_numbers_that_are_none_are_rejected(spark):
    from txnscope.sources.validate import FEATURE_REQUIRED, validate
    raw = spark.createDataFrame([("u", float("nan")), ("u", float("inf")), ("u", 5.0), ("u", None)], "user_id string, amount double")
    raw = raw.selectExpr("*", "now() as timestamp", "'r' as receiver", "'d' as device_id")
    ok, bad = validate(raw, "raw")
    assert [r.amount for r in ok.collect()] == [5.0] and bad.count() == 3
    good = {c: 1.0 for c in FEATURE_REQUIRED}
    cases = [good, good | {"hour_sin": float("nan")}, good | {"hour": 24.0}, good | {"amount": 2e7}, good | {"amount_sqrt": None}]
    df = spark.createDataFrame([tuple(c[f] for f in FEATURE_REQUIRED) for c in cases], ", ".join(f"{c} double" for c in FEATURE_REQUIRED))
    ok, bad = validate(df, "feature")
    assert ok.count() == 1 and sorted(r.errors[0] for r in bad.collect()) == [
        "amount: exceeds maximum allowed", "amount_sqrt: required", "hour: must be in [0, 23]", "hour_sin: must be a finite number"]
    assert validate(df.drop("day_cos"), "feature")[0].count() == 0


def test_quantiles_survive_infinite_values(spark):
    from txnscope.operators.ranking import exact_quantiles
    inf = float("inf")
    vals = [inf] * 40 + [-inf] * 30 + [float(i) for i in range(30)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.p: r.q for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], n_bins=16).collect()}
    assert got[0.1] == -inf and got[0.9] == inf and got[0.5] == 19.5


def test_feature_files_are_read_by_day(spark, tmp_path):
    from txnscope.operators.features import engineer_features
    from txnscope.sources.io import read_features, write_features
    from tests_support import txn_small
    path = str(tmp_path / "f")
    write_features(engineer_features(txn_small(spark)), path)
    df = read_features(spark, path)
    day = df.select("event_date").first()[0]
    plan = df.filter(F.col("event_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert df.count() == 1000


def test_files_of_a_day_follow_its_rows(spark, tmp_path):
    import glob
    from tests_support import txn_small
    from txnscope.operators.features import engineer_features
    from txnscope.sources.io import read_features, write_features
    f = engineer_features(txn_small(spark))
    busy = f.withColumn("timestamp", F.when(F.col("transaction_id") < "T000000600", F.to_timestamp(F.lit("2024-01-05"))).otherwise(F.col("timestamp")))
    path = str(tmp_path / "f")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so few rows would else share one task
    try:
        write_features(busy, path, file_rows=50)
    finally:
        spark.conf.set(coalesce, "true")
    files = {d.split("=")[1]: len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/event_date=*")}
    assert files.pop("2024-01-05") >= 5 and set(files.values()) == {1}
    assert read_features(spark, path).count() == f.count()


def test_feature_summary_against_pandas(spark):
    from txnscope.operators.explore import feature_summary
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(-3, 100)), float(rng.normal()) if i % 7 else None, float(rng.integers(0, 5)) + 1e7,
             [0.0, -0.0, float("nan"), 62.0, 63.0, 0.5][i % 6], None) for i in range(2000)]
    names = ["flag", "whole", "real", "far", "odd", "none"]
    df = spark.createDataFrame(rows, "flag int, whole long, real double, far double, odd double, none double").repartition(7)
    got = {r.feature: r for r in feature_summary(df, names).collect()}
    pdf = df.toPandas().astype(float)
    for c in ("flag", "whole", "real", "far"):
        x = pdf[c]
        assert got[c].n_unique == x.nunique() and got[c].missing == x.isna().sum()
        assert abs(got[c].mean - x.mean()) < 1e-9 * max(1, abs(x.mean())) and abs(got[c]["std"] - x.std()) < 1e-6
    assert got["odd"].n_unique == 5 and got["none"].n_unique == 0 and got["none"].missing == 2000 and got["none"].mean is None
    assert [(r.feature, r.n_unique, r.missing) for r in feature_summary(df.limit(0), ["flag"]).collect()] == [("flag", 0, 0)]


@pytest.mark.parametrize("kind,n_pivots,block", [("clusters", 12, 40), ("even", None, 2048), ("even", 5, 7)])
def test_neighbours_against_all_pairs(spark, kind, n_pivots, block):
    from txnscope.operators.neighbours import nearest_neighbours
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(1)
    if kind == "clusters":
        x += rng.integers(0, 6, size=(300, 1)) * 100.0
    x[:60] = x[0]  # many equal rows
    x[60, 0] = -0.0
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(4)
    near, share = nearest_neighbours(df, 5, n_pivots, block)
    got = {r.id: r.near for r in near.collect()}
    for i in range(300):
        d = ((x - x[i]) ** 2).sum(1)
        want = [f"r{j:04d}" for j in np.lexsort((np.arange(300), d)) if j != i][:5]
        assert got[f"r{i:04d}"] == want, i
    assert len(got) == 300 and (share < 0.35 if kind == "clusters" else share <= 1)
    few = nearest_neighbours(df.filter("id in ('r0061', 'r0062')"), 5)[0].collect()
    assert sorted((r.id, r.near) for r in few) == [("r0061", ["r0062"]), ("r0062", ["r0061"])]
    assert nearest_neighbours(df.limit(0), 5)[0].count() == 0


def test_neighbours_meet_in_blocks_and_rounds(spark, monkeypatch):
    """No cell has blocks of its own if it is small, and no round sends a row
    to more than ``ROUND`` blocks, however many cells there are."""
    from txnscope.operators import neighbours as N
    pivots = np.arange(40.0)[:, None]
    blocks, n = N.deal({c: 3 for c in range(39)} | {39: 95}, pivots, 30)
    assert n == 4 + 4 and blocks[39] == (4, 4)
    assert all(sum(b == (i, 1) for b in blocks.values()) <= 10 for i in range(4)) and len(blocks) == 40
    x = np.random.default_rng(5).normal(size=(400, 6))
    df = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    sent, real, made = [], N._round, []

    def rounds(base, r, rounds, *args):
        groups = real(base, r, rounds, *args)
        sent.append((r, rounds))
        made.append(groups.applyInPandas(lambda a, b: N.pd.DataFrame({"asked": [len(a)], "there": [len(b)]}), "asked long, there long").agg(
            F.sum("asked"), F.sum("there")).first())
        return groups
    monkeypatch.setattr(N, "_round", rounds)
    near, _ = N.nearest_neighbours(df, 5, 20, 25)
    assert near.count() == 400 and len(sent) == sent[0][1] >= 4
    assert all(a <= N.ROUND * 400 and t <= 2 * N.ROUND * 400 for a, t in made)  # blocks are half full at least, about


def test_smote_reaches_parity_between_neighbours(spark):
    from txnscope.operators.neighbours import nearest_neighbours
    rng = np.random.default_rng(8)
    rows = [(f"t{i:03d}", float(rng.normal()), int(rng.integers(0, 9)), i % 11 == 0 if i else None) for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b int, is_fraud boolean")
    out = L.resample(df, "smote", 5, features=["a", "b"])
    again = L.resample(df.repartition(7), "smote", 5, features=["a", "b"])
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    minority = {r[0]: (r[1], float(r[2])) for r in rows if r[3]}
    assert sum(bool(r.is_fraud) for r in got) == sum(not r.is_fraud for r in got) == 200 - len(minority)
    near = {r.id: r.near for r in nearest_neighbours(spark.createDataFrame([(i, list(v)) for i, v in minority.items()], "id string, v array<double>"), 5)[0].collect()}
    new = [r for r in got if "~" in r.transaction_id]
    per = {}
    for r in new:
        source = r.transaction_id.split("~")[0]
        per[source] = per.get(source, 0) + 1
        p, x = np.array(minority[source]), np.array([r.a, r.b])
        gaps = []
        for o in near[source]:
            q = np.array(minority[o])
            u = (x - p) @ (q - p) / max(((q - p) ** 2).sum(), 1e-300)
            gaps.append(np.abs(p + u * (q - p) - x).max() if -1e-12 <= u <= 1 else 9)
        assert min(gaps) < 1e-9
    assert set(per) == set(minority) and max(per.values()) - min(per.values()) <= 1
    one = df.filter("transaction_id in ('t001', 't002', 't011')")
    assert L.resample(one, "smote", features=["a", "b"]).count() == 3
