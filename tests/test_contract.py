"""Driver contract and SQL twins on the smallest tables."""

import importlib.util
import os

import pytest

from conftest import ROOT, SF_SMALL
from oracle import compare, duck


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_and_registry(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0 and "tx_count_1h" in df.columns
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 70 and len(sql) >= 50


SQL_SAMPLE = ["f1_all_features", "v_velocity_orders_ties_30d", "k3_roc_auc", "k4_average_precision",
              "k6_threshold_sweep", "n12_label_correlations", "n13_class_comparison", "p5_top_contributions",
              "p7_batch_score", "q4_detect_mule", "q6_pattern_summary", "s4_adapt_transactions",
              "x_declared_columns", "l1_time_split", "b2_user_profile"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", SQL_SAMPLE)
def test_sql_twin(spark, con, name):
    from txnscope.plans.catalog import load_all
    res, _s, _d = compare(spark, load_all()[name], SF_SMALL, con)
    assert res["hash_equal"], res
