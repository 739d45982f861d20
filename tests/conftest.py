import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from txnscope.session import build_session
    s = build_session("local[4]", app="txnscope-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="txnscope-test-ckpt-")})
    yield s
    s.stop()


def make_txn(spark, rows):
    """rows: (id, user, 'YYYY-mm-dd HH:MM:SS[.ffffff]', amount, receiver, dev, loc, fraud)."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(
        rows, "transaction_id string, user_id string, ts string, amount double, receiver string, "
              "device_changed boolean, location_changed boolean, is_fraud boolean")
    return (df.withColumn("timestamp", F.to_timestamp("ts")).drop("ts")
              .withColumn("device_id", F.lit("d")).withColumn("location", F.lit("l"))
              .withColumn("fraud_pattern", F.lit(None).cast("string")))
