"""Canonical transaction views over the supplied test tables.

The reference reads one transactions file. Here every operator takes a
DataFrame with the raw transaction columns; these readers derive that view
from the given parquet tables so that all work scales with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscope.schema import FRAUD_PATTERNS


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """``events`` -> raw transactions (the main view ``txn``).

    Derivation rules (fixed, shared with the SQL twin):
    id 'T' + 9-digit event id; user 'u' + user; amount round(value*100, 2);
    receiver 'r' + props.k; device changes every 13th event id, location every
    11th; label = event_type 'error'; pattern by event id mod 5 on fraud rows;
    a deterministic score ((event_id*7919) mod 1000)/1000 for metric checks.
    """
    eid = F.col("event_id")
    patterns = F.array(*[F.lit(p) for p in FRAUD_PATTERNS])
    dev_alt = (eid % 13) == 0
    loc_alt = (eid % 11) == 0
    fraud = F.col("event_type") == F.lit("error")
    return events.select(
        F.concat(F.lit("T"), F.lpad(eid.cast("string"), 9, "0")).alias("transaction_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.round(F.col("value") * F.lit(100.0), 2).alias("amount"),
        F.concat(F.lit("r"), F.get_json_object("props", "$.k")).alias("receiver"),
        F.when(dev_alt, F.lit("d_alt"))
         .otherwise(F.concat(F.lit("d_"), F.col("user_id").cast("string"))).alias("device_id"),
        F.when(loc_alt, F.lit("l_alt"))
         .otherwise(F.concat(F.lit("l_"), (F.col("user_id") % 10).cast("string"))).alias("location"),
        dev_alt.alias("device_changed"),
        loc_alt.alias("location_changed"),
        fraud.alias("is_fraud"),
        F.when(fraud, F.element_at(patterns, (eid % 5 + 1).cast("int"))).alias("fraud_pattern"),
        ((eid * 7919) % 1000).cast("double").__truediv__(F.lit(1000.0)).alias("fraud_score"),
    )


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """``orders`` -> transactions: the tie fixture (many equal customer-day
    timestamps). Receiver is the order priority; no change flags."""
    return orders.select(
        F.concat(F.lit("O"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("transaction_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("receiver"),
        F.lit("d_0").alias("device_id"),
        F.lit("l_0").alias("location"),
        F.lit(False).alias("device_changed"),
        F.lit(False).alias("location_changed"),
        (F.col("o_orderstatus") == F.lit("F")).alias("is_fraud"),
        F.lit(None).cast("string").alias("fraud_pattern"),
    )


def transactions_from_lineitem(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """``lineitem`` joined to ``orders``: the wide scale fixture.

    The sender is the order's customer, the receiver the supplier, time the
    ship date. This is a shuffle join on the order key (both sides grow with
    the data, so nothing is broadcast).
    """
    o = orders.select("o_orderkey", "o_custkey")
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_extendedprice", "l_discount", "l_shipdate",
                         "l_returnflag")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        # (order, line) repeats in the test tables; with part and supplier
        # it is a key
        F.concat(F.lit("L"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"),
                 F.lit("_"), F.col("l_linenumber").cast("string"),
                 F.lit("_"), F.col("l_partkey").cast("string"),
                 F.lit("_"), F.col("l_suppkey").cast("string")).alias("transaction_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        # cents by floor(x*100 + 0.5)/100: plain IEEE arithmetic, so every
        # engine lands on the same value (round() differs at half-cents)
        (F.floor(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * F.lit(100.0)
                 + F.lit(0.5)).cast("double") / F.lit(100.0)).alias("amount"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("receiver"),
        F.lit("d_0").alias("device_id"),
        F.lit("l_0").alias("location"),
        F.lit(False).alias("device_changed"),
        F.lit(False).alias("location_changed"),
        (F.col("l_returnflag") == F.lit("R")).alias("is_fraud"),
        F.lit(None).cast("string").alias("fraud_pattern"),
    )


def with_score_fixture(txn: DataFrame) -> DataFrame:
    """Ensure a ``fraud_score`` column exists (events view already has one)."""
    if "fraud_score" in txn.columns:
        return txn
    h = F.abs(F.xxhash64("transaction_id")) % 1000
    return txn.withColumn("fraud_score", h.cast("double") / F.lit(1000.0))


def txn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(load_table(spark, sf_dir, "events"))


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_orders(load_table(spark, sf_dir, "orders"))


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_lineitem(load_table(spark, sf_dir, "lineitem"),
                                      load_table(spark, sf_dir, "orders"))
