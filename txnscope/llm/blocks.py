"""Blocks of a bounded size, for what is broadcast pass by pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import written


def in_blocks(df: DataFrame, key: list[str], size: Column, bound: int, name: str) -> tuple[DataFrame, int]:
    """``df`` written once with a block number ``_block``, and the number of
    blocks. A block's sizes add up to ``bound`` at most, or it is a single
    key. Blocks are dealt by the hash of ``key`` (whose rows must be unique),
    in as many blocks as it takes."""
    rows = written(df.withColumn("_size", size.cast("long")).withColumn("_hash", F.xxhash64(*key)), name)
    total = rows.agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-2 * (total["s"] or 0) // bound)) if (total["s"] or 0) > bound else 1
    while blocks > 1:
        by = rows.groupBy(F.pmod("_hash", F.lit(blocks)).alias("b")).agg(
            F.sum("_size").alias("s"), F.count_distinct("_hash").alias("n"))
        if by.filter((F.col("s") > bound) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    return rows.withColumn("_block", F.pmod("_hash", F.lit(blocks))).drop("_hash"), blocks
