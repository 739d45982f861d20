"""Connected components of an edge table, by alternating large-star and
small-star steps (each one aggregation and one join over the edges).

Edges stay distributed: a node with many edges only meets its minimum in a
partial aggregation and in a join whose large side Spark may split. Every
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: every node links its larger
    neighbours to the smallest of itself and its neighbours. Small star:
    every node links its smaller neighbours and itself to the smallest."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(low, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.filter("u > m").select("u", F.col("m").alias("v")))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its
    smallest node. Self links and null ends are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = written(e, "edges")
    state = _state(e)
    while True:
        big = written(_star(e, True), "edges")
        drop_written(e)
        e = written(_star(big, False), "edges")
        drop_written(big)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)
