"""Sharding by bytes: global byte-size prefix sums cut at equal targets.

Rows are sorted by range partitioning on (id, checksum, size); each
partition's totals give its start in the global byte order; a window inside
the partition gives each row's own start. Shard ``k`` takes the rows whose
start lies in ``[k/n, (k+1)/n)`` of all bytes, so shards are contiguous in
that order and differ from the equal target by less than one document.

Only DataFrame functions run here. The text itself never moves: sizes and
checksums are computed where it is read. Nothing is collected; the only
one-task steps are a window over one row per range partition and a reduced
table of one row per shard and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.llm.common import n_partitions, written

POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes (size 1,
    checksum 0), like an empty one. Order: id (nulls first), then checksum,
    then size; rows equal in all three are interchangeable. Repeated ids and
    repeated rows stay separate rows. A document longer than a whole target
    may leave the following shard empty. An empty table gives no rows. Other
    columns of ``docs`` are ignored, whatever they are called.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size")]
    stamped = (narrow.repartitionByRange(n_partitions(spark), *order)
               .sortWithinPartitions(*order)
               .withColumn("_at", F.monotonically_increasing_id())
               .withColumn("_part", F.shiftright("_at", POSITION_BITS)))
    stamped = written(stamped, "shards")  # fixes the positions

    # one row per range partition
    totals = stamped.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select("_part",
                           F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
                           F.sum("_bytes").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = (stamped.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(F.broadcast(starts), "_part")
              .withColumn("_rank", F.col("_rows0") + F.col("_at").bitwiseAND((1 << POSITION_BITS) - 1))
              .withColumn("shard", F.expr(f"int(((_bytes0 + _in) * {int(n_shards)}) div _total)")))
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")))
