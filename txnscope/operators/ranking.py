"""Global order statistics without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. The
helpers here compute exclusive prefix sums ("sum of v over rows with a
smaller key") in two levels:

1. cut the key range into at most ``n_bins`` bins of about equal row count,
   using approximate quantiles of the key (a bounded list of edges);
2. per-bin totals -> running totals over the bins (a table of at most
   ``n_bins`` rows, so a one-partition window and a broadcast are bounded);
3. within-bin running sums with a window partitioned by bin.

Equal keys always share a bin, so peers see the same prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_TASK = 4


def default_bins(df: DataFrame) -> int:
    """Bins follow the job's parallelism: a few for each shuffle task."""
    return max(64, BINS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_edges(df: DataFrame, key: str, n_bins: int | None = None) -> list:
    """At most ``n_bins - 1`` distinct inner cut points of ``key``.

    The result is a short list (bounded by ``n_bins``), the only thing that
    reaches the driver.
    """
    n_bins = n_bins or default_bins(df)
    probs = [i / n_bins for i in range(1, n_bins)]
    row = df.agg(F.percentile_approx(F.col(key), probs, 10 * max(n_bins, 1000)).alias("q")).first()
    qs = row["q"] if row and row["q"] is not None else []
    out = []
    for q in qs:
        if q is not None and (not out or q > out[-1]):
            out.append(q)
    return out


def add_bins(df: DataFrame, key: str, edges: list, out: str = "_bin") -> DataFrame:
    """Bin id = number of edges <= key (keys equal to an edge go right),
    by binary search in the JVM (``Bucketizer``); NULL keys get their own
    last bin."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer
    # infinite keys belong to the end bins; edges that meet as doubles are one
    inner = sorted({float(e) for e in edges} - {float("-inf"), float("inf")} - {e for e in map(float, edges) if e != e})
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf")] + inner + [float("inf")]
    tmp = f"{out}_key"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, F.col(key).cast("double")))
             .withColumn(out, F.col(out).cast("int")).drop(tmp))


def exclusive_prefix(df: DataFrame, key: str, values: list[str],
                     n_bins: int | None = None, tiebreak: list[str] | None = None,
                     prefix: str = "before_", by: list[str] | None = None) -> DataFrame:
    """Add ``before_<v>`` = sum of ``v`` over rows ordered strictly before.

    Order is ``key`` then ``tiebreak`` columns (if given). Without a
    tiebreak, rows with equal keys are peers and are all excluded. With
    ``by``, prefixes restart per group (the bin table then has one row per
    group and bin and is joined by a shuffle instead of a broadcast).
    """
    by = list(by or [])
    edges = quantile_edges(df, key, n_bins)
    b = add_bins(df, key, edges)
    tot = b.groupBy(*by, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wb = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*by, "_bin", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0))
                                      .alias(f"_c_{v}") for v in values])
    if not by:
        # at most n_bins rows: a one-partition window and a broadcast are bounded
        carry = F.broadcast(carry)
    order = [F.col(key)] + [F.col(c) for c in (tiebreak or [])]
    w = Window.partitionBy(*by, "_bin").orderBy(*order)
    if tiebreak:
        frame = w.rowsBetween(Window.unboundedPreceding, -1)
        inner = [F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_i_{v}") for v in values]
    else:
        frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inner = [(F.sum(v).over(frame) - F.sum(v).over(
            Window.partitionBy(*by, "_bin", key))).alias(f"_i_{v}") for v in values]
    out = b.select("*", *inner).join(carry, by + ["_bin"])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_c_{v}") + F.coalesce(F.col(f"_i_{v}"), F.lit(0))).alias(f"{prefix}{v}")
          for v in values])


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number",
                      n_parts: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (all columns ascending;
    the columns must form a key).

    ``repartitionByRange`` splits on the whole composite key (sampled
    bounds), so even one first-key value holding a third of the rows is
    spread over tasks by the later keys. Inside each sorted partition,
    ``monotonically_increasing_id`` carries (partition index, position);
    the stamped rows are checkpointed into the shared checkpoint folder
    first, so the per-partition counts and the rows read the same data
    (adaptive execution may otherwise read a shuffle map-side under a
    broadcast join, which changes partition indices). The per-partition
    offset table is bounded by the partition count and broadcast.
    """
    from txnscope.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(n_parts or spark.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << 33) - 1
    cols = [F.col(c).asc() for c in order]
    s = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_part", F.shiftright("_mid", 33))
           .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(mask))))
    s = s.checkpoint(eager=True)
    cnt = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    wp = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a one-partition window and a broadcast are bounded
    off = cnt.select("_part", F.coalesce(F.sum("_c").over(wp), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(off), "_part")
             .withColumn(name, F.col("_off") + F.col("_loc") + F.lit(1))
             .drop("_mid", "_part", "_loc", "_off"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float],
                    by: list[str] | None = None, n_bins: int | None = None,
                    few_groups: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles (``quantile_cont`` / pandas
    ``quantile``) of ``value`` per group, without collecting a group.

    Values are first reduced to (group, value, count); the rank of each
    distinct value comes from ``exclusive_prefix``; the rows that hold the
    two ranks around ``(n-1)*p`` are picked by a filter and interpolated.
    Output: ``by`` columns, ``p``, ``q``.
    """
    by = list(by or [])
    d = (df.filter(F.col(value).isNotNull())
           .groupBy(*by, F.col(value).cast("double").alias("_v"))
           .agg(F.count(F.lit(1)).alias("_c")))
    ranked = exclusive_prefix(d, "_v", ["_c"], n_bins, prefix="_before", by=by)
    n = d.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ps = df.sparkSession.createDataFrame([(float(p),) for p in probs], "p double")
    # one row per group and p; few p values
    targets = (n.crossJoin(F.broadcast(ps))
                .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
                .withColumn("_lo", F.floor("_h"))
                .withColumn("_hi", F.ceil("_h")))
    # few groups (e.g. two classes): the target table is tiny, broadcast it;
    # many groups: a shuffle join (AQE splits a hot group's partition).
    if not by:
        cand = ranked.crossJoin(F.broadcast(targets))
    elif few_groups:
        cand = ranked.join(F.broadcast(targets), by)
    else:
        cand = ranked.join(targets, by)
    lo_hit = (F.col("_before_c") <= F.col("_lo")) & (F.col("_lo") < F.col("_before_c") + F.col("_c"))
    hi_hit = (F.col("_before_c") <= F.col("_hi")) & (F.col("_hi") < F.col("_before_c") + F.col("_c"))
    picked = (cand.filter(lo_hit | hi_hit)
                  .groupBy(*by, "p")
                  .agg(F.max(F.when(lo_hit, F.col("_v"))).alias("_vlo"),
                       F.max(F.when(hi_hit, F.col("_v"))).alias("_vhi"),
                       F.first("_h").alias("_h"), F.first("_lo").alias("_lo")))
    frac = F.col("_h") - F.col("_lo").cast("double")
    between = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac
    return picked.select(*by, "p", F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(between).alias("q"))


def with_reached(df: DataFrame, key: str, cuts: str, most: int, out: str) -> DataFrame:
    """Column ``out``: how many of the ascending array ``cuts`` (at most ``most``
    entries; NULL: none) are <= ``key``. A binary search of one projection per
    step: array functions with a lambda are interpreted for every entry, these
    steps are compiled."""
    df, step = df.withColumn(out, F.lit(0)), 1 << max(most, 1).bit_length() - 1
    while step:
        cut = F.get(F.col(cuts), F.col(out) + F.lit(step - 1))  # NULL beyond the end
        df = df.withColumn(out, F.when(cut <= F.col(key), F.col(out) + F.lit(step)).otherwise(F.col(out)))
        step >>= 1
    return df


#: Sampled keys for each bin of a selection.
SAMPLE = 32


def select_keys(df: DataFrame, order: list[str], ranks, by: list[str] | None = None, n_bins: int | None = None) -> DataFrame:
    """The keys at given 1-based ranks in ``order`` (ascending; the columns
    must form a key), per group of ``by``: columns ``by``, ``rank``, ``key``
    (a struct of ``order``). ``ranks`` maps the column of a group's number of
    rows to an array of ranks; ranks outside of 1 to n have no row.

    A distributed selection instead of a sort: the quantiles of a bounded,
    deterministic sample cut the keys into bins, the bins are counted, and only
    the bins that hold a wanted rank are sorted, each in a task of its own and
    about an ``n_bins``-th of the rows. Only key columns are read; no job runs
    while the plan is built. Groups must be few (classes).
    """
    by = list(by or [])
    n_bins = int(n_bins or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*by, F.struct(*order).alias("key"))
    groups = by or [F.lit(0).alias("_g")]
    sample = keys.orderBy(F.xxhash64(*by, "key"), *by, "key").limit(SAMPLE * n_bins)
    cuts = sample.groupBy(*groups).agg(F.array_sort(F.collect_list("key")).alias("_all"))
    every = F.expr(f"sequence(1, size(_all), {SAMPLE})")
    cuts = cuts.select(*(by or ["_g"]), F.transform(every, lambda i: F.element_at("_all", i.cast("int"))).alias("_cuts"))
    # at most n_bins cuts in all
    cuts = cuts.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by or ["_g"])})
    same = F.lit(True)  # without groups: one row
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    binned = keys.join(F.broadcast(cuts), same, "left")  # a small group may have no cut
    binned = with_reached(binned, "key", "_cuts", n_bins, "_bin").select(*by, "key", "_bin")
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)  # one row per bin
    before = F.coalesce(F.sum("_c").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = (counts.withColumn("_before", before).withColumn("_n", F.sum("_c").over(group))
              .withColumn("_ranks", ranks(F.col("_n"))).withColumn("rank", F.explode("_ranks")).withColumn("rank", F.col("rank").cast("long"))
              .filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_c"))))
    hit = wanted.groupBy(*by, "_bin").agg(F.collect_set(F.struct("rank", "_before")).alias("_w"))
    names = [*by, "_bin"]
    hit = hit.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(names)], "_w")
    cond = F.lit(True)
    for i, c in enumerate(names):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_h{i}"))
    near = binned.join(F.broadcast(hit), cond)  # a row per rank at most
    near = near.withColumn("_i", F.row_number().over(Window.partitionBy(*names).orderBy("key")))
    return (near.withColumn("_x", F.explode("_w")).filter(F.col("_i") == F.col("_x.rank") - F.col("_x._before"))
            .select(*by, F.col("_x.rank").alias("rank"), "key"))
