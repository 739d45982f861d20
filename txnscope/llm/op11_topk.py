"""Exact top-k search by integer inner product: three phases with a uniform
threshold.

The components are split into ``SLICES`` ranges. A slice's table holds one
part of every vector, and what it gives a query, the *local score*, is that
part's inner product; a candidate's score is the sum of its local scores.

1. Every slice gathers its ``k + 1`` best local scores for each query. The
   candidates named there are scored in full, and the (k+1)-th best of these
   scores is a safe cutoff: the true list ends no lower. (One more than k, as
   the query's own row is among the candidates.)
2. The cutoff is broadcast. Whoever reaches it in the sum of m slices reaches
   an m-th of it in one of them, so each slice collects its entries at or
   above that uniform threshold; no other can be in the result.
3. The local scores that a collected entry still lacks are looked up in the
   other slices' tables, and the sums are ranked.

No step drops a candidate that could be in the result, whatever the signs of
the components, so the lists are exact, ties included.

Equal vectors are one entry with its ``k + 1`` smallest ids, so a vector that
a third of all rows share is scored once. Queries are searched in passes of at
most ``PASS_NUMBERS`` components, which bounds what is broadcast (8 MB) and
what a task holds; the slices' tables are only scanned, never moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnscope.llm.blocks import in_blocks
from txnscope.llm.common import drop_written, written

SLICES = 2
PASS_NUMBERS = 1 << 20
CELLS = 1 << 21  # scores held at once by a task
EXACT = float(1 << 53)  # integers below this are exact as doubles
SCHEMA = "query_id long, rank int, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """The rows (vec_id, v) that may take part, one for each id, written, and
    the most common dimension."""
    v = F.col("v")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
            .select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")))
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "integers")
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows, top["d"] if top else 0


class Queries:
    """One pass of queries: their keys, ascending, and each slice's parts."""

    def __init__(self, keys: list[int], whole: np.ndarray, bounds: list[tuple[int, int]]):
        self.keys = np.array(keys, np.int64)
        self.parts = [np.ascontiguousarray(whole[:, lo:hi]) for lo, hi in bounds]

    def at(self, keys: pa.Array) -> np.ndarray:
        return np.searchsorted(self.keys, keys.to_numpy())


def numbers(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def products(queries: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Inner products of all queries with all parts, exact in 64 bits."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(part.astype(float)).max(initial=0))
    if most * part.shape[1] < EXACT:
        return (queries.astype(float) @ part.astype(float).T).astype(np.int64)
    return queries @ part.T


def tiles(queries: np.ndarray, part: np.ndarray):
    """(first query, scores) for some queries at a time."""
    step = max(1, CELLS // max(1, len(part)))
    for lo in range(0, len(queries), step):
        yield lo, products(queries[lo:lo + step], part)


def table_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def by_slice(batch: pa.RecordBatch):
    """(slice, entries, parts) of a batch of the slices' table."""
    which, entry = batch.column("slice").to_numpy(), batch.column("entry").to_numpy()
    for j in np.unique(which):
        at = np.flatnonzero(which == j)
        yield int(j), entry[at], numbers(batch.column("part").take(pa.array(at)), len(at))


def best_of(score: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest scores of each row and their entries."""
    if score.shape[1] > n:
        at = np.argpartition(score, score.shape[1] - n, axis=1)[:, -n:]
        return np.take_along_axis(score, at, 1), np.take_along_axis(entry, at, 1)
    return score, entry


def local_lists(shared, n: int):
    """Phase 1 in one task: each slice's n best local scores of each query."""
    def run(batches):
        queries, best = shared.value, {}
        for batch in batches:
            for j, entry, part in by_slice(batch):
                if j not in best:
                    shape = len(queries.keys), n
                    best[j] = np.full(shape, np.iinfo(np.int64).min), np.full(shape, -1, np.int64)
                for lo, score in tiles(queries.parts[j], part):
                    rows = slice(lo, lo + len(score))
                    s, e = best_of(score, np.broadcast_to(entry, score.shape), n)
                    s, e = np.concatenate([best[j][0][rows], s], 1), np.concatenate([best[j][1][rows], e], 1)
                    best[j][0][rows], best[j][1][rows] = best_of(s, e, n)
        for j, (s, e) in best.items():
            q, at = np.nonzero(e >= 0)
            yield table_of(query=queries.keys[q], slice=np.full(len(q), j, np.int32), entry=e[q, at], score=s[q, at])
    return run


def full_scores(shared):
    """(query, entry, v, n): the score in full."""
    def run(batches):
        whole = np.concatenate(shared.value.parts, axis=1)
        for batch in batches:
            if len(batch):
                v = numbers(batch.column("v"), len(batch))
                score = (whole[shared.value.at(batch.column("query"))] * v).sum(axis=1)
                yield table_of(query=batch.column("query"), entry=batch.column("entry"), n=batch.column("n"), score=score)
    return run


def above(shared, limit):
    """Phase 2 in one task: local scores at or above the uniform threshold."""
    def run(batches):
        queries = shared.value
        for batch in batches:
            for j, entry, part in by_slice(batch):
                for lo, score in tiles(queries.parts[j], part):
                    q, e = np.nonzero(score >= limit.value[lo:lo + len(score), None])
                    yield table_of(query=queries.keys[q + lo], slice=np.full(len(q), j, np.int32), entry=entry[e], score=score[q, e])
    return run


def lacking(shared):
    """Phase 3 in one task: the local score of (query, entry, slice, part)."""
    def run(batches):
        queries = shared.value
        for batch in batches:
            q, which = queries.at(batch.column("query")), batch.column("slice").to_numpy()
            score = np.empty(len(batch), np.int64)
            for j in np.unique(which):
                at = np.flatnonzero(which == j)
                part = numbers(batch.column("part").take(pa.array(at)), len(at))
                score[at] = (queries.parts[j][q[at]] * part).sum(axis=1)
            yield table_of(query=batch.column("query"), slice=batch.column("slice"), entry=batch.column("entry"), score=score)
    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding", n_slices: int = SLICES, pass_numbers: int = PASS_NUMBERS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible
    by ``every`` the ``k`` rows with the largest inner product of
    ``floor(scale * x)``, all if there are fewer, ties to the smaller id.

    Left out: null ids; vectors that are null, empty, or hold null or
    non-finite components; vectors of another dimension than the most common
    one (the smaller, if two are equally common). Rows that repeat an id count
    once, with the smallest of their vectors (component by component). Scores
    must fit in 64 bits. An empty table, or one without a valid vector, gives
    no rows. Other columns are ignored. The jobs of all passes run on call.
    """
    spark = vectors.sparkSession
    integers, dim = integer_vectors(vectors, scale, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    rows = integers.filter(F.size("v") == dim)
    m = min(n_slices, dim)
    nth = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
               .withColumn("entry", F.monotonically_increasing_id()))
    entries = written(entries, "entries")
    bounds = [(j * dim // m, (j + 1) * dim // m) for j in range(m)]
    parts = written(entries.select("entry", F.explode(F.array(*[
        F.struct(F.lit(j).alias("slice"), F.slice("v", lo + 1, hi - lo).alias("part")) for j, (lo, hi) in enumerate(bounds)])).alias("p"))
        .select("entry", "p.slice", "p.part"), "slices")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    # equal query vectors are searched once
    queries, n_passes = in_blocks(asked.select("v").distinct().withColumn("query", F.monotonically_increasing_id()),
                                  ["v"], F.lit(dim), pass_numbers, "queries")
    out = None
    for p in range(n_passes):
        found = one_pass(spark, entries, parts, asked, queries.filter(F.col("_block") == p).select("query", "v"), bounds, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    for t in (integers, entries, parts, queries):
        drop_written(t)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def one_pass(spark: SparkSession, entries: DataFrame, parts: DataFrame, asked: DataFrame, queries: DataFrame,
             bounds: list[tuple[int, int]], k: int) -> DataFrame | None:
    """The lists of one pass of queries (bounded, see ``in_blocks``), written."""
    m = len(bounds)
    mine = queries.orderBy("query").collect()
    if not mine:
        return None
    shared = spark.sparkContext.broadcast(Queries([r["query"] for r in mine], np.array([r["v"] for r in mine], np.int64), bounds))
    local = "query long, slice int, entry long, score long"

    # 1. the best of each slice, scored in full: at most (k + 1) * m rows a query
    order = Window.partitionBy("query", "slice").orderBy(F.desc("score"), "entry")
    lists = (parts.mapInArrow(local_lists(shared, k + 1), local)
             .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1))
    known = (entries.join(F.broadcast(lists.select("query", "entry").distinct()), "entry")
             .select("query", "entry", "v", F.size("ids").alias("n"))
             .mapInArrow(full_scores(shared), "query long, entry long, n int, score long"))
    # entries hold several rows: the cutoff is the score of the (k+1)-th row
    upto = Window.partitionBy("query").orderBy(F.desc("score"), "entry").rowsBetween(Window.unboundedPreceding, 0)
    cutoff = dict(known.withColumn("_upto", F.sum("n").over(upto)).filter(F.col("_upto") >= k + 1)
                  .groupBy("query").agg(F.max("score")).collect())
    least = [cutoff.get(r["query"]) for r in mine]
    limit = spark.sparkContext.broadcast(np.array([np.iinfo(np.int64).min if c is None else -(-c // m) for c in least], np.int64))

    # 2. all at or above the uniform threshold in some slice
    hits = written(parts.mapInArrow(above(shared, limit), local), "hits")
    seen = hits.groupBy("query", "entry").agg(F.bit_or(F.expr("shiftleft(1, slice)")).alias("seen"))

    # 3. what these lack
    missing = (seen.filter(F.col("seen") != (1 << m) - 1).join(parts, "entry").filter(F.expr("(seen & shiftleft(1, slice)) = 0"))
               .select("query", "slice", "entry", "part").mapInArrow(lacking(shared), local))
    total = hits.unionByName(missing).groupBy("query", "entry").agg(F.sum("score").alias("score"))
    cuts = spark.createDataFrame(list(cutoff.items()), "query long, cut long")
    total = total.join(F.broadcast(cuts), "query", "left").filter(F.col("cut").isNull() | (F.col("score") >= F.col("cut")))
    ranked = total.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = (ranked.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= k + 1)
            .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")))
    listed = (asked.join(F.broadcast(queries), "v").select("query", "query_id").join(F.broadcast(near), "query")
              .select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near")))
    out = written(listed.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "near")
    drop_written(hits)
    return out
