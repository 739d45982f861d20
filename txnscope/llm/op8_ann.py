"""Approximate nearest neighbours by largest inner product: a permutation
index with pivot inverted files.

A vector is represented by its ``PREFIX`` nearest pivots in order. For each
pivot, an inverted file posts the vectors that have it, with its place. A
query adds up, over the files of its own ``PROBES`` nearest pivots, the footrule
distance of the orders (a pivot missing from a prefix counts as standing behind
it). The
``RERANK`` share of a block with the smallest distance (``RERANK_LEAST``
vectors at least) is then ranked by the exact inner product in double
precision.

Largest inner product becomes nearest neighbour by one added coordinate,
``sqrt(M^2 - |x|^2)`` with M the largest norm (0 for queries). Pivots are a
bounded sample (``PIVOTS`` vectors with the smallest hash); every vector is
indexed.

Equal vectors are one entry that holds its smallest ids, so a vector that a
third of all rows share is searched and returned once and its ties are exact.
Vectors are indexed in blocks of about ``BLOCK`` and queries searched in
blocks of ``QUERIES``; each pair of blocks is one unit of work of bounded
size, and each query takes ``k + 1`` hits at most from a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.llm.common import written

PIVOTS = 256
PREFIX = 64
PROBES = 32
RERANK = 0.25
RERANK_LEAST = 250
BLOCK = 8192
QUERIES = 1024


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) that take part, and their dimension. Left out: null
    ids; vectors that are null, empty, zero, or hold null or non-finite
    components; and vectors of another dimension than the most common one
    (the smaller, if two are equally common)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .filter(finite & F.exists(v, lambda x: x != 0)))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dim = top["d"] if top else 0
    return rows.filter(F.size("v") == dim), dim


def matrix(values) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in values]) if len(values) else np.empty((0, 0))


def prefixes(sims: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row, nearest first (ties: smaller number)."""
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


class BlockIndex:
    """The pivot inverted files of one block of vectors."""

    def __init__(self, vecs: np.ndarray, pivots: np.ndarray, extra: np.ndarray, norm2: float, k: int):
        self.vecs, self.k = vecs, k
        added = np.sqrt(np.maximum(norm2 - (vecs * vecs).sum(axis=1), 0))
        order = prefixes(vecs @ pivots.T + added[:, None] * extra[None, :], k)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // k).astype(np.int32)
        self.places = (by % k).astype(np.int32)
        self.ends = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def search(self, query: np.ndarray, order: np.ndarray, n_rerank: int) -> np.ndarray:
        """The rows to rerank."""
        n = len(self.vecs)
        if n <= n_rerank:
            return np.arange(n)
        saved = np.zeros(n, np.int32)  # footrule distance, less than that of disjoint prefixes
        k = self.k
        for place, pivot in enumerate(order):
            lo, hi = self.ends[pivot], self.ends[pivot + 1]
            at = self.places[lo:hi]
            # apart: (k - place) + (k - at); shared: |place - at|
            saved[self.rows[lo:hi]] += 2 * k - place - at - np.abs(place - at)
        return np.argpartition(-saved, n_rerank - 1)[:n_rerank]


def best(score: np.ndarray, first_id: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((first_id, -score))[:n]


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           n_pivots: int = PIVOTS, prefix: int = PREFIX, probes: int = PROBES, rerank: float = RERANK, rerank_least: int = RERANK_LEAST,
           block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible
    by ``every`` the ``k`` nearest other rows found, nearest first, ties to
    the smaller id. Rows that repeat both id and vector count once. An empty
    table, or one without a valid vector, gives no rows."""
    spark = vectors.sparkSession
    rows, dim = valid_vectors(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = written(rows.distinct(), "vectors")
    # equal vectors: one entry with its k + 1 smallest ids (one may be the query's own)
    nth = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
               .withColumn("entry", F.element_at("ids", 1)))
    entries = written(entries.withColumn("h", F.xxhash64(F.lit(8), "entry", "v")), "entries")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    norm2 = float(size["m"])
    pivots = matrix([r["v"] for r in entries.orderBy("h", "entry").select("v").limit(n_pivots).collect()])  # bounded sample
    extra = np.sqrt(np.maximum(norm2 - (pivots * pivots).sum(axis=1), 0))
    kp = min(prefix, len(pivots))

    asked = rows.filter(F.col("vec_id") % every == 0)
    # one searched query per distinct vector
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("query")).withColumn("h", F.xxhash64(F.lit(5), "query", "v"))
    n_blocks = max(1, math.ceil(size["n"] / block))
    n_asked = rows.filter(F.col("vec_id") % every == 0).select("v").distinct().count()
    n_queries = max(1, math.ceil(n_asked / query_block))

    packed = (entries.withColumn("b", F.pmod("h", F.lit(n_blocks))).groupBy("b").agg(
        F.collect_list(F.struct("v", "ids")).alias("rows"))  # about BLOCK rows by hash
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))))
    asked_blocks = queries.withColumn("c", F.pmod("h", F.lit(n_queries))).groupBy("c").agg(
        F.collect_list(F.struct("query", "v")).alias("asked"))
    work = packed.join(asked_blocks.withColumn("c", F.col("c").cast("int")), "c").repartition(
        min(4096, n_blocks * n_queries), "b", "c")

    def run(batches):
        for pdf in batches:
            for members, asked_rows in zip(pdf["rows"], pdf["asked"], strict=True):
                vecs = matrix([m["v"] for m in members])
                ids = [[int(i) for i in m["ids"]] for m in members]
                first = np.array([i[0] for i in ids])
                index = BlockIndex(vecs, pivots, extra, norm2, kp)
                q = matrix([a["v"] for a in asked_rows])
                orders = prefixes(q @ pivots.T, min(probes, kp))
                n_rerank = min(len(vecs), max(rerank_least, math.ceil(rerank * len(vecs))))
                out = []
                for a, query, order in zip(asked_rows, q, orders, strict=True):
                    near = index.search(query, order, n_rerank)
                    score = (vecs[near] * query).sum(axis=1)
                    top = best(score, first[near], k + 1)
                    hits = sorted((-score[t], i) for t in top for i in ids[near[t]])[:k + 1]
                    out += [(int(a["query"]), i, -s) for s, i in hits]
                yield pd.DataFrame(out, columns=["query", "vec_id", "score"])

    hits = work.select("rows", "asked").mapInPandas(run, "query long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    whose = asked.join(queries.select("v", "query"), "v").select("query", F.col("vec_id").alias("query_id"))
    listed = whose.join(near, "query").select(
        "query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return listed.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
