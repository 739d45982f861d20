"""Shared helpers: written tables, word splitting and hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscope.session import checkpoint_dir

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ONE = np.uint64(1)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, fixes row identities, and survives lost executors. ``clean``: the
    job's shuffle files go as soon as it has ended."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    if clean:
        with_cleanup(spark, lambda: df.write.parquet(path))
    else:
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_paths = [path]
    return out


def with_cleanup(spark: SparkSession, job) -> None:
    """Run ``job``; its shuffle files go as soon as it has ended, as nothing
    reads them again."""
    held = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        job()
    finally:
        spark.conf.set(CLEANUP, held)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it
    goes by the driver's garbage collection, which may be far off."""
    gc.collect()
    spark._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    for path in getattr(df, "_written_paths", []):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row identity; stable only once the result has been written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix): spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit xxhash, cached up to ``limit`` words and then
    emptied, so the cache's memory is bounded and its contents never change
    a result."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w):
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_ascii_space(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of anything but ASCII white space
    (space, tab, line feed, vertical tab, form feed, carriage return)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` consecutive words, in text order; fewer
    than ``k`` words (but at least one) make a single shingle."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - w + 1, np.uint64(w), np.uint64)
        for i in range(w):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:n - w + 1 + i])
    return h


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 -> the int64 with the same bits (Spark's long)."""
    return x.view(np.int64)


def exact_sums(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """The values (integers from 0) added up by cell, exact below 2^63."""
    if float(value.sum(dtype=np.float64)) < float(1 << 52):  # exact as doubles
        return np.bincount(cell, value, size).astype(np.int64)
    high = np.bincount(cell, value >> 24, size).astype(np.int64)
    return (high << 24) + np.bincount(cell, value & 0xFFFFFF, size).astype(np.int64)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
