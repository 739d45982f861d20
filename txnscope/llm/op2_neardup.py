"""Near-duplicate documents by MinHash with tensored banding.

A table key of plain banding takes ``2 r`` minhashes of its own, so ``m * m``
tables take ``2 r m^2`` of them. Here two collections, A and B, have ``m``
keys of ``r`` minhashes each, and a table key is a pair (A_i, B_j): the same
``m^2`` tables from ``2 r m`` minhashes, about a square root. Two sets meet
if they agree on some A_i and on some B_j. ``m`` is the smallest number for
which sets exactly at the threshold meet with probability ``RECALL``.

1. Where the text is read: the shingle set's size, digest and keys.
2. Equal sets become one class, so a group of copies is one row from here on.
3. Half keys that only one class has are dropped; few classes remain.
4. Remaining classes are grouped by half key (i, A_i); groups with the same
   members are kept once. In a group, classes that also share some B_j are
   the members of a common table. A group is cut into blocks of ``BLOCK``
   members and each pair of blocks is one task's work, so no group is whole
   in one place and no pairs are written out.
5. In a pair of blocks, pairs that meet (each only in its first group), whose
   sizes allow the threshold and that are not already connected here, are
   confirmed on the full sets. Links leave as a spanning forest.
6. Connected components of the links, then of the documents.

Shingles are identified by 64-bit hashes and sets by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import (
    ONE, WordHashes, mix, shingle_hashes, signed, words_ascii_space, written,
)
from txnscope.llm.components import components

R = 3
RECALL = 0.9998
BLOCK = 512
AT_ONCE = 1 << 20  # hashes computed at a time


def n_keys(threshold: float, r: int = R, recall: float = RECALL) -> int:
    miss = 1 - math.sqrt(recall)
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - threshold ** r))))


def shingle_set(text, k: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(words_ascii_space(text)), k))


class TensoredKeys:
    """The A and B keys of a set."""

    def __init__(self, m: int, r: int = R, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.m, self.r = m, r
        self.mult = rng.integers(0, 1 << 63, 2 * m * r, dtype=np.uint64) * np.uint64(2) | ONE

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(len(self.mult), np.uint64(2 ** 64 - 1))
        step = max(1, AT_ONCE // len(self.mult))
        with np.errstate(over="ignore"):
            for lo in range(0, len(s), step):
                h = s[lo:lo + step, None] * self.mult
                h ^= h >> np.uint64(29)
                np.minimum(low, h.min(axis=0), out=low)
            low = low.reshape(2, self.m, self.r)
            key = np.zeros((2, self.m), np.uint64)
            for i in range(self.r):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, i])
        return signed(key[0]), signed(key[1])


def signatures(docs: DataFrame, k: int, m: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        hashes, keys = WordHashes(), TensoredKeys(m)
        for pdf in batches:
            rows = []
            for doc_id, th, t in zip(pdf["doc_id"].astype("Int64"), pdf["th"], pdf["t"], strict=True):
                s = shingle_set(t if isinstance(t, str) else None, k, hashes)
                if len(s):
                    a, b = keys.of(s)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, th, len(s), digest, a, b))
                else:
                    rows.append((doc_id, th, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "th", "n", "digest", "a", "b"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("th"),
                       F.col(text_col).alias("t")).mapInPandas(
        run, "doc_id long, th long, n long, digest binary, a array<long>, b array<long>")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _verify(num: int, den: int):
    """Confirm the pairs of one pair of blocks; yields a spanning forest of
    the links found."""
    def run(pdf):
        pdf = pdf.sort_values("cid")
        i, cross = int(pdf["i"].iloc[0]), int(pdf["lo"].iloc[0]) != int(pdf["hi"].iloc[0])
        cid = pdf["cid"].to_numpy()
        block, n = pdf["block"].to_numpy(), pdf["n"].to_numpy()
        a, b = np.stack(list(pdf["a"])), np.stack(list(pdf["b"]))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
        root = list(range(len(cid)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x in range(len(cid)):
            y = np.arange(x + 1, len(cid))
            if cross:  # pairs inside a block have a unit of their own
                y = y[block[x + 1:] != block[x]]
            if not len(y):
                continue
            ok = (den * np.minimum(n[y], n[x]) >= num * np.maximum(n[y], n[x])) & (b[y] == b[x]).any(axis=1)
            if i:
                ok &= ~(a[y, :i] == a[x, :i]).any(axis=1)  # they met in an earlier group
            for z in y[ok]:
                if find(x) == find(z):
                    continue
                both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                if den * both >= num * (n[x] + n[z] - both):
                    root[find(x)] = find(z)
                    out.append((cid[x], cid[z]))
        return pd.DataFrame(out, columns=["x", "y"])
    return run


def links(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Links (x, y) between classes (cid, doc_id, th, n, a, b) that connect
    the same classes as all links at the threshold do."""
    half = classes.select("cid", F.explode(F.concat(
        F.transform("a", lambda x, i: F.struct(F.lit(0).alias("side"), i.alias("i"), x.alias("v"))),
        F.transform("b", lambda x, i: F.struct(F.lit(1).alias("side"), i.alias("i"), x.alias("v"))))).alias("h")).select("cid", "h.*")
    shared = half.groupBy("side", "i", "v").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cid")).alias("f1"),
                                                F.sum(F.shiftright(F.xxhash64(F.lit(1), "cid"), 24)).alias("f2")).filter("c > 1")
    shared = written(shared, "halves")
    left = written(half.join(shared, ["side", "i", "v"]), "members")
    # a common table takes a shared half key of each side
    meets = left.groupBy("cid").agg(F.min("side").alias("s0"), F.max("side").alias("s1")).filter("s0 < s1").select("cid")
    # groups with the same members are one group, the first of them
    groups = (shared.filter("side = 0").groupBy("c", "f1", "f2").agg(F.min(F.struct("i", "v")).alias("g"))
              .select("c", F.col("g.i").alias("i"), F.col("g.v").alias("v")))
    members = left.filter("side = 0").select("cid", "i", "v").join(groups, ["i", "v"]).join(meets, "cid", "left_semi")
    members = written(members, "members")
    # the full sets of the classes that remain
    need = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "doc_id", "th", "n", "a", "b")

    def full_sets(batches):
        hashes = WordHashes()
        for pdf in batches:
            yield pdf.drop(columns="t").assign(s=[shingle_set(t, k, hashes).tobytes() for t in pdf["t"]])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t"), text_hash(text_col).alias("_th"))
    found = need.join(texts, need["doc_id"].eqNullSafe(texts["_id"]) & (need["th"] == texts["_th"])).drop("_id", "_th", "doc_id", "th")
    found = found.dropDuplicates(["cid"]).mapInPandas(full_sets, "cid long, n long, a array<long>, b array<long>, s binary")
    found = written(found, "sets")

    blocks = F.expr(f"int((c + {BLOCK - 1}) div {BLOCK})")
    units = (members.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "cid"), "_n").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .select("cid", "i", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    out = units.join(found, "cid").groupBy("i", "v", "lo", "hi").applyInPandas(_verify(num, den), "x long, y long")
    return out


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A-Z lower-cased, words between ASCII white space. A row's set: its
    distinct ``k``-word shingles; with fewer words the whole sequence as one;
    without words (or text) it is empty and linked with nothing. Rows are
    linked if ``den * intersection >= num * union``. component_id is the
    smallest id reachable (null ids are larger than any; null if no member
    has an id); kept: the row's id is that id. Repeated rows and ids stay
    separate rows. Other columns are ignored; an empty table gives no rows.
    """
    m = n_keys(num / den)
    sig = written(signatures(docs, k, m, id_col, text_col), "signatures")
    # one row per distinct set; the keys depend on the set alone
    classes = sig.filter("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"),
        F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("first.doc_id").alias("doc_id"),
                                     F.col("first.th").alias("th"), "n", "a", "b"), "classes")
    found = written(links(docs, classes, k, num, den, id_col, text_col), "links")
    comp = written(components(found, "x", "y"), "components").withColumnRenamed("node", "cid")
    low = (comp.join(classes.select("cid", "doc_id"), "cid").groupBy("component").agg(F.min("doc_id").alias("low")))
    by_class = (classes.select("cid", "digest", "doc_id").join(comp, "cid", "left").join(low, "component", "left")
                .select("digest", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")))
    out = sig.select("doc_id", "n", "digest").join(by_class, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
