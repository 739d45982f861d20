"""Ranked lexical search: every document is scanned once per pass by an
Aho-Corasick automaton of all items' terms.

1. Texts are folded to bytes in which words stand between spaces, and every
   term is guarded by a space on both sides, so the automaton reports whole
   words only. No index of the documents is built and no text moves.
2. The first scan counts, per partition, the documents with words, all words
   and each term's document frequency; their sums give the terms' weights.
3. The second scan counts term frequencies anew, turns them into integer
   contributions, and adds these up for the items that the automaton's outputs
   map to. A partition keeps each item's best ``k`` documents, which are merged
   in two rounds, so no item's candidates meet in one task.

Items are searched in passes of at most ``PASS_BYTES`` of item text, which
bounds the broadcast automaton (one larger item is a pass of its own); each
pass scans the documents twice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnscope.llm.blocks import in_blocks
from txnscope.llm.common import drop_written, exact_sums, written

PASS_BYTES = 1 << 20
CELLS = 1 << 21  # (document, item) scores held at once by a task
MATCHES = 1 << 19
MERGE = 64
WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z lower-cased, bytes outside of words as spaces
FOLD = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in WORD_BYTES else 0x20 for b in range(256))
SCHEMA = "item_id long, rank int, doc_id long, score long"


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def terms_of(text: str | None) -> list[bytes]:
    return folded(text).split() if text else []


class Items:
    """The terms of one pass and the items that each leads to."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        postings: dict[bytes, dict[int, int]] = {}
        for at, (_, text) in enumerate(rows):
            for t in terms_of(text):
                of = postings.setdefault(t, {})
                of[at] = of.get(at, 0) + 1
        self.terms = sorted(postings)
        sizes = [len(postings[t]) for t in self.terms]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.array([i for t in self.terms for i in postings[t]], np.int64)
        self.times = np.array([n for t in self.terms for n in postings[t].values()], np.int64)

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, t in enumerate(self.terms):
            a.add_word(f" {t.decode('latin-1')} ", n)
        a.make_automaton()
        return a


def matches(automaton, words: bytes) -> np.ndarray:
    """The numbers of the terms in folded text, one for each place."""
    return np.fromiter((n for _, n in automaton.iter(f" {words.decode('latin-1')} ")), np.int64)


def scan(automaton, texts, n_terms: int, most: int):
    """(documents from, to, their words, document, term, times) for some
    documents at a time, ``most`` at most."""
    lo, lengths, found, held = 0, [], [], 0
    for at, text in enumerate(texts):
        words = folded(text) if isinstance(text, str) else b""
        n = len(words.split())
        lengths.append(n)
        hit = matches(automaton, words) if n else np.empty(0, np.int64)
        found.append(hit + (at - lo) * n_terms)
        held += len(hit)
        if held >= MATCHES or len(lengths) == most:
            yield lo, np.array(lengths, np.int64), *counted(found, n_terms)
            lo, lengths, found, held = at + 1, [], [], 0
    if lengths:
        yield lo, np.array(lengths, np.int64), *counted(found, n_terms)


def counted(found: list, n_terms: int):
    code, times = np.unique(np.concatenate(found), return_counts=True)
    return code // max(1, n_terms), code % max(1, n_terms), times


def statistics(shared):
    """One partition's counts as (term, n): documents with words at -1, all
    words at -2, the terms' document frequencies."""
    def run(batches):
        items = shared.value
        automaton, df = items.automaton(), np.zeros(len(items.terms), np.int64)
        docs = words = 0
        for pdf in batches:
            for _, n, _, term, _ in scan(automaton, pdf["text"], len(df), MATCHES):
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
                df += np.bincount(term, minlength=len(df))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate([[-1, -2], at]), "n": np.concatenate([[docs, words], df[at]])})
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Of a term with frequency tf in a document of n words."""
    most = 25 * int(n.max(initial=0)) * n_docs
    if most < 1 << 63:
        m = 75 + (25 * n * n_docs) // n_words
    else:
        m = np.array([75 + (25 * int(x) * n_docs) // n_words for x in n], np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Best:
    """The best k documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.kept = k, np.empty((4, 0), np.int64)  # item, score, id is null, id
        self.least = np.ones(n_items, np.int64)

    def add(self, item, score, null, doc):
        self.kept = np.concatenate([self.kept, np.stack([item, score, null, doc])], 1)
        self.kept = self.kept[:, np.lexsort((self.kept[3], self.kept[2], -self.kept[1], self.kept[0]))]
        item = self.kept[0]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        last = nth == self.k - 1
        self.least[item[last]] = self.kept[1, last]
        self.kept = self.kept[:, nth < self.k]


def ranking(shared, weights, n_docs: int, n_words: int, k: int):
    """One partition's best documents of each item of a pass."""
    def run(batches):
        items, w = shared.value, weights.value
        automaton, n_items, n_terms = items.automaton(), len(items.ids), len(items.terms)
        best = Best(n_items, k)
        degree = np.diff(items.starts)
        for pdf in batches:
            doc, null = pdf["doc_id"].to_numpy(np.int64), pdf["none"].to_numpy(np.int64)
            for lo, n, d, term, tf in scan(automaton, pdf["text"], n_terms, max(1, CELLS // n_items)):
                if not len(d):
                    continue
                value = contributions(w[term], tf, n[d], n_docs, n_words)
                times = degree[term]
                # every (document, term) once for each item of the term
                post = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(items.starts[term], times)
                cell = np.repeat(d, times) * n_items + items.item[post]
                score = exact_sums(cell, np.repeat(value, times) * items.times[post], len(n) * n_items).reshape(len(n), n_items)
                row, item = np.nonzero(score >= best.least)
                best.add(item, score[row, item], null[lo + row], doc[lo + row])
        item, score, null, doc = best.kept
        yield pd.DataFrame({"item": item, "item_id": pd.array(np.array(items.ids, np.int64)[item], "Int64"), "score": score,
                            "doc_id": pd.array(np.where(null, None, doc), "Int64")})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with
    a score above 0, highest first, equal scores by ascending id, null ids
    last.

    Every row of ``docs`` is a document, rows that repeat an id included;
    null, empty and wordless texts have no terms. Items: rows without an id
    or without terms have no result; rows that repeat id and text count once;
    rows that repeat an id with another text are items of their own under the
    same id. Empty tables give no rows. Other columns are ignored. The jobs of
    all passes run on call.
    """
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("none"), F.col(text_col).alias("text"))
    wanted = (items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
              .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct())
    wanted, n_passes = in_blocks(wanted, ["item_id", "text"], F.octet_length("text") + 1, pass_bytes, "items")
    out = None
    for p in range(n_passes):
        rows = wanted.filter(F.col("_block") == p).select("item_id", "text").collect()  # at most PASS_BYTES, or one item
        found = one_pass(spark, texts, Items(sorted((r["item_id"], r["text"]) for r in rows)), k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    drop_written(wanted)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def one_pass(spark: SparkSession, texts: DataFrame, items: Items, k: int) -> DataFrame | None:
    """The result of one pass of items, written."""
    if not items.terms:
        return None
    shared = spark.sparkContext.broadcast(items)
    counts = dict(texts.select("text").mapInPandas(statistics(shared), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n_docs, n_words = counts.get(-1, 0), counts.get(-2, 0)
    if not n_docs:
        return None
    weights = spark.sparkContext.broadcast(np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(items.terms))], np.int64))
    near = texts.mapInPandas(ranking(shared, weights, n_docs, n_words, k), "item long, item_id long, score long, doc_id long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", "_part").orderBy(*order)
    near = near.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    near = near.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return written(near.select("item_id", "rank", "doc_id", "score"), "ranked")
