"""Benchmark decontamination: Smith-Waterman wherever words in common allow it.

The score of an alignment is 2 matches - edits, so one that reaches
``threshold`` of the item's own score matches that share of its words.

1. Some match is among the item's rarest words, as many as may be missing and
   one more: items with none of them in the text are left out.
2. Places of the item whose word the text has count +2, others -1; so do
   places of the text whose word the item has. The best run of places bounds
   the score from both sides, and the text is cut where no run goes on.
3. What remains is aligned (match +2, other -1).

All three are bounds, so the result is that of aligning every document with
every item, at any threshold; there are no seeds that edits can break.

Documents never move: the benchmark side is what tasks get. It is used in
blocks of ``BLOCK_WORDS`` words, so what a task holds is bounded; a larger
benchmark takes more passes over the documents.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import WordHashes

MIN_WORDS = 3
THRESHOLD = 0.5
MATCH, OTHER, GAP = 2, -1, 1
BLOCK_WORDS = 500_000
BETWEEN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PUNCTUATION = re.compile(b"\xe2[\x80\x81][\x80-\xbf]")  # U+2000 to U+207F in UTF-8


def words(text) -> list[bytes]:
    """Runs of ASCII letters and digits and other characters beyond ASCII,
    lower-cased; punctuation doesn't count."""
    if not isinstance(text, str):
        return []
    b = text.lower().encode("utf-8", "surrogatepass").translate(BETWEEN)
    return (PUNCTUATION.sub(b" ", b) if b"\xe2" in b else b).split()


def align_score(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of it in the passage)."""
    n = len(passage)
    ramp = GAP * np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        nxt = np.zeros(n + 1, np.int64)
        nxt[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, OTHER), row[1:] - GAP)
        np.maximum(nxt, 0, out=nxt)
        row = np.maximum.accumulate(nxt + ramp) - ramp  # gaps along the passage
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score over the item's own, start, end in the passage)."""
    best, end = align_score(item, passage)
    if not best:
        return 0.0, 0, 0
    back, length = align_score(item[::-1], passage[:end][::-1])
    return best / (MATCH * len(item)), end - length, end


def rises(shared: np.ndarray) -> np.ndarray:
    """Before and after each place: the best run of places that ends there, 2
    for a shared place and -1 for any other. An alignment scores no more than
    the run it spans, and loses nothing where it is cut at a 0."""
    c = np.zeros(len(shared) + 1, np.int64)
    np.cumsum(np.where(shared, MATCH, OTHER), out=c[1:])
    return c - np.minimum.accumulate(c)


class Items:
    """One block of test items as numbers in the block's vocabulary."""

    def __init__(self, rows: list[tuple[int, list[int]]], threshold: float):
        rows = [r for r in rows if len(r[1]) >= MIN_WORDS]
        self.ids = [r[0] for r in rows]
        self.size = np.array([len(r[1]) for r in rows], np.int64)
        self.need = threshold * MATCH * self.size - 1e-9
        flat = np.array([w for r in rows for w in r[1]], np.uint64)
        self.vocabulary, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), self.size)
        # each item is ended by a word that no text has
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.codes = np.full(len(flat) + len(rows), len(self.vocabulary), np.int64)
        self.codes[np.arange(len(flat)) + owner] = code
        # the rarest words of each item, of which a text must have one
        by = np.lexsort((code, np.bincount(code, minlength=len(self.vocabulary))[code], owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        least = np.maximum(1, np.ceil(self.need / MATCH)).astype(np.int64)
        one = np.unique(np.stack([code[by], owner])[:, rank <= (self.size - least)[owner]], axis=1)
        self.item = one[1]
        self.first = np.searchsorted(one[0], np.arange(len(self.vocabulary) + 1))

    def words(self, k: int) -> np.ndarray:
        return self.codes[self.start[k]:self.start[k] + self.size[k]]

    def candidates(self, there: np.ndarray) -> np.ndarray:
        """The items that a text with the words ``there`` may hold."""
        n = self.first[there + 1] - self.first[there]
        items = np.unique(self.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[there], n)])
        if not len(items):
            return items
        n = self.size[items] + 1
        ends = np.cumsum(n)
        x = np.arange(ends[-1]) - np.repeat(ends - n - self.start[items], n)
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[there] = True
        c = np.cumsum(np.where(present[self.codes[x]], MATCH, OTHER))
        c -= np.repeat(np.arange(len(items)) * MATCH * int(n.max()), n)  # each item starts below all before it
        best = np.maximum.reduceat(c - np.minimum.accumulate(np.minimum(c, 0)), ends - n)
        # the first place of an item may itself be the lowest
        return items[best + MATCH >= self.need[items]]

    def find(self, text_words: np.ndarray) -> list[tuple]:
        """(item id, score, start, end) of the aligned passages; those of one
        item don't overlap."""
        if not len(text_words) or not len(self.ids):
            return []
        code = np.searchsorted(self.vocabulary, text_words)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == text_words
        code[~known] = len(self.vocabulary) + 1  # in no item
        there = np.zeros(len(self.vocabulary) + 2, bool)
        there[code] = True
        out = []
        for k in self.candidates(np.flatnonzero(there[:-2])).tolist():
            out += self.passages(k, code)
        return out

    def passages(self, k: int, code: np.ndarray) -> list[tuple]:
        """The best passage of item k in a text, and those beside it."""
        w, need = self.words(k), self.need[k]
        own = np.zeros(len(self.vocabulary) + 2, bool)
        own[w] = True
        out, spans = [], [(0, len(code))]
        while spans:
            lo, hi = spans.pop()
            rise = rises(own[code[lo:hi]])
            if rise.max() < need:
                continue
            zeros = np.append(np.flatnonzero(rise == 0), len(rise))
            for j in np.flatnonzero(np.maximum.reduceat(rise, zeros[:-1]) >= need).tolist():
                s, e = lo + int(zeros[j]), min(hi, lo + int(zeros[j + 1]))
                part = code[s:e]
                if rises(np.isin(w, part)).max() < need:
                    continue
                score, a, b = align(w, part)
                if b > a and score * MATCH * len(w) >= need:
                    out.append((self.ids[k], score, s + a, s + b))
                    spans += [(s, s + a), (s + b, e)]
        return out


def item_blocks(benchmark: DataFrame, threshold: float, id_col: str = "item_id", text_col: str = "text") -> list[Items]:
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item)."""
    hashes = WordHashes()
    blocks: list[list] = [[]]
    size = 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        w = [hashes[x] for x in words(r["t"])]
        if size and size + len(w) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"], w))
        size += len(w)
    return [Items(b, threshold) for b in blocks]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: every passage of a
    document that aligns with a test item at ``threshold`` of the item's own
    score or more (words as runs of letters and digits, from 0).

    Null and empty texts hold none; items of fewer than 3 words are not
    sought; repeated items with one id count once.
    Repeated rows each give their rows; other columns are ignored. An empty
    table on either side gives no rows.
    """
    found = None
    for block in item_blocks(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            hashes = WordHashes()
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["t"], strict=True)
                        for hit in shared.value.find(hashes.of(words(t)))]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])
                yield out.astype({"doc_id": "Int64"})

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(
            scan, "doc_id long, item_id long, score double, start_word int, end_word int")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without an aligned passage, unchanged."""
    out = docs
    for block in item_blocks(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            hashes = WordHashes()
            for pdf in batches:
                yield pdf[[not shared.value.find(hashes.of(words(t))) for t in pdf[text_col]]]

        out = out.mapInPandas(keep, docs.schema)
    return out
