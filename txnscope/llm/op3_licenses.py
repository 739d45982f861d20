"""License scans: phrase places plus an exact containment join of text blocks
with license templates.

Every text becomes its words (A-Z lower-cased; runs of 0-9, a-z and
non-ASCII), joined by single spaces. Phrases are counted on that string. For
the templates, a *block* is a window of ``BLOCK`` consecutive words, taken
every ``BLOCK // 2`` words, so any run of ``BLOCK // 2`` words lies whole in
some block. A block matches a template if it holds at least ``threshold`` of
the template's distinct words. The join finds every such pair:

* the template words are ordered by their frequency over all documents,
  rarest first;
* a block that reaches ``need = ceil(threshold * size)`` words must hold one
  of the template's first ``size - need + 1`` words (prefix filter), which is
  an equality join of block words with an index of template prefixes;
* the block must have ``need`` template words at all (length filter), and
  the words left after the two positions must suffice (positional filter);
* surviving pairs are verified on the full sets.

Only DataFrame functions run here. The template side is bounded: ``scan``
refuses more than ``MAX_TEMPLATE_WORDS`` words, so its tables may be
broadcast. Documents are never joined with each other, and the text of a
document is kept only if the document as a whole could reach a template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import with_row_id, written

# Phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices as they are usually written, by label.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2 0",
                   "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted",
            "released under the bsd license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "cc0": ["dedicated to the public domain under cc0"],
    "gpl": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
}
BLOCK = 32  # words of a block, at least
MAX_TEMPLATE_WORDS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalized(text: Column) -> Column:
    """' w0 w1 ... ' with one space around and between the words; a text
    without words (or null) gives one space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN_WORDS, " ")
    low = F.translate(F.trim(spaced), UPPER, LOWER)
    return F.when(low == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), low, F.lit(" ")))


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def block_words(n: int) -> int:
    """The length of blocks for a template of n words: with a step of half a
    block, some block holds a place of the template whole."""
    return max(BLOCK, 1 << (2 * (n - 1) - 1).bit_length()) if n > 1 else BLOCK


def counted(phrase: str) -> str:
    """A pattern with one match for every place of the phrase, also where
    places of a phrase that repeats itself overlap."""
    w = phrase.split()
    overlaps = any(w[i:] == w[:len(w) - i] for i in range(1, len(w)))
    return f" (?={phrase} )" if overlaps else f" {phrase}(?= )"


def _lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, list[str]] = TEMPLATES,
         threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, matches``.

    n_base counts all places of all phrases; first_word and last_word are the
    smallest and largest start of a place (words from 0; null without one).
    base_labels and labels are distinct, sorted and comma-joined, '' without
    any. score is 1 with a phrase place, else the largest containment of a
    template that reaches ``threshold``, else 0. matches lists every label
    with a matching block: (label, first word of its best block, containment,
    whether some block has no better label). labels takes those that are best
    in a block, so near-equal notices don't all count. Null and empty texts have 0 words.
    Repeated rows and ids stay separate rows; other columns are ignored.
    """
    for p in phrases:
        if not re.fullmatch(r"[0-9a-z]+( [0-9a-z]+)*", p):
            raise ValueError(f"phrase must be lower-case words: {p!r}")
    temps = [(label, sorted(set(t.split()))) for label, texts in sorted(templates.items()) for t in texts]
    lengths = [block_words(len(t.split())) for _, texts in sorted(templates.items()) for t in texts]
    vocab = sorted({w for _, ws in temps for w in ws})
    if len(vocab) > MAX_TEMPLATE_WORDS or sum(len(ws) for _, ws in temps) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    need = [math.ceil(threshold * len(ws) - 1e-9) for _, ws in temps]

    s = F.col("_s")
    base = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("_s"))
    base = base.withColumn("n_words", (spaces(s) - 1).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for p, label in phrases.items():
        has = F.contains(s, F.lit(f" {p} "))
        counts.append(F.when(has, F.regexp_count(s, F.lit(counted(p)))).otherwise(F.lit(0)))
        firsts.append(F.when(has, spaces(F.substring(s, F.lit(1), F.instr(s, f" {p} "))) - 1))
        lasts.append(F.when(has, F.col("n_words") - spaces(F.substring_index(s, f" {p} ", -1)) - len(p.split())))
        labels.append(F.when(has, F.lit(label)))
    lone = len(phrases) == 1
    base = base.select(
        "doc_id", "n_words", "_s", sum(counts, F.lit(0)).cast("long").alias("n_base"),
        (firsts[0] if lone else F.least(*firsts)).cast("long").alias("first_word"),
        (lasts[0] if lone else F.greatest(*lasts)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("_base"),
        F.array_intersect(F.split(s, " "), _lits(vocab)).alias("_present"))
    # the whole document must already hold enough of some template's words
    could = F.lit(False)
    for (_, ws), n in zip(temps, need, strict=True):
        could = could | (F.size(F.array_intersect("_present", _lits(ws))) >= n)
    base = written(with_row_id(base.withColumn("_s", F.when(could, s))), "licenses")

    # global order: rarest template words first (one row per template word)
    freq = base.select(F.explode("_present").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    index = spark.createDataFrame([(i, label, w, len(ws), n) for i, ((label, ws), n) in enumerate(zip(temps, need, strict=True))
                                   for w in ws], "t int, label string, w string, t_size int, need int")
    index = index.join(F.broadcast(freq), "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sets = index.groupBy("t", "label", "t_size", "need").agg(
        F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ordered"))
    prefixes = (sets.select("t", "label", "t_size", "need", "ordered", F.posexplode("ordered").alias("t_pos", "e"))
              .filter("t_pos <= t_size - need")
              .select("t", "label", "t_size", "need", F.col("ordered.w").alias("t_words"), "t_pos", F.col("e.w").alias("w")))
    order = sets.select(F.explode("ordered").alias("e")).select("e.n", "e.w").distinct()
    # the whole order as one bounded row: rank = position
    order = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda e: e["w"]).alias("_order"))

    words = F.split(F.trim("_s"), " ")
    texts = base.filter("_s is not null").select("_row", words.alias("_w"))

    def hits_of(length: int) -> DataFrame:
        """The templates of one block length against all blocks of it."""
        mine = [i for i, n in enumerate(lengths) if n == length]
        prefix, half = prefixes.filter(F.col("t").isin(mine)), length // 2
        blocks = (texts.select("_row", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1 - half, F.lit(0)), F.lit(half))).alias("start"))
                  .select("_row", "start", F.array_distinct(F.slice("_w", F.col("start") + 1, F.lit(length))).alias("_b")))
        blocks = blocks.crossJoin(F.broadcast(order))  # one row
        blocks = (blocks.select("_row", "start", F.array_intersect("_order", "_b").alias("_b"))  # in global order
                  .filter(F.size("_b") >= min(need[i] for i in mine)))
        seeds = blocks.select("_row", "start", "_b", F.posexplode("_b").alias("b_pos", "w"))
        bound = 1 + F.least(F.col("t_size") - F.col("t_pos") - 1, F.size("_b") - F.col("b_pos") - 1)
        # the words before both positions may match too: with both sides in the
        # same order the first shared word is a seed of its own, so bounding by
        # what follows loses no pair
        return (seeds.join(F.broadcast(prefix), "w")
                .filter((F.size("_b") >= F.col("need")) & (bound >= F.col("need")))
                .select("_row", "start", "label", "need", "t_size",
                        F.size(F.array_intersect("_b", "t_words")).alias("shared"))
                .filter("shared >= need")
                .groupBy("_row", "start", F.lit(length).alias("length"), "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment")))

    first, *others = sorted(set(lengths))
    hits = hits_of(first)
    for n in others:
        hits = hits.unionByName(hits_of(n))
    # at most one entry per label and block
    per_block = (hits.groupBy("_row", "start", "length").agg(F.collect_list(F.struct("label", "containment")).alias("m"))
                 .withColumn("top", F.array_max("m.containment"))
                 .select("_row", "start", F.explode("m").alias("m"), "top"))
    per_label = per_block.groupBy("_row", F.col("m.label").alias("label")).agg(
        F.max_by(F.struct("start", "m.containment"), F.struct("m.containment", -F.col("start"))).alias("m"),
        F.max(F.col("m.containment") == F.col("top")).alias("best"))
    found = per_label.groupBy("_row").agg(F.array_sort(F.collect_list(
        F.struct("label", F.col("m.start").alias("start"), F.col("m.containment").alias("containment"), "best"))).alias("matches"))
    none = F.array().cast("array<struct<label:string,start:int,containment:double,best:boolean>>")
    out = base.drop("_s", "_present").join(found, "_row", "left").withColumn("matches", F.coalesce("matches", none))
    best = F.transform(F.filter("matches", lambda m: m["best"]), lambda m: m["label"])
    both = F.array_sort(F.array_distinct(F.concat("_base", best)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
        "matches")
