"""Best-fit packing of tokenized documents into sequences of fixed length.

1. Tokenize where the text is read; write one row per piece with its ids.
2. Each partition packs its own pieces: sizes in decreasing order, each into
   the fullest open bin that has room (best fit). A partition of more than
   ``LOCAL_ROWS`` pieces packs them in chunks of that size.
3. Hierarchical residual packing: nearly full bins are emitted. Underfull
   bins become items of the next round, where ``FAN_IN`` groups at a time
   are packed again by best fit, until one group is left.

What a group passes on is bounded without losing anything: after best fit at
most one bin of a group is at most half full (two such would fit together),
and every later merge uses up one such bin. So besides its half-empty bin a
group passes on no more bins than there are groups; all others are finished
sequences. Only (id, fill) rows travel between the rounds, never ids.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.llm.common import written

SEQUENCE = 2048
SEPARATOR = 0
NEARLY_FULL = 16  # free tokens at which a bin is emitted as it is
LOCAL_ROWS = 250_000
FAN_IN = 8
TOKEN_BATCH = 2_000_000  # ids held before they are handed on


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class BytePairIds:
    """text -> ids of a byte-level BPE tokenizer file (``tokenizers`` JSON).

    The file's vocabulary is run by tiktoken, about four times as fast with
    the same ids (ids rise with merge rank in these files; a probe text
    checks it). tiktoken overflows its stack on huge runs of white space, so
    texts with such a run go to the ``tokenizers`` library itself, and so do
    texts that hold the string of a special token, which is one id there
    (``plain``: ordinary text).
    """

    PROBE = "It's 1,234 tokens\n\n  of \u00e9t\u00e9 \u65e5\u672c\u8a9e; don't <|x|>\tstop \U0001f600 "

    def __init__(self, path: str, plain: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        slow = [r"\s{500}"] + ([] if plain else [re.escape(t) for t in sorted(special) if t])
        self.needs_slow = re.compile("|".join(slow))
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        if self.enc.encode_ordinary(self.PROBE) != self.slow(self.PROBE):
            raise ValueError(f"{path} is not a byte-level BPE in rank order")

    def slow(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        ids = self.slow(text) if self.needs_slow.search(text) else self.enc.encode_ordinary(text)
        return np.array(ids, "<u4")


def byte_letters() -> list[str]:
    """The letter by which byte-level BPE files write each byte: printable
    Latin-1 letters stand for themselves, the rest follow from U+0100."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(rest)) for b in range(256)]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else
    pieces of ``size``, the first one shorter unless ``size`` divides n."""
    head = n if n <= size else n % size
    out = [(0, head)] if head else []
    return out + [(s, size) for s in range(head, n, size)]


def piece_frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def tokenize(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, separator: int = SEPARATOR,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (binary,
    little-endian unsigned 32-bit). A document's ids are its text's and then
    the separator; null and empty texts have the separator alone."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc = BytePairIds(path)
        end = np.array([separator], "<u4")
        for pdf in batches:
            rows, held = [], 0
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["t"], strict=True):
                ids = np.concatenate([enc.encode(text), end]) if isinstance(text, str) else end
                for k, (s, n) in enumerate(cuts(len(ids), size)):
                    rows.append((doc_id, k, s, n, ids[s:s + n].tobytes()))
                held += len(ids)
                if held >= TOKEN_BATCH:
                    yield piece_frame(rows)
                    rows, held = [], 0
            yield piece_frame(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Pack sizes (already in decreasing order): the bin number and offset of
    each, and the fill of each bin. Ties go to the bin freed up last."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    mask = 0  # bit f is set if room[f] has a bin
    bins, offsets, fill = [], [], []
    for s in sizes:
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += s
        if free - s > 0:
            room[free - s].append(b)
            mask |= 1 << (free - s)
    return bins, offsets, fill


def _pack_locally(size: int):
    def pack(pdf, grp):
        pdf = pdf.sort_values(["length", "_key"], ascending=[False, True], kind="stable")
        bins, offsets, fill = best_fit(pdf["length"].tolist(), size)
        bins = np.array(bins, np.int64)
        keys = pdf["_key"].to_numpy()
        first = np.zeros(len(fill), np.int64)
        first[bins[::-1]] = keys[::-1]  # a bin is named by its first item
        return pdf.assign(_bin=first[bins], offset=np.array(offsets, np.int64),
                          _fill=np.array(fill, np.int64)[bins], _grp=np.int64(grp))

    def run(batches):
        from pyspark import TaskContext
        grp, held, n = TaskContext.get().partitionId() << 20, [], 0
        for pdf in batches:
            for lo in range(0, len(pdf), LOCAL_ROWS):
                part = pdf.iloc[lo:lo + LOCAL_ROWS]
                if n and n + len(part) > LOCAL_ROWS:
                    yield pack(pd.concat(held), grp)
                    held, n, grp = [], 0, grp + 1
                held.append(part)
                n += len(part)
        if n:
            yield pack(pd.concat(held), grp)
    return run


def _merge(size: int, groups: int):
    """Best fit of a group's underfull bins; rows that stay in play keep
    their group, finished ones have a null group."""
    def run(pdf):
        pdf = pdf.sort_values(["_fill", "_bin"], ascending=[False, True])
        fills, ids, members = pdf["_fill"].tolist(), pdf["_bin"].tolist(), pdf["_members"].tolist()
        bins, offsets, fill = best_fit(fills, size)
        name, inside = [0] * len(fill), [[] for _ in fill]
        for i, (b, o) in enumerate(zip(bins, offsets, strict=True)):
            if o == 0:
                name[b] = ids[i]
            inside[b] += [{"bin": m["bin"], "offset": m["offset"] + o} for m in members[i]]
        go = still_open(np.array(fill, np.int64), size, groups)
        return pd.DataFrame({"_grp": pd.array([pdf["_grp"].iloc[0] if g else None for g in go], "Int64"),
                             "_bin": name, "_fill": fill, "_members": inside})
    return run


def still_open(fill: np.ndarray, size: int, groups: int) -> np.ndarray:
    """Which bins of one group go on: those at most half full, and of the
    others with room the ``groups`` emptiest."""
    go = fill * 2 <= size
    others = np.flatnonzero(~go & (fill < size - NEARLY_FULL))
    if groups > 1:
        go[heapq.nsmallest(groups, others, key=lambda i: (fill[i], i))] = True
    else:
        go[:] = False
    return go


def place(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces (any table with ``length`` and a
    unique long ``_key``, already written, so that it reads the same again).
    Every piece gets one place; sequences are gapless from offset 0."""
    spark = pieces.sparkSession
    types = dict(pieces.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in pieces.columns] + ["_bin long", "offset long", "_fill long", "_grp long"])
    local = written(pieces.mapInPandas(_pack_locally(size), schema), "packed")
    bins = local.filter(f"offset = 0 and _fill < {size - NEARLY_FULL}").select("_grp", "_bin", "_fill")
    groups = local.agg(F.count_distinct("_grp")).first()[0]
    # number the groups 0, 1, ... through their own one-row-per-group table
    names = [r[0] for r in local.select("_grp").distinct().orderBy("_grp").collect()] if groups > 1 else []
    if not names:
        return local.withColumnRenamed("_bin", "sequence_id").drop("_fill", "_grp")
    numbers = spark.createDataFrame([(g, i // FAN_IN) for i, g in enumerate(names)], "_grp long, _to long")
    play = bins.join(F.broadcast(numbers), "_grp")  # one row per local group
    half = play.filter(F.col("_fill") * 2 <= size)
    rest = play.filter(F.col("_fill") * 2 > size)
    w = Window.partitionBy("_grp").orderBy("_fill", "_bin")
    rest = rest.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= groups).drop("_n")
    members = F.array(F.struct(F.col("_bin").alias("bin"), F.lit(0).cast("long").alias("offset")))
    play = half.unionByName(rest).select(F.col("_to").alias("_grp"), "_bin", "_fill", members.alias("_members"))
    out_schema = "_grp long, _bin long, _fill long, _members array<struct<bin:long,offset:long>>"
    done = []
    groups = -(-groups // FAN_IN)
    while True:
        step = written(play.groupBy("_grp").applyInPandas(_merge(size, groups), out_schema), "merged")
        done.append(step.filter("_grp is null"))
        if groups == 1:
            break
        play = step.filter("_grp is not null").withColumn("_grp", F.expr(f"_grp div {FAN_IN}"))
        groups = -(-groups // FAN_IN)
    moved = done[0]
    for d in done[1:]:
        moved = moved.unionByName(d)
    moved = (moved.select(F.col("_bin").alias("_into"), F.explode("_members").alias("m"))
             .select("_into", F.col("m.bin").alias("_bin"), F.col("m.offset").alias("_add")).filter("_into <> _bin"))
    return (local.join(moved, "_bin", "left")
            .withColumn("offset", F.col("offset") + F.coalesce("_add", F.lit(0)))
            .withColumn("sequence_id", F.coalesce("_into", "_bin"))
            .drop("_bin", "_into", "_add", "_fill", "_grp"))


def keyed(pieces: DataFrame) -> DataFrame:
    """The pieces as a written table with a unique ``_key``."""
    return written(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, separator: int = SEPARATOR,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``, one row per
    piece of every row of ``docs``. Documents of more than ``size`` ids are
    cut into pieces of ``size``, the first one shorter. Null ids and repeated
    rows are packed like any others; other columns are ignored; an empty
    table gives no rows."""
    pieces = keyed(tokenize(docs, tokenizer, size, separator, id_col, text_col))
    where = place(pieces.select("_key", "length"), size).select("_key", "sequence_id", "offset")
    return pieces.join(where, "_key").drop("_key")


def pack_digest(docs: DataFrame, **options) -> DataFrame:
    """As ``pack``, with the checksum of the ids instead of the ids, which
    are then not moved."""
    pieces = keyed(tokenize(docs, **options))
    digest = pieces.select("_key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(digest, options.get("size", SEQUENCE)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
