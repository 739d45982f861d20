"""Alignment of two tokenizers' tokens over a corpus, with how many documents
hold each linked pair of ids.

Both tokenizers cut the same bytes. A link is a token of A and a token of B
whose byte ranges overlap; a cut is a byte offset where tokens of both end.
Between two ends that follow each other stands exactly one token of each, so
the links are the segments between the ends of either.

Inverted pair bitmaps: documents are numbered within *chunks* (at most
``CHUNK_DOCS`` documents, cut earlier at ``CHUNK_LINKS`` links). For every
linked pair, a chunk holds a compressed bitmap of its documents (sorted 16-bit
places, or plain bits where that is shorter), and bit planes of how often a
document holds the pair beyond once. The batches of a chunk are OR-merged
where they arise; chunks are disjoint ranges of the documents, so a pair's
document count is the sum of its bitmaps' popcounts, and its link count adds
the planes' by their place value.

The counts return along the postings: a chunk's bitmaps are read again with
their pair's count, which is credited to the documents they name. A pair has
one row a chunk and plane however common it is, so no key is hot, and nothing
larger than a chunk meets in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnscope.llm.common import exact_sums, written
from txnscope.llm.op7_packing import BytePairIds, default_tokenizer

CHUNK_DOCS = 1 << 13  # a document's place in its chunk has 13 bits
CHUNK_LINKS = 3_000_000
BITS_BYTES = CHUNK_DOCS // 8
SPARSE = BITS_BYTES // 2  # fewer places than this are stored one by one
BATCH_TOKENS = 300_000
DOC_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SCHEMA = f"chunk long, pos int, {DOC_FIELDS}, pair long, plane int, bits binary"

ARROW = pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()),
                   ("plane", pa.int32()), ("bits", pa.binary())])


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class TokenizerA:
    """Byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.ids = BytePairIds(path, plain=True)
        self.bytes = [b""] * (max(self.ids.ranks.values()) + 1)
        for b, i in self.ids.ranks.items():
            self.bytes[i] = b

    def encode(self, text: str) -> np.ndarray:
        return self.ids.encode(" " + text).astype(np.int64)


class TokenizerB:
    """SentencePiece, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(self.sp.get_piece_size()) for p in [self.sp.id_to_piece(i)]]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text, num_threads=1), np.int64)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = TokenizerA(path_a), TokenizerB(path_b)
        self.len_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        # an id in writing with what follows it: within its side, at its side's end
        self.written = [f"{i}{c}".encode() for n, ends in ((len(self.len_a), ",|"), (len(self.len_b), ",;")) for c in ends for i in range(n)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none if either doesn't stand for the whole text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        whole = (" " + text).encode("utf-8", "surrogatepass")
        b = self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != whole:
            return none, none
        a = self.a.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != whole:
            return none, none
        return a, b

    def align(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        """For some documents' ids: per document the numbers of groups and of
        links and the groups' digest; the links as (document, a, b)."""
        n_a, n_b = np.array([len(a) for a, _ in docs]), np.array([len(b) for _, b in docs])
        a, b = np.concatenate([a for a, _ in docs]), np.concatenate([b for _, b in docs])
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends, cuts = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        doc_a = np.repeat(np.arange(len(docs)), n_a)
        link_doc = doc_a[link_a]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_groups = np.bincount(doc_a[np.searchsorted(end_a, cuts)], minlength=len(docs))
        n_links = np.bincount(link_doc, minlength=len(docs))
        # the ids in writing: a group's A ids, then its B ids
        size_a, size_b = len(self.len_a), len(self.len_b)
        seq = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        seq[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + last(group_a) * size_a
        seq[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * size_a + b + last(group_b) * size_b
        stop = np.cumsum(n_a + n_b)
        digests = []
        for lo, hi in zip((stop - n_a - n_b).tolist(), stop.tolist(), strict=True):
            text = b"".join(map(self.written.__getitem__, seq[lo:hi].tolist()))
            digests.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return n_a, n_b, n_groups, n_links, digests, (link_doc, a[link_a], b[link_b])


def compressed(pair: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted (pair, place) -> the distinct pairs and their bitmaps."""
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(pair)))
    dense = size >= SPARSE
    length = np.where(dense, BITS_BYTES, 2 * size)
    offset = np.append(0, np.cumsum(length))
    data = np.zeros(offset[-1] // 2, "<u2")
    group = np.repeat(np.arange(len(start)), size)
    one = ~dense[group]
    data[(offset[group] // 2 + np.arange(len(pair)) - start[group])[one]] = pos[one]
    for g in np.flatnonzero(dense):
        bits = np.zeros(CHUNK_DOCS, np.uint8)
        bits[pos[start[g]:start[g] + size[g]]] = 1
        data[offset[g] // 2:offset[g + 1] // 2] = np.packbits(bits, bitorder="little").view("<u2")
    return pair[start], pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])


def places(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps -> (number of the bitmap, place of a document in it)."""
    offset = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset:bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2], np.uint8) if bits.buffers()[2] is not None else np.empty(0, np.uint8)
    length = np.diff(offset)
    dense = length == BITS_BYTES
    size = np.where(dense, 0, length // 2)
    row = np.repeat(np.arange(len(bits)), size)
    at = np.repeat(offset[:-1] - np.append(0, 2 * np.cumsum(size))[:-1], size) + 2 * np.arange(len(row))
    pos = data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8)
    rows, poss = [row], [pos]
    for g in np.flatnonzero(dense):
        on = np.flatnonzero(np.unpackbits(data[offset[g]:offset[g + 1]], bitorder="little"))
        rows.append(np.full(len(on), g))
        poss.append(on)
    return np.concatenate(rows), np.concatenate(poss)


class Chunk:
    """The documents and links of one chunk while it fills."""

    def __init__(self, number: int, size_b: int):
        self.number, self.size_b = number, size_b
        self.docs, self.codes, self.times, self.n, self.links = [], [], [], 0, 0

    def add(self, ids: list, aligner: Aligner, docs: list) -> None:
        n_a, n_b, n_groups, n_links, digests, (doc, a, b) = aligner.align(docs)
        self.docs += zip(ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, strict=True)
        code, times = np.unique(((a * self.size_b + b) << 13) | (doc + self.n), return_counts=True)
        self.codes.append(code)
        self.times.append(times)
        self.n += len(docs)
        self.links += len(a)

    def batches(self):
        """The chunk's documents, then its bitmaps and planes."""
        def filled(n, **columns):
            return pa.RecordBatch.from_arrays([
                pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)
        if not self.n:
            return
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        yield filled(self.n, chunk=np.full(self.n, self.number), pos=np.arange(self.n, dtype=np.int32),
                     **dict(zip(names, zip(*self.docs, strict=True), strict=True)))
        code, times = np.concatenate(self.codes), np.concatenate(self.times)
        order = np.argsort(code)  # the OR of the batches: their documents differ
        code, times = code[order], times[order]
        pair, pos, more = code >> 13, code & (CHUNK_DOCS - 1), times - 1
        plane, on = -1, np.ones(len(pair), bool)
        while on.any():
            keys, bits = compressed(pair[on], pos[on])
            key = ((keys // self.size_b) << 32) | (keys % self.size_b)
            for lo in range(0, len(key), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                n = len(key[part])
                yield filled(n, chunk=np.full(n, self.number), pair=key[part], plane=np.full(n, plane, np.int32), bits=bits[part])
            # planes in between may be empty
            plane = next((p for p in range(plane + 1, 64) if (more >> p).any() and ((more >> p) & 1).any()), 64)
            on = (more >> min(plane, 63)) & 1 > 0


def bitmaps(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, id_col: str = "doc_id",
            text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """The chunks' rows, written: one per document (``chunk, pos`` and its
    own counts) and one per linked pair and plane (``chunk, pair, plane,
    bits``; plane -1 is the documents' bitmap, plane p says which hold the
    pair 1 + 2^p or more times, in binary)."""
    path_a, path_b = tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces()
    doc_id = F.col(id_col).cast("long")

    def run(batches):
        from pyspark import TaskContext
        aligner = Aligner(path_a, path_b)
        size_b = len(aligner.len_b)
        chunk = Chunk(TaskContext.get().partitionId() << 32, size_b)
        for batch in batches:
            ids, held, n = [], [], 0
            for at, text in enumerate(batch.column("text")):
                a, b = aligner.tokens(text.as_py())
                ids.append(batch.column("doc_id")[at].as_py())
                held.append((a, b))
                n += len(a) + len(b)
                full = chunk.n + len(held) == CHUNK_DOCS or chunk.links + n >= chunk_links
                if n >= BATCH_TOKENS or full or at == len(batch) - 1:
                    chunk.add(ids, aligner, held)
                    ids, held, n = [], [], 0
                if full:
                    yield from chunk.batches()
                    chunk = Chunk(chunk.number + 1, size_b)
        yield from chunk.batches()

    return written(docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA), "bitmaps")


def popcount():
    """Of a compressed bitmap."""
    bits = F.col("bits")
    return F.when(F.octet_length(bits) == BITS_BYTES, F.bitmap_count(bits)).otherwise(F.expr("octet_length(bits) div 2"))


def pair_counts(maps: DataFrame) -> DataFrame:
    """``pair, a, b, n_docs, n_links, best``: the pairs' corpus-wide counts;
    best if no pair of the same A id stands in more documents."""
    first = F.col("plane") < 0
    counts = maps.filter(F.col("pair").isNotNull()).groupBy("pair").agg(
        F.sum(F.when(first, popcount()).otherwise(0)).alias("n_docs"),
        F.sum(F.when(first, popcount()).otherwise(popcount() * F.expr("shiftleft(1L, greatest(plane, 0))"))).alias("n_links"))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", "n_links")
    # an A id has as many rows as there are B ids at most
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def credit(table: pa.Table) -> pa.Table:
    """One chunk: its bitmaps' counts added up for the documents they name."""
    docs = table.filter(pc.is_valid(table["pos"]))
    maps = table.filter(pc.is_valid(table["pair"])).combine_chunks()
    n_best = count_sum = np.zeros(CHUNK_DOCS, np.int64)
    if len(maps):
        row, pos = places(maps["bits"].chunk(0))
        times = (1 << np.maximum(maps["plane"].to_numpy(), 0)).astype(np.int64)
        n_best = exact_sums(pos, (times * maps["best"].to_numpy(zero_copy_only=False))[row], CHUNK_DOCS)
        count_sum = exact_sums(pos, (times * maps["n_docs"].to_numpy())[row], CHUNK_DOCS)
    at = docs["pos"].to_numpy()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs[c] for c in names), pa.array(n_best[at]), pa.array(count_sum[at]), docs["groups_sha256"]],
                    names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` for every row of ``docs``: tokens of both tokenizers,
    groups between common cuts, links, links whose pair is among the most
    common of its A id, the sum over links of their pair's document count, and
    the SHA-256 of the groups in writing (``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts that the tokens of either tokenizer don't
    give back byte by byte, have no tokens: zeros and an empty digest. Repeated
    rows are documents of their own; null ids stay null; other columns are
    ignored; an empty table gives no rows. Options: see ``bitmaps``.
    """
    maps = bitmaps(docs, **options)
    counts = pair_counts(maps).select("pair", "n_docs", "best")
    asked = maps.filter(F.col("pair").isNotNull()).select("chunk", "pair", "plane", "bits").join(counts, "pair")
    rows = (maps.filter(F.col("pos").isNotNull()).drop("pair", "plane", "bits")
            .unionByName(asked, allowMissingColumns=True))
    return rows.groupBy("chunk").applyInArrow(
        credit, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
