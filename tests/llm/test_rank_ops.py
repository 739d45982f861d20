"""op11 exact top-k, op12 tokenizer alignment, op13 lexical search."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import AWKWARD
from txnscope.llm import op11_topk, op12_align, op13_search
from txnscope.llm.blocks import in_blocks

# ---------------------------------------------------------------- op11


def vectors_of(spark, rows, extra="", values=()):
    return spark.createDataFrame([(i, v, *values) for i, v in rows], "vec_id long, embedding array<double>" + extra)


def top_brute(rows, k, every, scale=1024):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ints = {}
    for i, v in ok:
        w = tuple(math.floor(scale * x) for x in v)
        ints[i] = min(ints.get(i, w), w)
    sizes = Counter(len(w) for w in ints.values())
    dim = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    ints = {i: w for i, w in ints.items() if len(w) == dim}
    out = []
    for q in ints:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


AWKWARD_VECTORS = [(None, [1.0] * 6), (1000, None), (1001, []), (1002, [float("nan")] + [1.0] * 5), (1003, [float("inf")] + [0.0] * 5),
                   (1004, [1.0, None] + [0.0] * 4), (1100, [1.0] * 5), (1200, [0.0] * 6), (0, [0.5] * 6), (0, [-0.5] * 6), (7, [1.0] * 6),
                   (7, [1.0] * 6), (-100, [-3.0] * 6)]


@pytest.mark.parametrize("n_slices,pass_numbers", [(1, 1 << 20), (2, 1 << 20), (3, 12), (9, 1 << 20)])
def test_top_k_against_brute_force(spark, n_slices, pass_numbers):
    rng = np.random.default_rng(n_slices)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(1, 400)]
    rows += [(2000 + i, [0.25] * 6) for i in range(150)]  # one common vector, queries among its copies
    rows += AWKWARD_VECTORS
    df = vectors_of(spark, rows, ", score int, _n int, entry string", (1, 2, "x")).repartition(5)
    got = sorted(tuple(r) for r in op11_topk.search(df, 10, 50, n_slices=n_slices, pass_numbers=pass_numbers).collect())
    assert got == top_brute(rows, 10, 50)


def test_top_k_of_negative_and_tiny_tables(spark):
    rows = [(i, [-1.0 - i, -2.0]) for i in range(0, 6)] + [(100, [1.0, 2.0])]
    for part in (rows, rows[:1], rows[:2]):
        got = sorted(tuple(r) for r in op11_topk.search(vectors_of(spark, part), 10, 100).collect())
        assert got == top_brute(part, 10, 100)
    assert op11_topk.search(vectors_of(spark, rows).limit(0)).count() == 0
    assert op11_topk.search(vectors_of(spark, [(100, [float("nan")])])).count() == 0


def test_top_k_beyond_exact_doubles(spark):
    """Products whose sums are not exact as doubles."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-(1 << 19), 1 << 19, 8) + rng.random(8)).tolist()) for i in range(300)]
    got = sorted(tuple(r) for r in op11_topk.search(vectors_of(spark, rows), 10, 100).collect())
    assert got == top_brute(rows, 10, 100)


def test_blocks_are_bounded(spark):
    from pyspark.sql import functions as F
    df = spark.range(500).selectExpr("id", "case when id = 7 then 900L else 10L end as n")
    rows, n = in_blocks(df, ["id"], F.col("n"), 100, "t")
    by = rows.groupBy("_block").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()
    assert rows.count() == 500 and all(r.s <= 100 or r.c == 1 for r in by) and max(r["_block"] for r in by) < n
    assert in_blocks(df, ["id"], F.col("n"), 10_000, "t")[1] == 1


# ---------------------------------------------------------------- op12

def token_bytes():
    from tokenizers import Tokenizer
    from sentencepiece import SentencePieceProcessor
    a = Tokenizer.from_file(op12_align.default_tokenizer())
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    with open(op12_align.default_tokenizer(), encoding="utf-8") as f:
        vocab = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if not t.startswith("<|")}
    b = SentencePieceProcessor(model_file=op12_align.default_pieces())

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = [(i, vocab[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(p for _, p in x) == whole == b"".join(p for _, p in y) else ([], [])
    return encode


def align_brute(rows):
    encode, docs, holds = token_bytes(), [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        sides = []
        for side in encode(text):
            at, spans = 0, []
            for i, p in side:
                spans.append((i, at, at + len(p)))
                at += len(p)
            sides.append(spans)
        a, b = sides
        links, j0 = [], 0
        for i, lo, hi in a:
            while j0 < len(b) and b[j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < hi:
                links.append((i, b[j][0]))
                j += 1
        groups, ends = [], sorted({e for _, _, e in a} & {e for _, _, e in b})
        ia = ib = 0
        for e in ends:
            x, y = [], []
            while ia < len(a) and a[ia][2] <= e:
                x.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= e:
                y.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        for pair in links:
            holds[pair].add(n)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = {p: len(d) for p, d in holds.items()}
    best, times = defaultdict(int), Counter(p for d in docs for p in d[4])
    for (i, _), c in count.items():
        best[i] = max(best[i], c)
    out = [(i, a, b, g, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), sha) for i, a, b, g, ls, sha in docs]
    return out, count, times


ODD_TEXTS = [(50, "a  b\n\nc <s> d  "), (51, "<|endoftext|> and <unk> </s>"), (52, "▁ mark"), (53, " leading"), (54, "café 日本語 \U0001f600"),
             (55, " nbsp　wide"), (56, "ﬁ ligature ①"), (57, "tab\there\r\n"), (58, " "), (59, "x" * 3000), (60, "the the the the " * 400)]


def str_order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("chunk_links", [op12_align.CHUNK_LINKS, 500])
def test_alignment_against_brute_force(spark, docs_of, words, chunk_links):
    rows = [*AWKWARD, *ODD_TEXTS] + [(100 + i, " ".join(words(3 + 5 * i, i)).capitalize() + ".") for i in range(60)]
    rows += [(300 + i, "All rights reserved, the same line.") for i in range(40)]
    df = docs_of(rows, ", chunk long, pos int, n_a string, pair int", (1, 2, "x", 3)).repartition(4)
    want, count, times = align_brute(rows)
    got = [tuple(r) for r in op12_align.align(df, chunk_links=chunk_links).collect()]
    assert str_order(got) == str_order(want)
    if chunk_links == 500:
        maps = op12_align.bitmaps(df, chunk_links=chunk_links)
        assert maps.select("chunk").distinct().count() > 10
        pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in op12_align.pair_counts(maps).collect()}
        assert pairs == {p: (count[p], times[p]) for p in count}
    assert op12_align.align(df.limit(0)).count() == 0


def test_compressed_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    want = {5: [0], 9: sorted(rng.choice(8192, 511, False)), 11: sorted(rng.choice(8192, 512, False)), 12: list(range(8192)), 40: [8191]}
    pair, pos = np.repeat(list(want), [len(v) for v in want.values()]), np.concatenate(list(want.values()))
    keys, bits = op12_align.compressed(pair, pos)
    assert keys.tolist() == list(want) and max(len(b.as_py()) for b in bits) == op12_align.BITS_BYTES
    for part in (bits, bits[2:], bits[3:4]):
        row, at = op12_align.places(part)
        first = len(bits) - len(part) if len(part) != 1 else 3
        for n in range(len(part)):
            assert sorted(at[row == n]) == list(want[keys[first + n]])
    keys, bits = op12_align.compressed(np.empty(0, np.int64), np.empty(0, np.int64))
    assert len(keys) == len(bits) == len(op12_align.places(bits)[0]) == 0


# ---------------------------------------------------------------- op13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_brute(rows, items, k):
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    split = lambda t: WORD.findall((t or "").translate(low))
    docs = [(i, Counter(split(t))) for i, t in rows if split(t)]
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        found = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * len(docs)) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out += [(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(found)[:k])]
    return str_order(out)


@pytest.mark.parametrize("pass_bytes", [op13_search.PASS_BYTES, 300])
def test_search_against_brute_force(spark, docs_of, pass_bytes):
    rng = random.Random(4)
    pool = ["a", "an", "ant", "anthem", "them", "the", "x1", "é", "日本", "b_c", "na-ïve", "Z", "rare"] + [f"w{i}" for i in range(60)]
    rows = [*AWKWARD, (30, "the the THE the"), (31, "anthem"), (32, "an ant; them_a"), ((1 << 60) + 1, "rare é")]
    rows += [(100 + i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(pool, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [(500 + i, "the same text for many") for i in range(60)]  # ties
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "..."), (43, "nowhere to be found"), (44, "the the the many"), (44, "the the the many"), (None, "the"),
              (45, "the"), (45, "rare")]
    df = docs_of(rows, ", rank int, score string, item_id long", (1, "x", 2)).repartition(6)
    bench = spark.createDataFrame([(*i, 5, "y") for i in items], "item_id long, text string, doc_id long, _block string")
    got = str_order(tuple(r) for r in op13_search.search(df, bench, 20, pass_bytes=pass_bytes).collect())
    assert got == search_brute(rows, items, 20)
    assert op13_search.search(df.limit(0), bench).count() == 0
    assert op13_search.search(df, bench.limit(0)).count() == 0


def test_sums_stay_exact():
    from txnscope.llm.common import exact_sums
    value = np.array([(1 << 53) + 1, 1, (1 << 58) + 3, 7], np.int64)
    assert exact_sums(np.array([0, 0, 2, 2]), value, 4).tolist() == [(1 << 53) + 2, 0, (1 << 58) + 10, 0]
    assert exact_sums(np.empty(0, np.int64), np.empty(0, np.int64), 2).tolist() == [0, 0]
