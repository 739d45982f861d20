"""op1 WARC, op3 licenses, op7 packing, op10 sharding."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import AWKWARD
from txnscope.llm import op1_warc, op3_licenses, op7_packing, op10_sharding
from txnscope.llm.common import shared_path


# ---------------------------------------------------------------- op1

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big, same = "<p>é</p>" * 20_000, "z" * 100
    rows = [(1, "u1", big), (5, "u\r\n2", same), (3, None, same), (4, "u4", same), (6, "u", "z" * 99), (7, "u", "z" * 99),
            (8, "u", None), (9, "u", ""), (None, "u", same), (10, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (3, "u", same)]
    got = [tuple(r) for r in op1_warc.warc_round_trip(spark, pages_of(spark, rows)).collect()]
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = 3 if h == same else i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_second_write_adds_and_overwrite_replaces(spark, tmp_path):
    records = op1_warc.page_records(pages_of(spark, [(i, "u", f"page {i} " * 30) for i in range(6)]))
    path = f"{tmp_path}/archive"
    ids = lambda: sorted(r[0] for r in op1_warc.read_archive(spark, path, "record_id string").collect())
    all_ids = sorted(r[0] for r in records.select("record_id").collect())
    op1_warc.write_archive(records.filter("target_uri is not null and record_id <= '" + all_ids[2] + "'"), path)
    op1_warc.write_archive(records.filter("record_id > '" + all_ids[2] + "'"), path)
    assert ids() == all_ids
    op1_warc.write_archive(records.filter("record_id = '" + all_ids[4] + "'"), path, mode="overwrite")
    assert ids() == [all_ids[4]]
    assert len([f for f in (tmp_path / "archive").iterdir() if f.name.endswith(".warc.gz")]) == 1


def test_warc_empty_table(spark):
    assert op1_warc.warc_round_trip(spark, pages_of(spark, [])).count() == 0


def test_warc_pushdown_and_foreign_files(spark, tmp_path):
    path = shared_path(spark, "t")
    op1_warc.write_archive(op1_warc.page_records(pages_of(spark, [(i, f"http://h/{i}", "y" * (100 + i % 2)) for i in range(20)])), path)
    cols = "record_id string, record_type string, target_uri string, content_length long"
    df = op1_warc.read_archive(spark, path, cols)
    some = df.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h/1") & (F.col("content_length") > 0))
    assert sorted(r.target_uri for r in some.collect()) == sorted(f"http://h/{i}" for i in (10, 11, 12, 13, 14, 15, 16, 17, 18, 19))
    assert df.filter(~F.col("record_type").isin("response")).count() == 18
    # a plain archive, and gzip members without skip lengths
    rec = [op1_warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<r:{i}>")], b"p" * i) for i in (0, 3, 70_000)]
    (tmp_path / "a.warc").write_bytes(b"".join(rec))
    import gzip
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rec))
    both = op1_warc.read_archive(spark, str(tmp_path), "record_id string, payload binary")
    assert sorted((r.record_id, len(r.payload)) for r in both.collect()) == sorted(2 * [("<r:0>", 0), ("<r:3>", 3), ("<r:70000>", 70_000)])
    assert op1_warc.read_archive(spark, str(tmp_path), "record_id string").count() == 6
    (tmp_path / "c.warc").write_bytes(rec[0] + b"broken")
    with pytest.raises(Exception, match="header|ends"):
        op1_warc.read_archive(spark, str(tmp_path), "record_id string").count()


def test_warc_unselected_bodies_stay_deflated(tmp_path):
    data = op1_warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<r>")], b"p" * 5_000_000)
    member = bytearray(op1_warc.gzip_member(data))
    member[2000:-8] = b"\xff" * (len(member) - 2008)  # the body can't be inflated
    good = op1_warc.gzip_member(op1_warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<s>")], b"x"))
    import io
    got = list(op1_warc.read_records(io.BytesIO(bytes(member) + good), lambda h: h["warc-type"] == "response", True))
    assert [(h["warc-record-id"], b) for h, b in got] == [("<s>", b"x")]


# ---------------------------------------------------------------- op3

def scan_brute(text):
    low = str.maketrans(op3_licenses.UPPER, op3_licenses.LOWER)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    starts, base = [], set()
    for phrase, label in op3_licenses.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                starts.append(k)
                base.add(label)
    labels, score = set(base), 0.0
    half = op3_licenses.BLOCK // 2
    for s in range(0, max(len(w) - 1 - half, 0) + 1, half):
        block = set(w[s:s + op3_licenses.BLOCK])
        found = {}
        for label, texts in op3_licenses.TEMPLATES.items():
            for t in texts:
                t = set(t.split())
                if len(t & block) >= np.ceil(0.8 * len(t) - 1e-9):
                    found[label] = max(found.get(label, 0), len(t & block) / len(t))
        if found:
            top = max(found.values())
            score = max(score, top)
            labels |= {x for x, c in found.items() if c == top}
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if starts else score)


def test_licenses_against_brute_force(spark, docs_of, words):
    notice = [t for ts in op3_licenses.TEMPLATES.values() for t in ts]
    rows = [*AWKWARD, (20, "CC-BY cc by Cc_By"), (21, "all rights reserved all rights reserved"), (22, "x" + "General Public License.")]
    for i in range(60):
        w = words(200, i)
        n = notice[i % len(notice)].split()
        if i % 3 == 0:
            n = n[:-1]
        rows.append((100 + i, " ".join(w[:i * 3] + n + w[i * 3:]).replace(" ", "\n" if i % 2 else " ").title()))
    df = docs_of(rows, ", labels string, score double, _s string", ("clash", 1.0, "x"))
    got = sorted((tuple(r) for r in op3_licenses.scan(df).drop("matches").collect()), key=str)
    assert got == sorted(((i, *scan_brute(t)) for i, t in rows), key=str)
    assert op3_licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [20, 60, 200])
def test_long_templates_are_found_anywhere(spark, docs_of, words, size):
    """A template of so many words, whole or with a tenth of it changed, at
    every kind of place; and a third of it, which is not enough."""
    t = sorted(set(words(3 * size, 5)), key=words(3 * size, 5).index)[:size]
    templates = {"long": [" ".join(t)], "mit": ["released under the mit license"]}
    rows, want = [], {}
    for i, at in enumerate([0, 1, 15, 16, 33, 64, 100, 131]):
        near = [w if k % 10 else f"x{k}" for k, w in enumerate(t)]
        for j, (part, labels) in enumerate(((t, "long"), (near, "long"), (t[:size // 3], ""))):
            rows.append((10 * i + j, " ".join([*words(at, i + 50), *part, *words(40, i + 900)])))
            want[10 * i + j] = labels
    rows.append((999, "released under the mit license"))
    got = {r.doc_id: (r.labels, r.score) for r in op3_licenses.scan(docs_of(rows), {"cc by": "cc-by"}, templates).collect()}
    assert {i: x[0] for i, x in got.items()} == {**want, 999: "mit"}
    assert all(got[10 * i][1] == 1.0 for i in range(8))


def test_phrases_that_overlap_themselves(spark, docs_of):
    got = op3_licenses.scan(docs_of([(1, "a a a a"), (2, "b a"), (3, "x a b a b a")]), {"a a": "aa", "a b a": "aba"}).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.last_word) for r in got) == [(1, 3, 0, 2), (2, 0, None, None), (3, 2, 1, 3)]


def test_licenses_stay_native(spark, docs_of):
    plan = op3_licenses.scan(docs_of([(1, "all rights reserved")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------- op7

def test_packing(spark, docs_of, words):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(op7_packing.default_tokenizer())
    rows = [*AWKWARD, (12, " " * 3000), (13, "<|endoftext|>\n\n  it's 've"), (14, "hello <|endoftext|> world")]
    rows += [(100 + i, " ".join(words(5 + 37 * i % 900, i))) for i in range(150)]
    rows.append((999, " ".join(words(9000, 3))))
    df = docs_of(rows, ", piece int, _key long, ids string", (1, 2, "x")).repartition(7)
    got = op7_packing.pack(df).collect()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, want in by_text.items():
        all_ids = sorted((p.start, p.piece, list(np.frombuffer(p.ids, "<u4"))) for p in pieces[i])
        if len(want) == 1:
            assert sum((x[2] for x in all_ids), []) == want[0]
            assert [x[1] for x in all_ids] == list(range(len(all_ids)))
            assert all(len(x[2]) == 2048 for x in all_ids[1:]) and (len(want[0]) > 2048) == (len(all_ids) > 1)
        else:
            assert [x[2] for x in all_ids] == want
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.length == len(r.ids) // 4
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    _, _, alone = op7_packing.best_fit(sorted((r.length for r in got), reverse=True), 2048)
    assert len(fill) <= 1.03 * len(alone) + 1
    digest = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in op7_packing.pack_digest(df).collect()}
    assert digest == {(r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got}
    assert op7_packing.pack_digest(df.limit(0)).count() == 0


def test_packing_merges_across_partitions(spark):
    """One small piece in each of 40 partitions: a single sequence."""
    df = spark.range(40, numPartitions=40).selectExpr("id as _key", "50L as length").repartition(40, "_key")
    from txnscope.llm.common import written
    out = op7_packing.place(written(df, "t")).collect()
    assert len({r.sequence_id for r in out}) == 1
    assert sorted(r.offset for r in out) == list(range(0, 2000, 50))


def test_best_fit_prefers_the_fullest_bin():
    assert op7_packing.best_fit([7, 6, 3, 3, 1], 10) == ([0, 1, 0, 1, 1], [0, 0, 7, 6, 9], [10, 10])


# ---------------------------------------------------------------- op10

def test_sharding(spark, docs_of, words):
    rows = [*AWKWARD] + [(100 + i, " ".join(words(i % 50, i))) for i in range(500)]
    df = docs_of(rows, ", size string, shard int, _at long", ("x", 3, 4)).repartition(5)
    got = op10_sharding.shard_by_bytes(df, 16).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    at, last = 0, None
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    for r in order:
        assert r.shard == at * 16 // total
        at += r.size
        assert r.slot == (last.slot + 1 if last is not None and last.shard == r.shard else 0)
        last = r
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) - total / 16 < biggest
    ids = [r.doc_id for r in order if r.doc_id is not None]
    assert ids == sorted(ids)  # contiguous in id order
    assert op10_sharding.shard_by_bytes(df.limit(0), 16).count() == 0
    plan = op10_sharding.shard_by_bytes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
