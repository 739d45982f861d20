"""op6 quality, op8 nearest neighbours, op9 language, the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.conftest import AWKWARD
from txnscope.llm import op6_quality, op8_ann, op9_langid


# ---------------------------------------------------------------- op6

def kneser_ney(texts):
    """Brute-force interpolated modified Kneser-Ney over characters."""
    top = op6_quality.ORDER
    counts = {top: Counter()}
    for t in texts:
        s = "\0" * (top - 1) + t
        counts[top].update(s[i:i + top] for i in range(len(t)))
    for o in range(top - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    vocabulary = len(counts[1]) + 1
    cut = {}
    for o, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 3 - 3 * y]
            cut[o] = [min(max(x, 0.01), i - 0.01) for i, x in enumerate(d, 1)]
        else:
            cut[o] = [0.5] * 3

    def p(g):
        if not g:
            return 1 / vocabulary
        o, ctx = len(g), g[:-1]
        same = [n for h, n in counts[o].items() if h[:-1] == ctx]
        if not same:
            return p(g[1:])
        n = counts[o][g]
        gamma = sum(cut[o][min(x, 3) - 1] for x in same) / sum(same)
        return (max(n - cut[o][min(n, 3) - 1], 0) / sum(same) if n else 0) + gamma * p(g[1:])

    return lambda t: sum(math.log(p(("\0" * (top - 1) + t)[i:i + top])) for i in range(len(t)))


def test_model_against_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(op6_quality, "SHARD_ROWS", 150)
    texts = [" ".join(words(12, i)) + "." for i in range(6)]
    model = op6_quality.write_model(op6_quality.train(spark.createDataFrame([(t,) for t in texts], "t string")))
    assert len(model.shards) > 8
    exact = kneser_ney(texts)
    ask = [texts[0], "new words here", "ZZ\tß日", "a"]
    total, n = op6_quality.text_scores(model, [*ask, None, ""])
    assert n.tolist() == [*map(len, ask), 0, 0]
    assert total[:4] == pytest.approx([exact(t) for t in ask], rel=1e-9)
    # probabilities of one context add up to 1
    chars = sorted({c for t in texts for c in t})
    assert sum(math.exp(exact("ab" + c) - exact("ab")) for c in chars) <= 1 + 1e-9


def test_blocks_do_not_change_scores(spark, words, monkeypatch):
    texts = [" ".join(words(40, i)) for i in range(8)]
    model = op6_quality.write_model(op6_quality.train(spark.createDataFrame([(t,) for t in texts], "t string")))
    whole = op6_quality.text_scores(model, texts)[0]
    monkeypatch.setattr(op6_quality, "BLOCK_CHARS", 57)
    monkeypatch.setattr(op6_quality, "CACHE_BYTES", 1000)
    assert op6_quality.text_scores(model, texts)[0] == pytest.approx(whole, rel=1e-12)


def quality_rows(words):
    rows = [*AWKWARD] + [(100 + i, " ".join(words(60, i)).capitalize() + ".") for i in range(150)]
    return rows + [(400 + i, " ### ".join(words(60, i)).upper()) for i in range(20)]


def test_classifier(spark, docs_of, words):
    rows = quality_rows(words)
    df = docs_of(rows, ", quality string, cal long, t string", ("x", 1, "y"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows if i and 100 <= i < 220] + [(110, 0, 0), (111, 1, 1), (400, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    trusted = op6_quality.trusted_rows(df.select("doc_id", "text"), labels)
    assert sorted(r.doc_id for r in trusted.collect()) == sorted({*range(100, 220)} - {110, 111})
    got = op6_quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    kept = Counter((r.doc_id, r.kept) for r in got)
    assert all(kept[i, False] for i in (1, 2)) and all(r.perplexity is None for r in got if r.doc_id in (1, 2))
    assert all(kept[400 + i, False] for i in range(20))
    assert sum(kept[100 + i, True] for i in range(150)) >= 148
    rest = op6_quality.good_documents(df, labels)
    assert rest.columns == df.columns
    assert sorted((r.doc_id for r in rest.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)
    assert op6_quality.classify(df.limit(0), labels).count() == 0
    alone = op6_quality.classify(df, labels.limit(0)).collect()
    assert all(r.kept == bool(t) for r, t in zip(sorted(alone, key=lambda r: str(r.doc_id)), [t for _, t in sorted(rows, key=lambda x: str(x[0]))], strict=True)
               if r.doc_id != 8)


# ---------------------------------------------------------------- op8

def nearest(vecs, k):
    out = {}
    for q, v in vecs:
        if q % 20 == 0:
            s = sorted((-float(np.dot(v, w)), i) for i, w in vecs if i != q)
            out[q] = s[:k]
    return out


def test_nearest_exact_when_all_are_reranked(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, (rng.normal(size=8) * (1 + i % 3)).astype(np.float32).astype(float)) for i in range(120)]
    vecs += [(200 + i, vecs[3][1]) for i in range(45)]  # a very common vector
    bad = [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] + [1.0] * 7), (580, [float("inf")] * 8),
           (600, [1.0] * 3), (620, []), (None, [1.0] * 8)]
    rows = [(i, [float(x) for x in v], 1, "x") for i, v in vecs] + [(i, v, 2, "y") for i, v in bad]
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = {}
    for r in op8_ann.search(df, block=32, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = nearest(vecs, 20)
    assert set(got) == set(want)
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [h[1] for h in hits] == [i for _, i in want[q]]
        assert [h[2] for h in hits] == pytest.approx([-s for s, _ in want[q]], rel=1e-12)
    assert op8_ann.search(df.limit(0)).count() == 0
    few = op8_ann.search(df.filter("vec_id in (0, 1, 20)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]


def test_recall(spark):
    """Unclustered unit vectors of 64 dimensions, the hardest case."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = {}
    for r in op8_ann.search(df, rerank_least=0).collect():
        hits.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q, got in hits.items():
        s = x @ x[q]
        s[q] = -9
        found += len(got & set(np.argsort(-s)[:20].tolist()))
    assert len(hits) == 300 and found >= 0.95 * 20 * 300


# ---------------------------------------------------------------- op9

def lang_rows():
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "eng", "ach"], "cc": ["é", "oi", "que"]}
    rows = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        t = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, t.capitalize() + ". 12", lang))
    return rows


def test_language(spark):
    rows = lang_rows()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? 34", "bb"), (None, "kalomi", None), (1003, "lo" * 300_000, None), (5, rows[5][1], "bb")]
    full = [(i, t, lang, "s", 1, True, "x") for i, t, lang in rows + odd]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, score string")
    got = op9_langid.identify(df).collect()
    assert len(got) == len(full)
    right = held = 0
    want = {i: lang for i, _, lang in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.held_out and r.doc_id in want:
            held += 1
            right += r.lang_pred == want[r.doc_id]
    assert held > 30 and right >= 0.97 * held
    assert {r.lang_pred for r in got if r.doc_id in (None, 1003)} == {"aa"}
    assert op9_langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in op9_langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()} == {"und"}


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    text = "Ab cde, fghij K éa! " * 30
    whole = np.sort(np.concatenate(list(op9_langid.subwords(text))))
    monkeypatch.setattr(op9_langid, "CHUNK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(op9_langid.subwords(text)))), whole)


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, words, tmp_path):
    import corpus_pipeline
    rng = random.Random(5)
    rows = [(i, " ".join(words(120, i)).capitalize() + ".") for i in range(120)]
    item, passage = " ".join(words(30, 900)), " ".join(words(80, 901))
    junk = [(200 + i, " ### ".join(words(60, i)).upper()) for i in range(10)]
    near = [(300, rows[4][1]), (301, " ".join("changed" if k == 7 else w for k, w in enumerate(rows[5][1].split())))]
    leak = [(310, rows[6][1][:200] + " " + item + " end")]
    rep = [(320 + c, " ".join(words(60, 700 + c)) + " " + passage + " " + " ".join(words(60, 750 + c))) for c in range(3)]
    all_rows = rows + junk + near + leak + rep + [(400, None), (401, "")]
    rng.shuffle(all_rows)
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in all_rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    quality, near_d, sub, dec = kept.values()
    assert not quality.keys() & {*range(200, 210), 400, 401} and len(quality.keys() & set(range(120))) >= 117
    assert quality.keys() - near_d.keys() == {300, 301} & quality.keys()
    assert sub.keys() == near_d.keys()
    assert passage in sub[320] and passage not in sub[321] and passage not in sub[322]
    assert near_d.keys() - dec.keys() == {310} & quality.keys()
    assert all(sub[i] == quality[i] for i in sub if i not in (321, 322, 310))
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(dec) and all(r.length <= 2048 for r in out)


def test_stages_with_null_and_repeated_ids(spark, docs_of, words, tmp_path):
    """Rows are told apart by more than their ids."""
    import corpus_pipeline
    text = [" ".join(words(100, 40 + i)) for i in range(6)]
    near = [" ".join("changed" if k == 7 else w for k, w in enumerate(t.split())) for t in text]
    rows = [(1, text[0]), (None, near[0]), (None, text[1]), (None, text[2]), (None, near[2]), (2, text[3]), (3, near[3]), (3, text[4]),
            (4, text[5]), (4, text[5]), (5, ""), (5, ""), (None, None), (None, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_of(rows).repartition(3), str(tmp_path)).collect()]
    one = [r for r in got if r in ((None, text[2]), (None, near[2]))]
    assert len(one) == 1
    want = [(1, text[0]), (None, text[1]), *one, (2, text[3]), (3, text[4]), (4, text[5]), (5, ""), (None, None), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)

    passage = " ".join(words(80, 50))
    a, b, c, d = (" ".join(words(60, 60 + i)) for i in range(4))
    rows = [(1, f"{a} {passage}"), (2, f"{b} {passage}"), (2, text[0]), (None, f"{c} {passage} {d}"), (None, text[1])]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, docs_of(rows).repartition(3), str(tmp_path)).collect()]
    want = [(1, f"{a} {passage}"), (2, f"{b} "), (2, text[0]), (None, f"{c} {d}"), (None, text[1])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_columns_with_clashing_names(spark, docs_of, words, tmp_path):
    """Extra columns come back as they were, whatever they are called."""
    import corpus_pipeline
    w = words(120, 1)
    rows = [(1, " ".join(w)), (2, " ".join([*words(80, 2), *w[:70], *words(80, 3)])), (3, " ".join(words(90, 4))), (4, " ".join(w))]
    names = ["_row", "_cut", "_id", "_none", "_tk", "_of", "component_id"]
    df = docs_of(rows, "".join(f", {c} string" for c in names), [f"v{i}" for i in range(len(names))])
    near = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    cut = corpus_pipeline.substring_dedup(spark, df, str(tmp_path))
    for out, ids in ((near, [1, 2, 3]), (cut, [1, 2, 3])):
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == ids
        assert all([r[c] for c in names] == [f"v{i}" for i in range(len(names))] for r in got)
