"""op2 near-duplicates, op4 passages, op5 decontamination."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from llm.conftest import AWKWARD
from txnscope.llm import op2_neardup, op4_substrings, op5_decontam
from txnscope.llm.common import mix
from txnscope.llm.components import components


def edited(w, n, seed):
    rng = random.Random(seed)
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{seed}x{i}"
    return w


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        if not sets[a]:
            out.append((i, 0, i, True))
            continue
        ids = [rows[b][0] for b in range(len(rows)) if sets[b] and find(b) == find(a) and rows[b][0] is not None]
        c = min(ids, default=None)
        out.append((i, len(sets[a]), c, i == c))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_against_brute_force(spark, docs_of, words, k, num, den):
    rows = [*AWKWARD, (40, "A b\vC d\te"), (41, "a B c\fd e"), (None, "p q r s t u v"), (None, "p q r s t u v")]
    for g in range(25):
        base = words(60 + 9 * g, g)
        for c in range(6):
            rows.append((1000 - 10 * g + c, " ".join(edited(base, (c * len(base)) // 100, 10 * g + c))))
    long = words(4000, 99)
    rows += [(2000 + c, " ".join(edited(long, 5 * c, c))) for c in range(4)]
    df = docs_of(rows, ", digest string, cid long, component_id long", ("x", 1, 2)).repartition(5)
    got = [tuple(r) for r in op2_neardup.near_duplicates(df, k, num, den).collect()]
    assert order(got) == order(near_brute(rows, k, num, den))
    assert op2_neardup.near_duplicates(df.limit(0), k, num, den).count() == 0


def test_near_duplicates_in_several_blocks(spark, docs_of, words, monkeypatch):
    """A chain of small edits in one large group, cut into many blocks."""
    monkeypatch.setattr(op2_neardup, "BLOCK", 16)
    w = words(120, 1)
    rows = []
    for i in range(90):
        w = edited(w, 1, i)
        rows.append((i, " ".join(w)))
    got = [tuple(r) for r in op2_neardup.near_duplicates(docs_of(rows), 3, 85, 100).collect()]
    assert order(got) == order(near_brute(rows, 3, 85, 100))


def test_tensored_recall():
    """Sets at the threshold meet as often as promised."""
    m = op2_neardup.n_keys(0.85)
    assert (1 - (1 - 0.85 ** 3) ** m) ** 2 >= op2_neardup.RECALL
    keys, rng, met = op2_neardup.TensoredKeys(m), np.random.default_rng(0), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1085, dtype=np.uint64)
        s, t = x[:1000 + 85], np.concatenate([x[:919 + 78], rng.integers(0, 1 << 63, 88, dtype=np.uint64)])
        (a, b), (c, d) = keys.of(np.unique(s)), keys.of(np.unique(t))
        met += bool((a == c).any() and (b == d).any())
    assert met >= 299


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (*range(100, 130), 200)}}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# ---------------------------------------------------------------- op4

def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for n, t, values in ((30, 5, 1000), (40, 46, 9), (60, 7, 4), (50, 1, 50), (46, 46, 1000)):
        x = rng.integers(0, values, n, dtype=np.uint64)
        if n < t:
            continue
        left, c, right = op4_substrings.compact_windows(x, 0, t)
        with np.errstate(over="ignore"):
            h = mix(x + np.uint64(0xD1342543DE82EF95))
        low = np.uint64((1 << 28) - 1)
        ranked = ((h & ~low) | np.arange(n, dtype=np.uint64)).tolist()
        want = {}
        for s in range(n):
            for e in range(s + t, n + 1):
                want.setdefault(min(range(s, e), key=lambda i: ranked[i]), []).append((s, e - 1))
        assert c.tolist() == sorted(want)
        for lo, i, hi in zip(left.tolist(), c.tolist(), right.tolist(), strict=True):
            assert (lo, hi) == (min(s for s, _ in want[i]), max(e for _, e in want[i]))


def passage_rows(words):
    p, q, short = words(70, 500), words(120, 501), words(45, 502)
    rows = [(i, " ".join(words(80, i) + (p if i % 3 == 0 else []) + words(60, 1000 + i) + (q if i % 4 == 1 else []) + (short if i % 5 == 0 else [])))
            for i in range(60)]
    rows.append((60, " ".join(words(50, 61) + edited(q, 2, 9) + words(50, 62))))
    rows += [(70, "copy " * 10 + " ".join(words(100, 70))), (71, "copy " * 10 + " ".join(words(100, 70)))]
    return rows, p, q


def test_passages(spark, docs_of, words, monkeypatch):
    rows, p, q = passage_rows(words)
    df = docs_of([*AWKWARD[:6], *[(i + 10, t) for i, t in rows]], ", d long, start_word int", (1, 2)).repartition(4)
    got = op4_substrings.repeated_passages(df).collect()
    spans = {}
    for r in got:
        assert r.ref_doc_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
        spans.setdefault(r.doc_id - 10, []).append((r.start_word, r.end_word))

    def covered(i, w, passage):
        at = next(k for k in range(len(w)) if w[k:k + len(passage)] == passage)
        return set(range(at, at + len(passage))) <= {k for s, e in spans.get(i, []) for k in range(s, e)}

    text = {i: t.split() for i, t in rows}
    for i in range(60):
        if i % 3 == 0 and i:
            assert covered(i, text[i], p)
        if i % 4 == 1 and i > 1:
            assert covered(i, text[i], q)
        if i % 3 and i % 4 != 1:
            assert i not in spans  # clean, or a repeat shorter than 50 words
    assert 0 not in spans and 1 not in spans and 60 in spans and spans[71] == [(0, 110)] and 70 not in spans
    cut = {r.doc_id: r for r in op4_substrings.without_repeats(df.filter("doc_id is not null and doc_id >= 10"), op4_substrings.repeated_passages(df)).collect()}
    assert 81 not in cut and cut[80].text == text_of(rows, 70)  # nothing is left of a copy
    assert cut[13].text == " ".join(text[3][:80] + text[3][150:]) and cut[13].n_chars == len(cut[13].text)
    assert cut[10].text == text_of(rows, 0)
    assert op4_substrings.repeated_passages(df.limit(0)).count() == 0


def text_of(rows, i):
    return dict(rows)[i]


def test_passages_beyond_the_star(spark, docs_of, words, monkeypatch):
    """Texts share a line with the group's smallest document, but the long
    passage only with each other: the blocks find it."""
    monkeypatch.setattr(op4_substrings, "BLOCK", 4)
    line, rows = words(9, 7), []
    for i in range(24):
        rows.append((i, " ".join(words(40, i) + line + words(40, 50 + i))))
    for g in range(5):
        p = words(25, 900 + g) + line + words(30, 950 + g)
        rows += [(100 + 10 * g + c, " ".join(words(30, 300 + 10 * g + c) + p + words(30, 400 + 10 * g + c))) for c in range(3)]
    got = {(r.doc_id, r.ref_doc_id) for r in op4_substrings.repeated_passages(docs_of(rows)).collect()}
    for g in range(5):
        assert {(100 + 10 * g + 1, 100 + 10 * g), (100 + 10 * g + 2, 100 + 10 * g)} <= got
    assert all(a >= 100 and a // 10 == b // 10 for a, b in got)


def best_similarity(x, y, t):
    """The best Jaccard similarity of all pairs of spans of t places or more,
    from a token they share to a token they share, for texts of distinct tokens."""
    place, mate = {b: j for j, b in enumerate(y)}, {a: i for i, a in enumerate(x)}
    mate = np.array([mate.get(b, -1) for b in y])
    m = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x):
        if a in place:
            m[i + 1, place[a] + 1] = 1
    m = m.cumsum(0).cumsum(1)
    u, v = (q + z for q, z in zip(np.triu_indices(len(y) + 1 - t), (0, t), strict=True))
    best = 0.0
    for s in range(len(x) + 1 - t):
        for e in range(s + t, len(x) + 1):
            ends = [place.get(x[s], -1), place.get(x[e - 1], -1)]
            ok = (u <= min(ends)) & (max(ends) < v) & (np.minimum(mate[u], mate[v - 1]) >= s) & (np.maximum(mate[u], mate[v - 1]) < e)
            both = m[e, v] - m[s, v] - m[e, u] + m[s, u]
            best = max(best, float((both / (e - s + v - u - both))[ok].max(initial=0)))
    return best


def tokens(w):
    return op4_substrings.tokens_of(" ".join(w), op4_substrings.WordHashes())


@pytest.mark.parametrize("inserted", [1, 4, 6, 8, 12, 20])
def test_passages_with_one_place_edited(words, inserted):
    t, hit, want = 46, 0, 0
    for n in (52, 64, 80, 98):
        p = words(n, 600 + n)
        for at in (n // 4, n // 2):
            for drop in (0, inserted):  # inserted, or in the place of others
                q = p[:at] + words(inserted, 700 + inserted) + p[at + drop:]
                x, y = tokens(words(8, 1) + p + words(8, 2)), tokens(words(8, 3) + q + words(8, 4))
                assert len(set(x.tolist())) == len(x) and len(set(y.tolist())) == len(y)
                for a, b in ((x, y), (y, x)):
                    best = best_similarity(a.tolist(), b.tolist(), t)
                    got = op4_substrings.passages(a, b, t, 0.8)
                    if best >= 0.81:
                        assert got, (n, at, drop, inserted, best)
                        want += 1
                    assert best >= 0.8 or not got
                    for s, e, u, v, sim in got:
                        assert e - s >= t and v - u >= t and sim >= 0.8
                        assert sim == op4_substrings.jaccard(a[s:e], b[u:v])
    assert want


def test_passages_of_lines_side_by_side(words):
    """Shared lines that stand apart in the other text don't hide a passage."""
    a, b, c = words(60, 801), words(60, 802), words(30, 803)
    x = tokens(words(20, 1) + a + b + c + words(20, 2))
    y = tokens(words(30, 3) + b + words(90, 4) + c + words(70, 5) + a + words(10, 6))
    assert [q[:2] for q in sorted(op4_substrings.passages(x, y, 46, 0.8))] == [(20, 76), (80, 136)]


def test_recall_of_compound_keys():
    """Pairs of passages at a similarity of exactly 0.8: 5 of 45 tokens differ."""
    rng, t, missed = np.random.default_rng(5), 45, 0

    def keys(x):
        parts = [(np.full(len(w[1]), f), *w) for f in range(op4_substrings.HASHES) for w in [op4_substrings.compact_windows(x, f, t)]]
        return op4_substrings.compound(*(np.concatenate(q) for q in zip(*parts, strict=True)), x, t)[0]

    for _ in range(2000):
        x = rng.integers(0, 1 << 62, t).astype(np.uint64)
        y = x.copy()
        y[rng.choice(t, 5, replace=False)] = rng.integers(0, 1 << 62, 5).astype(np.uint64)
        missed += not len(np.intersect1d(keys(x), keys(y)))
    assert missed <= 3


def test_spans_are_the_longest():
    rng = np.random.default_rng(6)
    for _ in range(300):
        hit, t = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.9]), int(rng.integers(1, 12))
        share = float(rng.choice([0.8, 0.85, 8 / 9, 1.0]))
        c = np.concatenate([[0], np.cumsum(hit)])
        ok = [(s, e) for s in np.flatnonzero(hit).tolist() for e in (np.flatnonzero(hit) + 1).tolist()
              if e - s >= t and c[e] - c[s] >= share * (e - s) - 1e-9]
        want = [(s, e) for s, e in ok if not any(a <= s and e <= b and (a, b) != (s, e) for a, b in ok)]
        assert op4_substrings.spans(hit, share, t) == want


def test_found_passages_are_not_narrowed_again(words, monkeypatch):
    """Texts with many passages in common: spans inside a passage already found are left."""
    x, y = words(10, 1), words(10, 2)
    for i in range(12):
        p = words(120, 820 + i)
        x, y = x + p + words(9, 840 + i), p[:60] + ["edit"] + p[60:] + words(9, 860 + i) + y
    searched, spans = [], op4_substrings.spans
    monkeypatch.setattr(op4_substrings, "spans", lambda *a: searched.append(1) or spans(*a))
    got = op4_substrings.passages(tokens(x), tokens(y), 46, 0.8)
    covered = {k for a, b, *_ in got for k in range(a, b)}
    assert all(covered.issuperset(range(10 + 129 * i, 10 + 129 * i + 56)) for i in range(12))
    assert len(searched) < 800  # 1,607 when all were narrowed


def test_a_text_in_several_pairs_is_read_once(words, monkeypatch):
    read, tokens_of = [], op4_substrings.tokens_of
    monkeypatch.setattr(op4_substrings, "tokens_of", lambda text, hashes: read.append(text) or tokens_of(text, hashes))
    texts = [" ".join(words(8, 880 + i) + words(80, 879)) for i in range(6)]
    pairs = pd.DataFrame([(d, 0, texts[d], texts[0]) for d in range(1, 6)], columns=["d", "p", "x", "y"])
    got = pd.concat(op4_substrings._verify_pairs(46, 0.8)([pairs[:2], pairs[2:]]))
    assert sorted(zip(got["d"], got["p"], got["ds"], got["ps"])) == [(d, 0, 8, 8) for d in range(1, 6)]
    assert sorted(read) == sorted(texts)  # ten times when each pair read both


def test_a_pair_of_spans_is_compared_once(words, monkeypatch):
    compared, jaccard = [], op4_substrings.jaccard
    monkeypatch.setattr(op4_substrings, "jaccard", lambda x, y: compared.append((x.tolist(), y.tolist())) or jaccard(x, y))
    p, one = words(120, 890), words(1, 891)
    x, y = words(9, 892) + p + words(6, 893) + one + p[:5], words(9, 894) + p[:60] + ["edit"] + p[60:] + words(7, 895) + p[:5]
    got = op4_substrings.passages(tokens(x), tokens(y), 46, 0.8)
    assert got and len(compared) <= 8  # 24 when every share's spans were compared


def test_blocks_go_on_over_batches(words):
    """Rows of one pair of blocks in several batches are one pair; groups stay apart."""
    rows = []
    for g in range(4):
        p = words(90, 900 + g)
        for d in range(5):
            xs = tokens(words(6, 910 + 10 * g + d) + p)
            rows.append((g, 0, 0, 100 * g + d, 0, 0, xs.tobytes()))
    pdf = pd.DataFrame(rows, columns=["g", "b0", "b1", "d", "block", "at", "xs"])
    run = op4_substrings._verify_blocks(46, 0.8)
    whole, cut = (pd.concat(run(iter(q))) for q in ([pdf], [pdf[:2], pdf[2:3], pdf[3:11], pdf[11:11], pdf[11:]]))
    want = [(100 * g + d, 100 * g) for g in range(4) for d in range(1, 5)]
    assert sorted(zip(whole["d"], whole["p"])) == want
    assert sorted(whole.itertuples(index=False)) == sorted(cut.itertuples(index=False))


def test_groups_are_joined_part_by_part(spark, docs_of, words, monkeypatch):
    """The passages don't depend on the number of parts, whose files go."""
    rows = []
    for i in range(4):
        p = words(70, 930 + i)
        rows += [(10 * i + k, " ".join(words(12, 940 + 10 * i + k) + p + words(12, 990 + 10 * i + k))) for k in range(3)]
    docs = docs_of(rows)
    one = sorted(op4_substrings.repeated_passages(docs).collect())
    steps, each = [], op4_substrings.each
    monkeypatch.setattr(op4_substrings, "each", lambda parts, step: steps.append(parts) or each(parts, step))
    turns, in_turns = [], op4_substrings.in_turns
    monkeypatch.setattr(op4_substrings, "in_turns", lambda rows, key, most, step: in_turns(rows, key, most, lambda *a: turns.append(key) or step(*a)))
    monkeypatch.setattr(op4_substrings, "PART_ROWS", 50)
    monkeypatch.setattr(op4_substrings, "TURN_PAIRS", 4)
    monkeypatch.setattr(op4_substrings, "TURN_UNITS", 4)
    assert sorted(op4_substrings.repeated_passages(docs).collect()) == one and len(one) == 8
    assert len(steps) == 4 and all(len(parts) > 3 for parts in steps) and turns.count("d") >= 3
    assert not any(os.path.exists(path.removeprefix("file:")) for parts in steps for q in parts for path in q._written_paths)


def test_cut_spans():
    assert op4_substrings.cut_spans("a b\n c d", [(1, 3)]) == "a d"
    assert op4_substrings.cut_spans(" a b", [(0, 2)]) == " "
    assert op4_substrings.cut_spans("a b c d e", [(0, 2), (1, 3), (4, 5)]) == "d "


# ---------------------------------------------------------------- op5

def smith_waterman(a, b):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, s, e = op5_decontam.align(a, b)
        assert round(score * 2 * len(a)) == smith_waterman(a, b)
        if score:
            assert round(score * 2 * len(a)) == smith_waterman(a, b[s:e])


def test_decontamination(spark, docs_of, words):
    items = [(i, " ".join(words(15 + i, 5000 + i))) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (0, " ".join(words(15, 5000)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = dict(items[:30])
    rows, leaks = [*AWKWARD[:6]], {}
    for i in range(90):
        w = words(200, i)
        if i % 3 == 0:  # exact, changed case and punctuation, or every sixth word replaced
            item = text[i // 3].split()
            if i % 2:
                item = [x.upper() + "," for x in item]
            elif i % 4 == 0:
                item = [f"new{k}" if k % 6 == 5 else x for k, x in enumerate(item)]
            w = w[:i] + item + w[i:]
            leaks[100 + i] = i // 3
        rows.append((100 + i, " ".join(w)))
    df = docs_of(rows, ", item_id long, score string", (1, "x")).repartition(4)
    got = op5_decontam.contaminated(df, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == leaks
    for r in got:
        assert r.end_word - r.start_word >= 0.8 * len(text[r.item_id].split())
    kept = op5_decontam.decontaminated(df, bench)
    assert kept.columns == df.columns
    key = lambda r: str(tuple(r))
    assert sorted((r for r in kept.collect()), key=key) == sorted((r for r in df.collect() if r.doc_id not in leaks), key=key)
    assert op5_decontam.contaminated(df, bench.limit(0)).count() == 0 and op5_decontam.contaminated(df.limit(0), bench).count() == 0
    assert op5_decontam.decontaminated(df, bench.limit(0)).count() == df.count()


def test_decontamination_in_several_blocks(spark, docs_of, words, monkeypatch):
    monkeypatch.setattr(op5_decontam, "BLOCK_WORDS", 40)
    items = [(i, " ".join(words(20, 7000 + i))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of([(i, f"start {t} end") for i, t in items] + [(50, "clean text")])
    assert {(r.doc_id, r.item_id) for r in op5_decontam.contaminated(df, bench).collect()} == {(i, i) for i in range(6)}
    assert [r.doc_id for r in op5_decontam.decontaminated(df, bench).collect()] == [50]


def edited_leaks(words):
    """(items, documents): every item only as edited copies."""
    rng = random.Random(3)
    items, rows = [], []
    for phase in range(6):  # every sixth word replaced, in every phase
        w = words(40, 8000 + phase)
        items.append(w)
        rows.append([f"p{phase}x{k}" if k % 6 == phase else x for k, x in enumerate(w)])
    w = words(8, 8100)  # one word in the middle
    items.append(w)
    rows.append([*w[:3], "other", *w[4:]])
    w = words(40, 8101)  # a word inserted after every second one, and after every one
    items += [w]
    rows += [[y for k, x in enumerate(w) for y in ([x, f"i{k}"] if k % 2 else [x])], [y for k, x in enumerate(w) for y in (x, f"j{k}")]]
    w = words(39, 8102)  # every third word deleted
    items.append(w)
    rows.append([x for k, x in enumerate(w) if k % 3])
    for n in range(40):
        w = words(rng.randint(3, 30), 8200 + n)
        items.append(w)
        for share in (0.1, 0.2, 0.3, 0.4):
            out = []
            for k, x in enumerate(w):
                out += rng.choice([[], [f"r{n}x{k}"], [x, f"r{n}x{k}"]]) if rng.random() < share else [x]
            rows.append(out)
    frequent = ["and", "of", "the"]
    rows = [words(20, 9000 + i) + rng.choices(frequent, k=20) + r + rng.choices(frequent, k=5) for i, r in enumerate(rows)]
    return [" ".join(w) for w in items], [" ".join(r) for r in rows]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_edited_leaks_against_brute_force(spark, docs_of, words, threshold):
    items, texts = edited_leaks(words)
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a, b = item.split(), t.split()
            if 2 * len(set(a) & set(b)) and smith_waterman(a, b) >= threshold * 2 * len(a):
                want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(list(enumerate(texts)))
    assert len(want) > 40
    assert {(r.doc_id, r.item_id) for r in op5_decontam.contaminated(df, bench, threshold).collect()} == want
    if threshold == 0.5:
        assert {(i, i) for i in range(8)} <= want
        assert {r.doc_id for r in op5_decontam.decontaminated(df, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
        twice = docs_of([(1, f"{items[0]} {items[0]}")])
        assert [(r.start_word, r.end_word) for r in op5_decontam.contaminated(twice, bench).orderBy("start_word").collect()] == [(0, 40), (40, 80)]
