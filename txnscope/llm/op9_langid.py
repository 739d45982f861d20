"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy.

A text is the average of the embeddings of its subwords: all runs of 2 to 4
characters, hashed to ``BUCKETS`` rows, where everything but letters is one
boundary mark and a run may touch a boundary only at its ends. The whole text
counts. Training uses a bounded sample of labelled rows: per language the
``SAMPLE_PER_LANG`` rows with the smallest seeded hash of their id. Only
their subword counts (never their texts) go to the one training task. After
training, embeddings and softmax weights are folded into one score table of
``BUCKETS x languages``, which each task gets.

Probabilities are calibrated by a temperature fitted on a part of the sample
kept from training; ``rejected`` marks predictions below the score at which
that part reaches ``PRECISION``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIM = 16
PARTS = 64  # of a language's hashes
SAMPLE_PER_LANG = 1000  # labelled rows per language used for training
MAX_LANGS = 500
EPOCHS = 8
RATE = 0.5
BATCH = 8
PRECISION = 0.995
UNKNOWN = "und"
CHUNK = 1 << 18  # characters hashed at a time

_LETTER = None


def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _LETTER


def subwords(text: str):
    """Yield arrays of bucket numbers, one for each chunk and order; together
    they hold every subword of the text once per occurrence."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letter_table()[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    longest = max(ORDERS)
    with np.errstate(over="ignore"):
        for lo in range(0, len(codes), CHUNK):
            c = codes[lo:lo + CHUNK + longest - 1]
            for n in ORDERS:
                m = min(CHUNK, len(c) - n + 1)
                if m <= 0:
                    continue
                h = np.full(m, n, np.uint32)
                ok = np.ones(m, bool)
                for i in range(n):
                    x = c[i:i + m]
                    h = (h ^ x) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                    if 0 < i < n - 1:
                        ok &= x != 0
                if n == 2:
                    ok = (c[:m] != 0) | (c[1:1 + m] != 0)
                yield (h & np.uint32(BUCKETS - 1))[ok]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col) -> F.Column:
    """Rows kept from all learning: crc32 of the id's text divisible by 5; a
    null id counts as the empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(counts: list[np.ndarray], buckets: list[np.ndarray], y: np.ndarray, n_langs: int, seed: int = 0):
    """(score table BUCKETS x n_langs, bias, temperature, rejection score).

    counts/buckets: per document its distinct subword buckets and counts. Every fifth
    document is kept for calibration.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, n_langs))
    bias = np.zeros(n_langs)
    order = rng.permutation(len(y))
    kept = order[::5] if len(order) >= 10 else order
    fit = order[np.arange(len(order)) % 5 != 0] if len(order) >= 10 else order
    weights = [c / c.sum() for c in counts]
    steps = max(1, EPOCHS * -(-len(fit) // BATCH))
    step = 0
    square = np.full(BUCKETS, 1e-8)  # per-row squared gradients (adaptive rate)
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            docs = fit[lo:lo + BATCH]
            idx = np.concatenate([buckets[d] for d in docs])
            w = np.concatenate([weights[d] for d in docs])
            of = np.repeat(np.arange(len(docs)), [len(buckets[d]) for d in docs])
            ends = np.concatenate([[0], np.cumsum([len(buckets[d]) for d in docs])[:-1]])
            hidden = np.add.reduceat(emb[idx] * w[:, None], ends, axis=0)
            p = softmax(hidden @ out + bias)
            p[np.arange(len(docs)), y[docs]] -= 1
            p /= len(docs)
            back = p @ out.T
            out -= rate * 5 * hidden.T @ p
            bias -= rate * p.sum(axis=0)
            g = back[of] * w[:, None]
            np.add.at(square, idx, (g * g).sum(axis=1))
            np.subtract.at(emb, idx, 0.2 * rate * g / np.sqrt(square[idx])[:, None])
    table = emb @ out
    logits = np.array([(table[buckets[d]] * weights[d][:, None]).sum(axis=0) + bias for d in kept])
    truth = y[kept]
    grid = np.geomspace(0.05, 20, 60)
    doubt = 1 / (len(truth) + 2)  # the rule of succession: a faultless sample doesn't prove certainty
    target = np.full((len(truth), n_langs), doubt / n_langs)
    target[np.arange(len(truth)), truth] += 1 - doubt
    loss = [-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-top)
    share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(share >= PRECISION)
    reject_below = float(top[by][good[-1]]) if len(good) else 1.0
    return table.astype(np.float32), bias.astype(np.float32), temperature, reject_below


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _counts(batches):
    for pdf in batches:
        rows = []
        for lang, text in zip(pdf["lang"], pdf["t"], strict=True):
            total = np.zeros(BUCKETS, np.int64)
            for b in subwords(text):
                total += np.bincount(b, minlength=BUCKETS)
            idx = np.flatnonzero(total)
            if len(idx):
                rows.append((lang, idx.astype(np.int32), total[idx].astype(np.int32)))
        yield pd.DataFrame(rows, columns=["lang", "buckets", "counts"])


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> dict:
    """The model: {langs, table, bias, temperature, reject_below}. Rows that
    are held out, have no language, or no letter are not learned from. The
    sample is the ``sample_per_lang`` distinct texts of a language with the
    smallest hashes, however often an id or a text is repeated."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
            .filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("t").isNotNull())
            .withColumn("h", F.xxhash64(F.lit(9), "t")))
    # equal texts are one; each part of a language passes on its smallest hashes
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h")
    w = Window.partitionBy("lang").orderBy("h")
    cut = (rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(part)).filter(F.col("n") <= sample_per_lang)
           .withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample_per_lang)
           .groupBy("lang").agg(F.max("h").alias("cut")))
    cuts = cut.orderBy("lang").limit(MAX_LANGS + 1).collect()  # one row per language
    if len(cuts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not cuts:
        return {"langs": [], "table": None, "bias": None, "temperature": 1.0, "reject_below": 1.0}
    langs = [r["lang"] for r in cuts]
    chosen = F.lit(False)
    for r in cuts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.col("h") <= r["cut"]))
    sample = (rows.filter(chosen).groupBy("lang", "h").agg(F.first("t").alias("t")).select("lang", "t")
              .mapInPandas(_counts, "lang string, buckets array<int>, counts array<int>"))

    def learn(pdf):
        pdf = pdf.assign(k=[b[:64].tobytes() + bytes(str(len(b)), "ascii") for b in pdf["buckets"]]).sort_values(["lang", "k"])
        y = np.array([langs.index(x) for x in pdf["lang"]])
        table, bias, temperature, reject_below = train(
            [np.asarray(c, float) for c in pdf["counts"]], [np.asarray(b) for b in pdf["buckets"]], y, len(langs))
        return pd.DataFrame([(table.tobytes(), bias.tobytes(), temperature, reject_below)],
                            columns=["t", "b", "temperature", "reject_below"])

    # bounded: at most sample_per_lang rows of each language reach this task
    got = sample.groupBy(F.lit(1).alias("one")).applyInPandas(
        learn, "t binary, b binary, temperature double, reject_below double").collect()
    if not got:
        return {"langs": [], "table": None, "bias": None, "temperature": 1.0, "reject_below": 1.0}
    r = got[0]
    return {"langs": langs, "table": np.frombuffer(r["t"], np.float32).reshape(BUCKETS, len(langs)),
            "bias": np.frombuffer(r["b"], np.float32), "temperature": r["temperature"], "reject_below": r["reject_below"]}


def score_text(model: dict, text) -> tuple[str, float]:
    if not model["langs"] or not isinstance(text, str) or not has_letter(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model["langs"])), 0
    for b in subwords(text):
        total += np.bincount(b, minlength=BUCKETS) @ model["table"] if len(b) > BUCKETS else model["table"][b].sum(axis=0, dtype=float)
        n += len(b)
    p = softmax((total / max(n, 1) + model["bias"]) / model["temperature"])
    k = int(p.argmax())
    return model["langs"][k], float(min(1.0, p[k]))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row. Null
    texts and texts without a letter are ``und`` with score 0, rejected; so
    is every text if no language could be learned. Repeated rows and other
    columns have no effect; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x at most MAX_LANGS floats

    def run(batches):
        m = shared.value
        for pdf in batches:
            got = [score_text(m, t) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                                "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                                "rejected": [g[1] < m["reject_below"] or g[0] == UNKNOWN for g in got]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("t")).mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    return predict(docs, fit(docs, sample_per_lang))
