"""Quality classifier: an interpolated modified Kneser-Ney language model of
trusted text; documents whose perplexity exceeds a quantile of their
language's trusted documents are rejected.

The model's units are characters (case and punctuation tell prose from
boilerplate, and no word is unknown), in n-grams up to ``ORDER``. An n-gram
is an exact 64-bit key: 12 bits a character; characters beyond U+0FBF share
63 classes. Training counts n-grams in the tasks, adds them up by key, gets
the lower orders' continuation counts, Chen and Goodman's three discounts of
each order, and by joins of counts with context totals and with the next
lower order the interpolated probabilities. All trusted rows train, but
those kept for calibration.

Scoring is a sharded count join: the model is a table in the shared folder,
cut into shards by order and key range. A task takes a block of documents,
reduces its n-grams to distinct keys, and joins them with one shard after
another, from the highest order down; what an order lacks goes on to the
next with the context's weight. A task holds one block and at most
``CACHE_BYTES`` of shards, however large model and corpus are, and the
documents are never shuffled.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscope.llm.common import shared_path, written
from txnscope.llm.op1_warc import open_fs

ORDER = 5
BITS = 12
DIRECT = 4032  # characters below stand for themselves
START = 4095
QUANTILE = 0.995
MARGIN = 1.15  # the limit over the quantile, which few calibration rows estimate badly
PRIOR_CHARS = 60  # a short text's mean is drawn to the corpus mean as if it had so many more characters
BLOCK_CHARS = 2_000_000
SHARD_ROWS = 1_000_000
CACHE_BYTES = 128 << 20
NO_LANG = "und"


def char_codes(text: str) -> np.ndarray:
    """Codes of the characters behind ORDER - 1 start marks."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp = np.where(cp < DIRECT, cp, DIRECT + cp % 63)
    return np.concatenate([np.full(ORDER - 1, START, np.int64), cp])


def keys(codes: np.ndarray) -> np.ndarray:
    """The ORDER-gram key that ends at each character; its last character is
    in the lowest bits, so a lower order's key is the lower bits."""
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(ORDER):
        out = (out << BITS) | codes[i:i + n]
    return out


def mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


# ---------------------------------------------------------------- training

def _verdicts(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_ids of label rows that say good (quality 1, not toxic), and of
    those that don't."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id"), labels.filter(~good).select("doc_id")


def trusted_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose doc_id has labels that all say good, written. Both
    joins share one shuffle by doc_id, and Spark may drop rows without a
    good label by a Bloom filter of fixed size before it."""
    good, bad = _verdicts(labels)
    spark, conf = rows.sparkSession, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1b")  # whatever the size of the documents
    try:
        found = rows.join(good.hint("merge"), "doc_id", "left_semi").join(bad.hint("merge"), "doc_id", "left_anti")
        return written(found.withColumn("cal", calibrates("doc_id")), "trusted")
    finally:
        spark.conf.set(conf, before)


def calibrates(id_col: str):
    return F.pmod(F.xxhash64(F.lit(6), id_col), F.lit(5)) == 0


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(k, n): the ORDER-grams of column ``t`` over all rows."""
    def run(batches):
        for pdf in batches:
            parts, size = [], 0
            for t in pdf["t"]:
                if isinstance(t, str) and t:
                    parts.append(keys(char_codes(t)))
                    size += len(parts[-1])
                    if size >= BLOCK_CHARS:
                        yield _count(parts)
                        parts, size = [], 0
            if parts:
                yield _count(parts)

    def _count(parts):
        k, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"k": k, "n": n})

    return texts.select("t").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts 1, 2, 3 and more."""
    r = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(r[f"n{i}"], 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y]
    return tuple(min(max(x, 0.01), i - 0.01) for i, x in enumerate(d, 1))


def train(texts: DataFrame) -> DataFrame:
    """The model: (o, k, logp, w): the natural log of the interpolated
    probability of each n-gram's last character, and of the weight that its
    context role (as the first characters of a longer n-gram) gives to the
    next lower order (null if it is no context). Order 0 is the uniform
    floor, one row."""
    spark = texts.sparkSession
    counts = {ORDER: written(ngram_counts(texts), "counts")}
    for o in range(ORDER - 1, 0, -1):  # how many characters precede each
        counts[o] = written(counts[o + 1].groupBy(F.col("k").bitwiseAND(F.lit(mask(o))).alias("k"))
                            .agg(F.count(F.lit(1)).alias("n")), "counts")
    vocabulary = counts[1].count() + 1  # and any other character
    model = spark.createDataFrame([(0, 0, float(-np.log(vocabulary)))], "o int, k long, logp double")
    lower, weights = None, []
    for o in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[o])
        c = counts[o].withColumn("ctx", F.shiftright("k", BITS))
        n = F.col("n")
        stats = c.groupBy("ctx").agg(F.sum("n").alias("total"), *[
            F.count(F.when(test, 1)).alias(name) for name, test in (("n1", n == 1), ("n2", n == 2), ("n3", n >= 3))])
        stats = stats.withColumn("gamma", (F.col("n1") * d1 + F.col("n2") * d2 + F.col("n3") * d3) / F.col("total"))
        weights.append(stats.select(F.lit(o - 1).alias("o"), F.col("ctx").alias("k"), F.log("gamma").alias("w")))
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        j = c.join(stats.select("ctx", "total", "gamma"), "ctx").withColumn("own", (n - cut) / F.col("total"))
        if o == 1:
            j = j.withColumn("p", F.col("own") + F.col("gamma") / vocabulary)
        else:
            j = j.withColumn("s", F.col("k").bitwiseAND(F.lit(mask(o - 1)))).join(
                lower.select(F.col("k").alias("s"), F.col("p").alias("q")), "s").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = written(j.select("k", "p"), "probabilities")
        model = model.unionByName(lower.select(F.lit(o).alias("o"), "k", F.log("p").alias("logp")))
    w = weights[0]
    for x in weights[1:]:
        w = w.unionByName(x)
    return model.join(w, ["o", "k"], "full")


class Model:
    """A written model: its folder and shards [(order, first key, file)]."""

    def __init__(self, path: str, shards: list):
        self.path, self.shards = path, shards
        self.cache: OrderedDict = OrderedDict()
        self.held = 0
        self.fs = None

    def __getstate__(self):
        return {"path": self.path, "shards": self.shards}

    def __setstate__(self, s):
        self.__init__(s["path"], s["shards"])

    def load(self, name: str):
        if name in self.cache:
            self.cache.move_to_end(name)
            return self.cache[name]
        if self.fs is None:
            self.fs, self.root = open_fs(self.path)
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            t = pq.read_table(f, columns=["k", "logp", "w"])
        k = t["k"].to_numpy()
        by = np.argsort(k)
        got = tuple(x[by] for x in (k, t["logp"].to_numpy(zero_copy_only=False).astype(np.float64), t["w"].to_numpy(zero_copy_only=False).astype(np.float64)))
        size = sum(x.nbytes for x in got)
        while self.cache and self.held + size > CACHE_BYTES:
            _, old = self.cache.popitem(last=False)
            self.held -= sum(x.nbytes for x in old)
        self.cache[name] = got
        self.held += size
        return got

    def lookup(self, order: int, wanted: np.ndarray, column: int) -> np.ndarray:
        """logp (1) or w (2) of sorted distinct keys; NaN if missing."""
        out = np.full(len(wanted), np.nan)
        shards = [s for s in self.shards if s[0] == order]
        for i, (_, first, name) in enumerate(shards):
            lo = np.searchsorted(wanted, first) if i else 0
            hi = np.searchsorted(wanted, shards[i + 1][1]) if i + 1 < len(shards) else len(wanted)
            if hi <= lo:
                continue
            table = self.load(name)
            part = wanted[lo:hi]
            at = np.minimum(np.searchsorted(table[0], part), len(table[0]) - 1)
            out[lo:hi] = np.where(table[0][at] == part, table[column][at], np.nan)
        return out

    def log_probabilities(self, k: np.ndarray) -> np.ndarray:
        """The log probability of each key's last character after the others."""
        distinct, place = np.unique(k, return_inverse=True)
        total = np.zeros(len(distinct))
        open_ = np.arange(len(distinct))
        for o in range(ORDER, -1, -1):
            if not len(open_):
                break
            sub, back = np.unique(distinct[open_] & mask(o), return_inverse=True)
            logp = self.lookup(o, sub, 1)[back]
            got = ~np.isnan(logp)
            total[open_[got]] += logp[got]
            open_ = open_[~got]
            if o and len(open_):
                ctx, back = np.unique((distinct[open_] & mask(o)) >> BITS, return_inverse=True)
                w = self.lookup(o - 1, ctx, 2)[back]
                total[open_] += np.where(np.isnan(w), 0.0, w)  # a context never seen leaves all to the lower order
        return total[place]


def write_model(model: DataFrame) -> Model:
    """Write the model in shards of about SHARD_ROWS rows, sorted by order
    and key; the driver keeps one (order, first key, file) per shard."""
    spark = model.sparkSession
    model = written(model, "model")
    n = max(1, -(-model.count() // SHARD_ROWS))
    path = shared_path(spark, "shards")
    # a file holds one order, so a shard is one key range of it
    ranged = model.repartitionByRange(n, "o", "k").sortWithinPartitions("o", "k")
    ranged.write.partitionBy("o").parquet(path)
    table = spark.read.parquet(path)
    rows = (table.withColumn("name", F.col("_metadata.file_path")).groupBy("o", "name").agg(F.min("k").alias("first"))
            .orderBy("o", "first").collect())  # one row per shard
    base = path.rstrip("/").rpartition("/")[2]
    return Model(path, [(r["o"], r["first"], r["name"].split(f"/{base}/", 1)[1]) for r in rows])


# ---------------------------------------------------------------- scoring

def text_scores(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities, characters) of each text, in blocks."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    held: list = []
    size = 0

    def flush():
        logp = model.log_probabilities(np.concatenate([k for _, k in held]))
        ends = np.cumsum([len(k) for _, k in held])
        for (i, k), e in zip(held, ends, strict=True):
            total[i] += logp[e - len(k):e].sum()

    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t:
            continue
        k = keys(char_codes(t))
        n[i] = len(k)
        for lo in range(0, len(k), BLOCK_CHARS):  # a long text takes several blocks
            part = k[lo:lo + BLOCK_CHARS]
            if size and size + len(part) > BLOCK_CHARS:
                flush()
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        flush()
    return total, n


class Classifier:
    """model, mean (of the corpus, natural log a character), and the
    perplexity limit of each language."""

    def __init__(self, model: Model, mean: float, limits: dict, default: float):
        self.model, self.mean, self.limits, self.default = model, mean, limits, default

    def rate(self, texts: list, langs: list):
        """(perplexity or NaN, limit, kept) arrays."""
        total, n = text_scores(self.model, texts)
        ppl = np.exp(-(total + PRIOR_CHARS * self.mean) / (n + PRIOR_CHARS))
        ppl[n == 0] = np.nan
        limit = np.array([self.limits.get(x if isinstance(x, str) else NO_LANG, self.default) for x in langs])
        return ppl, limit, (n > 0) & (np.nan_to_num(ppl, nan=np.inf) <= limit)


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Classifier | None:
    """Train on the trusted rows and set each language's limit at the
    quantile of its trusted rows kept for calibration (a fifth), times
    MARGIN. A language
    without any takes the quantile over all. None if nothing is trusted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"),
                       F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang")).filter("t is not null and t <> ''")
    trusted = trusted_rows(rows, labels)
    fit_rows, cal_rows = trusted.filter("not cal"), trusted.filter("cal")
    if fit_rows.isEmpty():
        return None
    if cal_rows.isEmpty():
        cal_rows = fit_rows
    model = write_model(train(fit_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the list of shards

    def score(batches):
        for pdf in batches:
            total, n = text_scores(shared.value, list(pdf["t"]))
            yield pd.DataFrame({"lang": pdf["lang"], "total": total, "n": n})

    scored = written(cal_rows.select("t", "lang").mapInPandas(score, "lang string, total double, n long"), "calibration")
    mean = float(scored.agg(F.sum("total") / F.sum("n")).first()[0])
    ppl = F.exp(-(F.col("total") + PRIOR_CHARS * mean) / (F.col("n") + PRIOR_CHARS))
    limits = {r["lang"]: MARGIN * r["q"] for r in scored.groupBy("lang").agg(F.percentile_approx(ppl, quantile, 100_000).alias("q")).collect()}
    default = MARGIN * scored.agg(F.percentile_approx(ppl, quantile, 100_000)).first()[0]
    return Classifier(model, mean, limits, default)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, perplexity, threshold, kept`` for every row of ``docs``.

    Null and empty texts have no perplexity and are not kept. Null languages
    are one language. Without any trusted row nothing can be told from
    anything: perplexity and threshold are null, and every row with text is
    kept. Repeated rows are scored alike; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    clf = fit(docs, labels, quantile, id_col, text_col, lang_col)
    if clf is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"),
                           F.coalesce(F.col("t") != "", F.lit(False)).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(clf)

    def run(batches):
        for pdf in batches:
            ppl, limit, kept = shared.value.rate(list(pdf["t"]), list(pdf["lang"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "perplexity": pd.array(ppl, "Float64"), "threshold": limit, "kept": kept})

    out = rows.mapInPandas(run, "doc_id long, perplexity double, threshold double, kept boolean")
    return out.withColumn("perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity")))


def good_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, unchanged."""
    clf = fit(docs, labels, quantile, id_col, text_col, lang_col)
    if clf is None:
        return docs.filter(F.coalesce(F.col(text_col) != "", F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(clf)

    def run(batches):
        for pdf in batches:
            yield pdf[shared.value.rate(list(pdf[text_col]), list(pdf[lang_col]))[2]]

    return docs.mapInPandas(run, docs.schema)
