"""The feature and scoring jobs as Structured Streaming queries.

Rows may come in any order within a declared delay. A watermark follows the
newest event time at that distance; a user's rows are buffered until it has
passed them and are then released in (timestamp, id) order, so the features
equal the batch job's. Only rows that come behind the watermark, or without a
timestamp, are *late*: they pass through with ``late = true`` and no features
and touch no state (G4 routes them to a side output).

Users are dealt to ``GROUPS`` groups by a hash, and the state is a group's
(``transformWithStateInPandas``), so that the calls of a micro-batch follow the
groups and not the users: buffered rows (list state, one Arrow block per
micro-batch), the released rows that later windows can reach, running history
of its users, and how often users paid receivers, in ``BUCKETS`` blocks by a hash
of both, of which only those of the released rows are read and written. One
event-time timer stands at the oldest buffered row. Windows and sums come from
the batch job's array functions (``operators.segments``) over all users of the
group at once: exact sums, no row loop. The point features are then added by the
same Spark expressions as in the batch job.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from txnscope.functions.amount import amount_columns
from txnscope.functions.calendar import calendar_columns
from txnscope.functions.flags import device_columns, interaction_columns
from txnscope.operators import segments as sg
from txnscope.operators.features import derived_history_columns
from txnscope.operators.windows import EXACT, codes, finite, sorted_rows
from txnscope.schema import TRANSACTION_SCHEMA
from txnscope.session import checkpoint_dir

US = 1_000_000
WINDOWS = (("1h", 3600), ("24h", 86400))
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far behind the newest row a row may come when a folder is replayed.
REPLAY_DELAY = "32 days"
LIVE_DELAY = "10 minutes"

#: Groups of users, and blocks of a group's receivers. A stream's checkpoint
#: keeps what it began with: change them for new streams only.
GROUPS = 512
BUCKETS = 16
_HIST = [("tx_count_1h", T.LongType()), ("tx_amount_1h", T.DoubleType()),
         ("tx_count_24h", T.LongType()), ("tx_amount_24h", T.DoubleType()),
         ("time_since_last_tx", T.DoubleType()), ("user_tx_number", T.LongType()),
         ("user_total_amount", T.DoubleType()), ("user_avg_amount", T.DoubleType()),
         ("user_std_amount", T.DoubleType()), ("receiver_tx_count", T.LongType())]
_AMOUNT = pa.decimal128(38, 12)
# time in microseconds, amount as a double and as an exact decimal; pandas state
# functions lose columns whose names begin with an underscore
_US, _X, _A = "event_us", "event_amount", "event_units"
_GROUP, _BUCKET = "event_group", "event_bucket"
_TOTAL = [f"total_{i}" for i in range(4)]  # a user's sum, in limbs
# empty tables of the state; a null column takes any type
_RECENT = pa.table({"user_id": pa.nulls(0), _US: pa.array([], pa.int64()), _A: pa.array([], _AMOUNT)})
_HISTORY = pa.table({"user_id": pa.nulls(0), **{c: pa.array([], pa.int64()) for c in ["n", "cnt", "last", *_TOTAL]},
                     **{c: pa.array([], pa.float64()) for c in ("mean", "m2")}})
_PAID = pa.table({"user_id": pa.nulls(0), "receiver": pa.nulls(0), _BUCKET: pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def _out_schema(raw: T.StructType) -> T.StructType:
    return T.StructType(list(raw.fields) + [T.StructField(n, t) for n, t in _HIST]
                        + [T.StructField("late", T.BooleanType())])


def _block(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    array = column.combine_chunks()
    return array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)


def _decimals(column: pd.Series) -> pa.Array:
    return pa.array([x if isinstance(x, Decimal) else None for x in column], _AMOUNT)


def _concat(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables, promote_options="permissive")


def _codes(tables: list[pa.Table], column: str) -> list[np.ndarray]:
    """Equal values of all tables -> equal numbers from 0; by table."""
    both = _concat([t.select([column]) for t in tables])[column]
    return np.split(codes(both), np.cumsum([len(t) for t in tables])[:-1])


def _segments(names: np.ndarray, user: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where users stand in ``names``, and which of them do."""
    at = np.minimum(np.searchsorted(names, user), len(names) - 1)
    return at, names[at] == user


class UserFeatures(StatefulProcessor):
    """The buffer and history of a group of users; see the module docstring."""

    def __init__(self, columns: list[str], windows=WINDOWS):
        self.columns, self.windows = columns, windows

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))
        self.recent = handle.getValueState("recent", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.history = handle.getValueState("history", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.paid = handle.getMapState("paid", "bucket long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pdf = pd.concat(list(rows), ignore_index=True)
        late = (pdf[_US].isna() | (pdf[_US] < passed)).to_numpy(bool)
        keep = pdf[~late]
        if len(keep):
            us = keep[_US].to_numpy(np.int64)
            # the row as it is, but for what pandas can't hold: time and amount as numbers
            data = {c: pa.Array.from_pandas(keep[c]) for c in self.columns}
            table = pa.table({**data, _US: us, _X: pa.Array.from_pandas(keep[_X].astype(float)), _A: _decimals(keep[_A]),
                              _BUCKET: keep[_BUCKET].to_numpy(np.int64)})
            self.buffer.appendValue((_block(table),))
            self.wait(int(us.min()) // 1000)
        if late.any():
            yield pdf.loc[late, self.columns].assign(**{n: None for n, _ in _HIST}, late=True)

    def wait(self, ms: int) -> None:
        """One timer, at the oldest buffered row."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        blocks = [_table(b) for (b,) in self.buffer.get()]
        rows = pa.concat_tables(blocks, promote_options="permissive")
        us = rows[_US].to_numpy()
        rest, ready = np.flatnonzero(us >= passed), np.flatnonzero(us < passed)
        self.buffer.clear()
        if len(rest):
            self.buffer.appendValue((_block(rows.take(pa.array(rest))),))
            # strictly after the watermark's own millisecond, so that it can't fire in vain
            self.wait(max(int(us[rest].min()) // 1000, passed // 1000 + 1))
        if len(ready):
            yield self.released(rows.take(pa.array(ready)), passed)

    def released(self, table: pa.Table, passed: int) -> pd.DataFrame:
        """The features of the group's next rows, in order; updates the state."""
        known = _table(self.history.get()[0]) if self.history.exists() else _HISTORY
        past = _table(self.recent.get()[0]) if self.recent.exists() else _RECENT
        known_user, past_user, user = _codes([known, past, table], "user_id")
        names, segment = np.unique(user, return_inverse=True)
        us = table[_US].to_numpy()
        order = sorted_rows(segment, us, table["transaction_id"], np.arange(len(table)))
        table, segment, us = table.take(pa.array(order)).combine_chunks(), segment[order], us[order]
        out = self.window_sums(past, *_segments(names, past_user), table, segment, us)
        # history: each user's start values, then on from them
        at, own_known = _segments(names, known_user)
        at = at[own_known]

        def begin(column, default):
            values = known[column].to_numpy()
            start = np.full(len(names), default, values.dtype)
            start[at] = values[own_known]
            return start

        own, x = sg.Rows(segment, us), table[_X].to_numpy()
        last = begin("last", sg.NULL_TIME)
        prev = np.append(us[0], us[:-1])
        prev[own.start] = np.where(last == sg.NULL_TIME, us[own.start], last)
        out["time_since_last_tx"] = ((us - prev) // (60 * US)).astype(float)
        cnt, mean, m2 = sg.moments(own, x, begin("cnt", 0), begin("mean", 0.0), begin("m2", 0.0))
        sums = sg.prefix(sg.limbs(_flat(table[_A])))
        total = sums[1:] - sums[own.first] + np.stack([begin(c, 0) for c in _TOTAL], 1)[segment]
        out["user_tx_number"] = begin("n", 0)[segment] + own.at - own.first + 1
        out["user_total_amount"] = np.where(cnt > 0, sg.doubles(total), np.nan)
        out["user_avg_amount"] = np.where(cnt > 0, out["user_total_amount"] / np.maximum(cnt, 1), np.nan)
        out["user_std_amount"] = np.sqrt(np.where(cnt > 1, np.maximum(m2, 0), 0) / np.maximum(cnt - 1, 1))
        out["receiver_tx_count"] = self.receivers(own, table)
        # state
        both = _concat([past, table.select(past.column_names)])
        reach = np.flatnonzero(both[_US].to_numpy() >= passed - max(s for _, s in self.windows) * US)
        self.recent.update((_block(both.take(pa.array(reach))),))
        end = own.start + own.length - 1
        upto = total[end]
        for i in range(3):  # the sum as a decimal's limbs
            upto[:, i + 1] += upto[:, i] >> 32
            upto[:, i] &= sg.LOW
        new = pa.table({"user_id": table["user_id"].take(pa.array(end)), "n": out["user_tx_number"][end], "cnt": cnt[end].astype(np.int64),
                        "last": us[end], **dict(zip(_TOTAL, upto.T.copy())), "mean": mean[end], "m2": m2[end]})
        self.history.update((_block(_concat([known.filter(pa.array(~own_known)), new])),))
        return table.select(self.columns).to_pandas().assign(**out, late=False)

    def window_sums(self, past: pa.Table, at: np.ndarray, here: np.ndarray, table: pa.Table, segment: np.ndarray, us: np.ndarray) -> dict:
        """Counts and sums of the windows; ``at``, ``here``: the past rows'
        segments, and which of them are of these users."""
        earlier = np.flatnonzero(here)
        all_segments, all_us = np.append(at[earlier], segment), np.append(past[_US].to_numpy()[earlier], us)
        amounts = np.concatenate([sg.limbs(_flat(past[_A]))[earlier], sg.limbs(_flat(table[_A]))])
        order = np.lexsort((all_us, all_segments))  # stable: rows of one time stay in the order of ids
        new = order >= len(earlier)
        rows = sg.Rows(all_segments[order], all_us[order])
        sums = sg.prefix(np.concatenate([np.ones((len(order), 1), np.int64), amounts[order]], 1))
        out = {}
        for name, s in self.windows:
            content = sg.since(rows, sums, rows.window_start(s * US))[new]
            out[f"tx_count_{name}"], out[f"tx_amount_{name}"] = content[:, 0], sg.doubles(content[:, 1:])
        return out

    def receivers(self, own: sg.Rows, table: pa.Table) -> np.ndarray:
        """How often each row's user paid its receiver before."""
        touched = [(int(b),) for b in np.unique(table[_BUCKET].to_numpy())]
        old = _concat([_PAID, *(_table(self.paid.getValue(b)[0]) for b in touched if self.paid.containsKey(b))])
        (old_user, user), (old_to, to) = _codes([old, table], "user_id"), _codes([old, table], "receiver")
        width = max(int(old_to.max(initial=0)), int(to.max(initial=0))) + 1
        pairs, first, code = np.unique(np.append(old_user, user) * width + np.append(old_to, to), return_index=True, return_inverse=True)
        before = np.zeros(len(pairs), np.int64)
        before[code[:len(old)]] = old["n"].to_numpy()
        mine = code[len(old):]
        keys = ["user_id", "receiver", _BUCKET]
        paid = _concat([old.select(keys), table.select(keys)]).take(pa.array(first))
        paid = paid.append_column("n", pa.array(before + np.bincount(mine, minlength=len(pairs))))
        bucket = paid[_BUCKET].to_numpy()
        for b in touched:
            self.paid.updateValue(b, (_block(paid.filter(pa.array(bucket == b[0]))),))
        return before[mine] + sg.earlier_equal(own, mine)[0]

    def close(self) -> None:
        pass


def stream_window_features(stream: DataFrame, windows=WINDOWS, delay: str = LIVE_DELAY, beats: DataFrame | None = None) -> DataFrame:
    """G1 core: the stateful pass over groups of users (V, H, R columns + ``late``).

    ``delay``: how far behind the newest row a row may come. ``beats``: a
    stream with a column ``timestamp`` that says how far time has gone where
    no rows come; a watermark without rows stands still otherwise."""
    columns = stream.columns
    timed = stream.withColumn("_beat", F.lit(False))
    if beats is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "timestamp" else F.col("timestamp") for f in stream.schema.fields]
        timed = timed.unionByName(beats.select(*empty, F.lit(True).alias("_beat")))
    # late rows must reach the side output: the watermark is that of a copy of the column
    timed = timed.withColumn("_et", F.col("timestamp").cast("timestamp")).withWatermark("_et", delay)
    timed = timed.filter(~F.col("_beat") | F.col("_et").isNull())  # after the watermark has seen the beats
    x = finite(F.col("amount"))
    timed = timed.select(*columns, F.unix_micros(F.col("timestamp").cast("timestamp")).alias(_US), x.alias(_X), x.cast(EXACT).alias(_A),
                         F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias(_GROUP),
                         F.pmod(F.xxhash64("user_id", "receiver"), F.lit(BUCKETS)).alias(_BUCKET))
    return timed.groupBy(_GROUP).transformWithStateInPandas(
        UserFeatures(columns, windows), _out_schema(stream.schema), "Append", "EventTime")


def stream_features(stream: DataFrame, delay: str = LIVE_DELAY, beats: DataFrame | None = None) -> DataFrame:
    """G1: the 43 features per released row (late rows keep ``late = true``
    and NULL features)."""
    w = stream_window_features(stream, delay=delay, beats=beats)
    w = w.select("*", *calendar_columns("timestamp"), *amount_columns("amount"),
                 *device_columns(), *derived_history_columns())
    return w.select("*", *interaction_columns("amount"))


def stream_score(features: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Stateless scoring of the feature stream."""
    from txnscope.functions import scoring as P
    from txnscope.operators.model import score
    s = score(model, features.filter(~F.col("late")))
    return s.select("transaction_id", "user_id", "timestamp", "fraud_score",
                    P.decide("fraud_score", threshold).alias("is_fraud_pred"),
                    P.risk_level("fraud_score").alias("risk_level"),
                    P.reason_codes(s).alias("reason_codes"))


def route_late(batch: DataFrame, batch_id: int, main_path: str, late_path: str) -> None:
    """One micro-batch -> on-time rows to the main sink, late rows to
    the side output. Each batch overwrites its own ``batch_id=`` folder, so
    a retried batch replaces rather than duplicates its output."""
    batch = batch.persist()
    batch.filter(~F.col("late")).drop("late").write.mode("overwrite") \
         .parquet(f"{main_path}/batch_id={batch_id}")
    batch.filter(F.col("late")).select(*[c for c in batch.columns if c not in dict(_HIST)]) \
         .write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
    batch.unpersist()


def drain(spark: SparkSession, source_dir: str, base: str, build, sink, max_files_per_trigger: int = 1,
          raw_schema: T.StructType = TRANSACTION_SCHEMA, delay: str = REPLAY_DELAY, close: bool = True) -> None:
    """Run ``build(rows, beats)`` over a folder of raw parquet files until it
    is drained, every micro-batch through ``sink(batch, batch_id)``; the
    checkpoint is in ``base``, so a second call goes on with new files.

    With ``close`` a beat just behind the newest row then moves the watermark
    past all of them: none stays in the buffer. Rows that are appended later
    are on time if they are newer than that."""
    beats_dir = f"{base}/_beats"
    beat = T.StructType([T.StructField("timestamp", T.TimestampType())])
    spark.createDataFrame([], beat).write.mode("append").parquet(beats_dir)

    def run():
        src = (spark.readStream.schema(raw_schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
        beats = spark.readStream.schema(beat).parquet(beats_dir)
        held = spark.conf.get(STORE)
        spark.conf.set(STORE, ROCKS)  # list, map and timer state need it; a query keeps what it started with
        try:
            q = (build(src.select(*[f.name for f in raw_schema]), beats).writeStream.foreachBatch(sink)
                 .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
        finally:
            spark.conf.set(STORE, held)
        q.awaitTermination()

    run()
    if close:
        newest = spark.read.schema(raw_schema).parquet(source_dir).agg(F.max("timestamp").cast("timestamp").alias("t"))
        last = newest.filter("t is not null").select((F.col("t") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 MILLISECOND")).alias("timestamp"))
        last.write.mode("append").parquet(beats_dir)
        run()


def run_feature_stream(spark: SparkSession, source_dir: str, out_dir: str | None = None,
                       max_files_per_trigger: int = 1, raw_schema: T.StructType = TRANSACTION_SCHEMA,
                       delay: str = REPLAY_DELAY, close: bool = True):
    """Run G1+G4 over a directory of raw parquet files until it is drained
    (see ``drain``); returns (features, late rows) read back from the sinks."""
    base = out_dir or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    main, late = f"{base}/features", f"{base}/late"
    drain(spark, source_dir, base, lambda rows, beats: stream_features(rows, delay, beats), lambda b, i: route_late(b, i, main, late),
          max_files_per_trigger, raw_schema, delay, close)
    return spark.read.parquet(main).drop("batch_id"), spark.read.parquet(late).drop("batch_id")


def stream_profile(stream: DataFrame) -> DataFrame:
    """The user profile's running parts, one row per (user_id, what,
    value): the user's amounts (what = '') and how often each device and
    location was used. Run it in update mode; a row is what is true from its
    micro-batch on."""
    part = lambda what, value: F.struct(F.lit(what).alias("what"), value.cast("string").alias("value"))
    parts = F.array(part("", F.lit("")), part("device_id", F.col("device_id")), part("location", F.col("location")))
    return (stream.select("user_id", "amount", F.explode(parts).alias("p")).groupBy("user_id", "p.what", "p.value")
            .agg(F.count(F.lit(1)).alias("n_tx"), F.avg("amount").alias("avg_amount"), F.stddev_samp("amount").alias("std_amount")))


def run_profile_stream(spark: SparkSession, source_dir: str, out_dir: str, max_files_per_trigger: int = 1,
                       raw_schema: T.StructType = TRANSACTION_SCHEMA) -> None:
    """G3 over a directory of raw parquet files until it is drained: each
    micro-batch writes the rows it changed to a folder of its own, which a
    retry overwrites. See ``read_profile`` and ``compact_profile``."""
    src = (spark.readStream.schema(raw_schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir).select(*[f.name for f in raw_schema]))
    q = (stream_profile(src).writeStream.outputMode("update")
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out_dir}/changes/batch_id={i}"))
         .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def _versions(spark: SparkSession, out_dir: str) -> DataFrame:
    """Each key's last version: the newest snapshot and the changes after it."""
    schema = "user_id string, what string, value string, n_tx long, avg_amount double, std_amount double"
    changes = spark.read.schema(schema + ", batch_id long").parquet(f"{out_dir}/changes")
    upto = _snapshot(spark, out_dir)
    if upto is not None:
        old = spark.read.schema(schema).parquet(f"{out_dir}/snapshots/upto={upto}").withColumn("batch_id", F.lit(upto).cast("long"))
        changes = changes.filter(F.col("batch_id") > upto).unionByName(old)
    last = changes.groupBy("user_id", "what", "value").agg(
        F.max_by(F.struct("n_tx", "avg_amount", "std_amount"), "batch_id").alias("v"), F.max("batch_id").alias("batch_id"))
    return last.select("user_id", "what", "value", "v.*", "batch_id")


def _snapshot(spark: SparkSession, out_dir: str) -> int | None:
    """The batch up to which the newest finished snapshot goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/snapshots")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in done
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def compact_profile(spark: SparkSession, out_dir: str) -> int | None:
    """Write the last versions as a snapshot, which readers take from then
    on in place of all older changes; returns the batch it goes up to."""
    last = _versions(spark, out_dir)
    upto = last.agg(F.max("batch_id")).first()[0]
    if upto is not None and upto != _snapshot(spark, out_dir):
        last.drop("batch_id").write.mode("overwrite").parquet(f"{out_dir}/snapshots/upto={upto}")
    return upto


def read_profile(spark: SparkSession, out_dir: str) -> DataFrame:
    """G3's snapshot in the form of B2: per user the count, mean and sample
    standard deviation of amount, and the most used device and location
    (ties: the smallest value)."""
    last = _versions(spark, out_dir)
    usual = lambda what: F.min_by(F.when(F.col("what") == what, F.col("value")), F.when(
        F.col("what") == what, F.struct(-F.col("n_tx"), F.col("value")))).alias(f"usual_{what}")
    own = lambda c: F.max(F.when(F.col("what") == "", F.col(c))).alias(c)
    return last.groupBy("user_id").agg(own("n_tx"), own("avg_amount"), own("std_amount"), usual("device_id"), usual("location"))


def write_in_time_order(df: DataFrame, path: str, chunk_days: int = 7, files: int = 1) -> int:
    """Write ``df`` as a file stream source: one folder per ``chunk_days``
    of event time, written oldest first so the file source reads them in
    that order; within a chunk the rows are dealt to ``files`` files in no
    order. Returns the number of chunks."""
    day = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / F.lit(86400 * chunk_days))
    keyed = df.withColumn("_chunk", day.cast("long"))
    chunks = [r["_chunk"] for r in keyed.select("_chunk").distinct().orderBy("_chunk").collect()]
    # the chunk list is bounded by the time span / chunk length
    for c in chunks:
        part = keyed.filter(F.col("_chunk") == c).drop("_chunk")
        if files > 1:
            part = part.repartition(files, "transaction_id")
        part.write.mode("overwrite").parquet(f"{path}/chunk={c:012d}")
    return len(chunks)
