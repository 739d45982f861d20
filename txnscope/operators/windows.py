"""Per-user time-ordered window features without a per-user hot partition.

Features (row order = ``(timestamp, transaction_id)`` within a user):

* V  ``tx_count_<w>`` / ``tx_amount_<w>``: earlier rows of the user with
  ``ts >= now - w`` (closed lower bound, current row excluded, equal
  timestamps only when they sort earlier); ``time_since_last_tx`` whole
  minutes since the previous row.
* H  ``user_tx_number``, ``user_total_amount``, ``user_avg_amount``,
  ``user_std_amount``: expanding statistics including the current row.
* R  ``receiver_tx_count``: earlier rows of the same (user, receiver).

Plan
----
A plain ``Window.partitionBy(user)`` puts every row of a user in one task and
a sliding RANGE frame re-aggregates its whole buffer per row, so a user with
a third of the data would be one quadratic task. Instead:

1. Busy users are cut into *slices* by (time, id) at the quantiles of a
   bounded, deterministic sample of all keys, so that no slice holds much more
   than an ``n_slices``-th of all rows, however the user's rows lie in time
   (even within one timestamp). All other users are a single slice.
2. Rows move once, hashed by (user, slice). A group's rows are sorted, and all
   windows come from binary searches and prefix sums over them (``segments``).
3. What a slice inherits from the user's earlier slices comes as *carry* rows:
   history, window contents, the last row, receiver counts, and the rows whose
   windows end inside a later slice. They are made by ``groupBy`` from busy
   users' rows only, and by a window over at most ``n_slices`` totals.

Amounts add up as integers of 10^-12, which is exact for amounts of up to 12
decimals (others are rounded to that first): the sum of an empty window is 0,
and no sum of positive amounts is negative. A window's sum is exact up to 2^31
rows. NaN, infinite and absurd amounts (1e26 and more) count as NULL. Rows
without a timestamp sort first and have empty windows.

The result doesn't depend on the slices. Nothing is collected and no job runs
while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnscope.operators import segments as sg

US = 1_000_000
DEFAULT_WINDOWS: tuple[tuple[str, int], ...] = (("1h", 3600), ("24h", 86400))
DEFAULT_BUCKET = 6 * 3600
EXACT = "decimal(38,12)"
#: Sampled keys for each slice; a user with fewer is not cut.
SAMPLE = 32
#: Rows that a group holds, about: its Python task keeps all of them at once.
GROUP_ROWS = 1 << 17
#: Sampled keys, for all slices, where the rows' count says how many there are;
#: and for a slice at least.
KEYS, FEW_KEYS = 1 << 13, 4
CARRY, ROW, EVENT, RECEIVER, VALUE = range(5)


def _w(name: str) -> str:
    return name.replace(" ", "_")


def finite(c: Column) -> Column:
    """The number as a double; NULL if it is NaN, infinite or too large for
    an exact sum."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(1e26)), d)


def _bucket(us: str, B: int) -> Column:
    return F.expr(f"({us} - pmod({us}, {B}L)) div {B}L")


def group_count(keys: DataFrame, n_slices: int) -> DataFrame:
    """One row: how many groups (``_w_g``) hold the rows, at least ``n_slices``."""
    return keys.agg(F.greatest(F.lit(n_slices).cast("long"), F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)).cast("long")).alias("_w_g"))


def busy_cuts(keys: DataFrame, n_slices: int, wanted: DataFrame | None = None) -> DataFrame:
    """``(u, us, id)`` -> ``(_cu, _cuts)``: for users with more than an
    ``n_slices``-th of all rows, about, the keys at which their slices begin,
    in blocks. At most ``n_slices`` cuts in all, or as many as ``wanted`` (one
    row, ``_w_g``) says, as far as the sample goes."""
    n = SAMPLE * n_slices if wanted is None else max(KEYS, SAMPLE * n_slices)
    sample = keys.orderBy(F.xxhash64("u", "us", "id"), "u", "us", "id").limit(n)
    if wanted is None:
        sample = sample.withColumn("_each", F.lit(SAMPLE).cast("long"))
    else:
        sample = sample.crossJoin(F.broadcast(wanted)).withColumn("_each", F.greatest(F.lit(FEW_KEYS).cast("long"), F.floor(F.lit(n) / F.col("_w_g")).cast("long"))).drop("_w_g")
    mine = Window.partitionBy("u")
    cut = (sample.withColumn("_n", F.row_number().over(mine.orderBy("us", "id")))
           .withColumn("_all", F.count(F.lit(1)).over(mine))
           .filter((F.col("_all") >= F.col("_each")) & (F.col("_n") % F.col("_each") == 1) & (F.col("_n") > 1)))
    cuts = cut.groupBy(F.col("u").alias("_cu")).agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("_all"))
    step = F.ceil(F.sqrt(F.size("_all"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / step).cast("int")), lambda i: F.slice("_all", i * step + 1, step))
    return cuts.select("_cu", blocks.alias("_cuts"), step.alias("_step"))


def _with_slice(df: DataFrame, name: str, reached) -> DataFrame:
    """Add the number of cuts that are reached (a condition on a cut); 0 for
    users that are not cut. About the square root of the cuts is looked at
    twice: the first cuts of all blocks, then one block."""
    df = df.withColumn("_block", F.size(F.filter("_cuts", lambda b: reached(b[0]))))
    inside = F.size(F.filter(F.get("_cuts", F.col("_block") - 1), reached))
    return df.withColumn(name, F.when(F.col("_block") > 0, (F.col("_block") - 1) * F.col("_step") + inside).otherwise(0).cast("int")).drop("_block")


def time_window_features(
    df: DataFrame,
    windows: Sequence[tuple[str, int]] = DEFAULT_WINDOWS,
    n_slices: int | None = None,
    *,
    user_col: str = "user_id",
    ts_col: str = "timestamp",
    id_col: str = "transaction_id",
    amount_col: str = "amount",
    receiver_col: str | None = "receiver",
    history: bool = True,
    gap: bool = True,
    running: dict | None = None,
    sums: dict | None = None,
    distinct_of: str | None = None,
    first_seen: bool = False,
    prior_history: bool = False,
) -> DataFrame:
    """Add V (per window), H and R columns to ``df``; see module docstring.

    ``windows`` is a list of (suffix, seconds). ``n_slices`` (default: the
    session's shuffle partitions, and more if a group would hold more than
    about ``GROUP_ROWS`` rows, by a count in the plan) bounds a group's share
    of all rows and of a busy user.
    ``running`` maps an output name to ``(column, include_current)``: the
    user's running sum of that column over earlier rows (and the current
    one if ``include_current``). ``sums`` maps a name to a column summed like
    ``tx_amount`` (earlier rows in the window): output ``<name>_<w>``.
    ``distinct_of`` adds ``distinct_<col>_<w>``: distinct values of the column
    (NULL is none) among the rows in ``[t - w, t]`` *including* the current
    row. ``first_seen`` adds ``user_first_us``: the user's first timestamp (in
    microseconds). ``prior_history`` adds the leak-free variant of H over
    earlier rows only: ``prior_tx_count``, ``prior_total_amount``,
    ``prior_avg_amount``, ``prior_std_amount`` (0 where there is no earlier
    row or only one). The columns of ``df`` come back unchanged; their names
    must not begin with ``_w_``.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed, n_slices = n_slices, n_slices or partitions
    wins = [(_w(n), int(s) * US) for n, s in windows]
    running, sums = dict(running or {}), dict(sums or {})

    def col(expr) -> Column:
        return F.col(expr) if isinstance(expr, str) else expr

    # channels: what adds up. The first is the amount, then sums, then running
    exprs = [F.col(amount_col), *(col(e) for e in sums.values()), *(col(e) for e, _ in running.values())]
    n_sums = 1 + len(sums)
    chans = [f"_w_a{i}" for i in range(len(exprs))]
    base = df.select("*", F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_w_us"),
                     finite(F.col(amount_col)).alias("_w_x"),
                     *[finite(e).cast(EXACT).alias(c) for e, c in zip(exprs, chans)])
    keys = df.select(F.col(user_col).alias("u"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"), F.col(id_col).alias("id"))
    wanted = None if fixed else group_count(keys, n_slices)
    cuts = busy_cuts(keys, n_slices, wanted)
    base = base.withColumn("_key", F.struct(F.col("_w_us").alias("us"), F.col(id_col).alias("id")))
    same_user = base[user_col].eqNullSafe(cuts["_cu"])
    rows, busy = (_with_slice(base.join(F.broadcast(cuts), same_user, how), "_w_s", lambda c: c <= F.col("_key")).drop("_cu", "_key")
                  for how in ("left", "inner"))
    rows = rows.drop("_cuts", "_step").withColumn("_w_k", F.lit(ROW))
    parts = _carries(busy, wins, chans, n_sums, user_col, id_col, receiver_col, distinct_of, history or gap or first_seen or prior_history or bool(running))

    extra = {"_w_w": "int", "_w_c": "long", "_w_d": "long", "_w_n": "long", "_w_f": "long", "_w_m": "double", "_w_q": "double"}
    types = dict(rows.dtypes) | extra
    stream = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    for p in parts:
        stream = stream.unionByName(p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]))
    if wanted is None:
        stream = stream.withColumn("_w_g", F.lit(max(n_slices, partitions)))
    else:
        stream = stream.crossJoin(F.broadcast(wanted))  # one row
    stream = stream.withColumn("_w_p", F.pmod(F.xxhash64(user_col, "_w_s"), F.col("_w_g"))).drop("_w_g").repartition("_w_p")

    spec = _Spec(wins, df.columns, user_col, id_col, receiver_col, distinct_of, list(sums), [(n, i) for n, (_, i) in running.items()],
                 history, gap, first_seen, prior_history)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in spec.outputs())])
    return stream.groupBy("_w_p").applyInArrow(lambda table: spec.run(table), schema)


def _carries(busy: DataFrame, wins, chans, n_sums, user_col, id_col, receiver_col, distinct_of, with_history: bool) -> list[DataFrame]:
    """What the slices of busy users inherit, as rows of the stream."""
    out = []
    user, s = F.col(user_col), F.col("_w_s")
    prior = lambda *keys: Window.partitionBy(*keys).orderBy("_w_s").rowsBetween(Window.unboundedPreceding, -1)
    has_value = F.lit(False)
    if distinct_of:
        has_value = F.col(distinct_of).isNotNull()
        keys = [user_col, distinct_of]
        last = (busy.filter(has_value).groupBy(*keys, "_w_s").agg(F.max("_w_us").alias("_l"))
                .withColumn("_l", F.max("_l").over(prior(*keys))).filter("_l is not null"))
        out.append(last.select(*keys, "_w_s", F.col("_l").alias("_w_us"), F.lit(VALUE).alias("_w_k")))
        renamed = last.select(F.col(user_col).alias("_u"), F.col(distinct_of).alias("_v"), F.col("_w_s").alias("_s"), "_l")
        before = F.lag("_w_us").over(Window.partitionBy(*keys, "_w_s").orderBy("_w_us", id_col))
        busy = (busy.withColumn("_prev", before)
                .join(renamed, user.eqNullSafe(F.col("_u")) & (F.col(distinct_of) == F.col("_v")) & (s == F.col("_s")), "left")
                .withColumn("_prev", F.coalesce("_prev", "_l")).drop("_u", "_v", "_s", "_l"))
    if wins:
        # one parameter: with two, a filter would pass the index as the second
        until = lambda t: (lambda c: c["us"] <= t)
        changes, timed = [], busy.filter("_w_us is not null")
        for i, (_, width) in enumerate(wins):
            def change(where, when, count, values, sign, i=i):
                return F.struct(where.alias("s"), when.alias("t"), F.lit(i).alias("w"), F.lit(count).cast("long").alias("c"),
                                values.cast("long").alias("d"), F.lit(sign).alias("sign"))
            end = F.col(f"_end{i}")
            timed = timed.withColumn(f"_end{i}", F.col("_w_us") + F.lit(width))
            timed = _with_slice(timed, f"_ends{i}", until(end))
            again = F.lit(False)
            if distinct_of:
                back = F.col(f"_back{i}")
                timed = timed.withColumn(f"_back{i}", F.col("_prev") + F.lit(width))
                timed = _with_slice(timed, f"_backs{i}", until(back))
                again = has_value & F.col("_prev").isNotNull() & (back >= F.col("_w_us"))
                changes.append(F.when(again, change(F.col(f"_backs{i}"), back, 0, F.lit(1), 0)))
            changes.append(change(s, F.col("_w_us"), 1, F.when(has_value & ~again, 1).otherwise(0), 1))
            changes.append(change(F.col(f"_ends{i}"), end, -1, F.when(has_value, -1).otherwise(0), -1))
        signed = [F.when(F.col("_e.sign") > 0, F.col(c)).when(F.col("_e.sign") < 0, -F.col(c)).otherwise(F.lit(0).cast(EXACT)).cast(EXACT).alias(c)
                  for c in chans[:n_sums]]
        events = (timed.withColumn("_e", F.explode(F.filter(F.array(*changes), lambda e: e.isNotNull())))
                  .select(user_col, F.col("_w_s").alias("_from"), F.col("_e.s").alias("_w_s"), F.col("_e.t").alias("_w_us"), F.col("_e.w").alias("_w_w"),
                          F.col("_e.c").alias("_w_c"), F.col("_e.d").alias("_w_d"), *signed))
        out.append(events.filter("_w_s > _from").drop("_from").withColumn("_w_k", F.lit(EVENT)))
        adds = ["_w_c", "_w_d", *chans[:n_sums]]
        net = events.groupBy(user_col, "_w_s", "_w_w").agg(*[F.sum(c).alias(c) for c in adds])
        content = prior(user_col, "_w_w")
        out.append(net.select(user_col, "_w_s", "_w_w", *[F.sum(c).over(content).alias(c) for c in adds])
                   .filter("_w_c is not null").withColumn("_w_k", F.lit(CARRY)))
    if with_history:
        totals = busy.groupBy(user_col, "_w_s").agg(
            F.count(F.lit(1)).alias("n"), F.count("_w_x").alias("cnt"), F.avg("_w_x").alias("m"), F.var_samp("_w_x").alias("v"),
            F.max("_w_us").alias("last"), F.min("_w_us").alias("first"), *[F.sum(c).alias(c) for c in chans])
        w = prior(user_col)
        # deviations from the user's first slice mean, the same for all slices
        shift = F.coalesce(F.first("m", ignorenulls=True).over(Window.partitionBy(user_col).orderBy("_w_s").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
        off = F.coalesce(F.col("m") - F.col("shift"), F.lit(0.0))
        totals = totals.withColumn("shift", shift)
        totals = (totals.withColumn("dev", F.col("cnt") * off).withColumn("sq", F.col("cnt") * off * off + F.coalesce(F.col("v"), F.lit(0.0)) * F.greatest(F.col("cnt") - 1, F.lit(0))))
        carried = totals.select(
            user_col, "_w_s", "shift", F.sum("n").over(w).alias("_w_c"), F.sum("cnt").over(w).alias("_w_n"), F.sum("dev").over(w).alias("dev"),
            F.sum("sq").over(w).alias("sq"), F.max("last").over(w).alias("_w_us"), F.min("first").over(w).alias("_w_f"),
            *[F.sum(c).over(w).alias(c) for c in chans]).filter("_w_c is not null")
        mean = F.when(F.col("_w_n") > 0, F.col("shift") + F.col("dev") / F.col("_w_n")).otherwise(F.lit(0.0))
        m2 = F.when(F.col("_w_n") > 0, F.greatest(F.col("sq") - F.col("dev") * F.col("dev") / F.col("_w_n"), F.lit(0.0))).otherwise(F.lit(0.0))
        out.append(carried.withColumn("_w_m", mean).withColumn("_w_q", m2).withColumn("_w_w", F.lit(-1)).withColumn("_w_k", F.lit(CARRY))
                   .drop("shift", "dev", "sq"))
    if receiver_col:
        keys = [user_col, receiver_col]
        paid = busy.groupBy(*keys, "_w_s").agg(F.count(F.lit(1)).alias("_w_c"))
        out.append(paid.withColumn("_w_c", F.sum("_w_c").over(prior(*keys))).filter("_w_c is not null").withColumn("_w_k", F.lit(RECEIVER)))
    return out


class _Spec:
    """The columns asked for, and how one group's rows get them."""

    def __init__(self, wins, payload, user_col, id_col, receiver_col, distinct_of, sums, running, history, gap, first_seen, prior_history):
        self.wins, self.payload, self.user_col, self.id_col = wins, payload, user_col, id_col
        self.receiver_col, self.distinct_of, self.sums, self.running = receiver_col, distinct_of, sums, running
        self.history, self.gap, self.first_seen, self.prior_history = history, gap, first_seen, prior_history

    def outputs(self) -> list[tuple[str, T.DataType]]:
        long, double, out = T.LongType(), T.DoubleType(), []
        for n, _ in self.wins:
            out += [(f"tx_count_{n}", long), (f"tx_amount_{n}", double), *((f"{name}_{n}", double) for name in self.sums)]
            if self.distinct_of:
                out.append((f"distinct_{self.distinct_of}_{n}", long))
        if self.gap:
            out.append(("time_since_last_tx", double))
        for on, prefix, first in ((self.history, "user", "tx_number"), (self.prior_history, "prior", "tx_count")):
            if on:
                out += [(f"{prefix}_{first}", long), *((f"{prefix}_{x}_amount", double) for x in ("total", "avg", "std"))]
        if self.receiver_col:
            out.append(("receiver_tx_count", long))
        out += [(name, double) for name, _ in self.running]
        return out + ([("user_first_us", long)] if self.first_seen else [])

    def run(self, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table["_w_k"].to_numpy()
        user = codes(table[self.user_col])
        segment = user * (int(table["_w_s"].to_numpy().max(initial=0)) + 1) + table["_w_s"].to_numpy()
        time = pc.fill_null(table["_w_us"], sg.NULL_TIME).to_numpy()
        data = np.flatnonzero(kind == ROW)
        order = data[sorted_rows(segment[data], time[data], table[self.id_col], data)]
        names, numbers = np.unique(segment[order], return_inverse=True)
        rows = sg.Rows(numbers, time[order])
        here = np.minimum(np.searchsorted(names, segment), max(len(names) - 1, 0))
        known = names[here] == segment if len(names) else np.zeros(len(segment), bool)
        pick = {k: np.flatnonzero((kind == k) & known) for k in (CARRY, EVENT, RECEIVER, VALUE)}
        made = self.features(rows, Group(table, order, here, time, pick, len(names)))
        out = table.select(self.payload).take(pa.array(order))
        for n, t in self.outputs():
            out = out.append_column(n, pa.array(made[n], pa.int64() if isinstance(t, T.LongType) else pa.float64(), mask=made.get((n, "null"))))
        return out

    def features(self, rows: sg.Rows, g: "Group") -> dict:
        out, seg = {}, rows.segment
        amount = g.channel(0)
        adds = [np.concatenate([np.ones((rows.n, 1), np.int64), amount, *(g.channel(1 + k) for k in range(len(self.sums)))], 1)]
        total = sg.prefix(adds[0]) if self.wins else None
        if self.distinct_of:
            value, valid = g.value(self.distinct_of)
            last = g.last_time(rows, value, valid)
        for i, (n, width) in enumerate(self.wins):
            content = sg.since(rows, total, rows.window_start(width))
            before, events = g.content(i, total.shape[1])
            content = content + (before[seg] + events.until(rows)[:, :-1]) * rows.timed[:, None] if g.cut else content
            out[f"tx_count_{n}"] = content[:, 0]
            for k, name in enumerate(["tx_amount", *self.sums]):
                out[f"{name}_{n}"] = sg.doubles(content[:, 1 + 4 * k:5 + 4 * k])
            if self.distinct_of:
                alive = sg.distinct(rows, width, valid, last)
                out[f"distinct_{self.distinct_of}_{n}"] = alive + (g.alive(i)[seg] + events.until(rows)[:, -1]) * rows.timed if g.cut else alive
        if self.gap:
            prev = np.where(rows.at > rows.first, np.append(sg.NULL_TIME, rows.time[:-1]) if rows.n else rows.time, g.last()[seg])
            known = rows.timed & (prev != sg.NULL_TIME)
            out["time_since_last_tx"] = np.where(known, (rows.time - np.where(known, prev, rows.time)) // (60 * US), 0).astype(float)
        if self.history or self.prior_history:
            self.statistics(rows, g, amount, out)
        if self.receiver_col:
            value, _ = g.value(self.receiver_col)
            out["receiver_tx_count"] = sg.earlier_equal(rows, value)[0] + g.paid(rows, value)
        for k, (name, included) in enumerate(self.running):
            channel = 1 + len(self.sums) + k
            run = sg.prefix(g.channel(channel))
            out[name] = sg.doubles(run[rows.at + included] - run[rows.first] + g.base(channel)[seg])
        if self.first_seen:
            firsts = np.full(len(rows.start), sg.NULL_TIME)
            timed = np.flatnonzero(rows.timed)[::-1]
            firsts[seg[timed]] = rows.time[timed]
            earlier = g.first()
            first = np.where(earlier != sg.NULL_TIME, earlier, firsts)[seg]
            out["user_first_us"] = first
            out["user_first_us", "null"] = (first == sg.NULL_TIME) | ~(rows.timed | (earlier != sg.NULL_TIME)[seg])
        return out

    def statistics(self, rows: sg.Rows, g: "Group", amount: np.ndarray, out: dict) -> None:
        seg = rows.segment
        run = sg.prefix(amount)
        n0, cnt0, mean0, m20 = g.moments()
        cnt, mean, m2 = sg.moments(rows, g.x(), cnt0, mean0, m20)
        deviation = lambda c, q: np.sqrt(np.where(c > 1, np.maximum(q, 0), 0) / np.maximum(c - 1, 1))
        number = n0[seg] + rows.at - rows.first
        base = g.base(0)[seg] - run[rows.first]
        if self.history:
            total = sg.doubles(run[rows.at + 1] + base)
            out["user_tx_number"] = number + 1
            out["user_total_amount"], out["user_total_amount", "null"] = total, cnt == 0
            out["user_avg_amount"], out["user_avg_amount", "null"] = total / np.maximum(cnt, 1), cnt == 0
            out["user_std_amount"] = deviation(cnt, m2)
        if self.prior_history:
            inner = rows.at > rows.first
            step = lambda x, x0: np.where(inner, np.append(0, x[:-1]) if rows.n else x, x0[seg])
            c, q = step(cnt, cnt0.astype(float)), step(m2, m20)
            total = sg.doubles(run[rows.at] + base)
            out["prior_tx_count"] = number
            out["prior_total_amount"] = total
            out["prior_avg_amount"] = np.where(c > 0, total / np.maximum(c, 1), 0)
            out["prior_std_amount"] = deviation(c, q)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values -> equal numbers from 0; null is a value."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], column.type)
    return array.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def sorted_rows(segment: np.ndarray, time: np.ndarray, ids: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """The order by (segment, time, id); ids are compared only where needed."""
    order = np.lexsort((time, segment))
    same = (segment[order][1:] == segment[order][:-1]) & (time[order][1:] == time[order][:-1])
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(order) else order
    if len(tied):
        some = order[tied]
        run = np.cumsum(~np.append(False, same)) if len(order) else order
        keys = pa.table({"run": run[tied], "id": ids.take(pa.array(at[some]))})
        by = pc.sort_indices(keys, sort_keys=[("run", "ascending"), ("id", "ascending")], null_placement="at_start")
        order[tied] = some[by.to_numpy()]
    return order


class Group:
    """One group's table: columns of its sorted rows, carries by segment."""

    def __init__(self, table, order, here, time, pick, n):
        self.table, self.order, self.here, self.time, self.pick, self.n = table, order, here, time, pick, n
        self.cut = any(len(p) for p in pick.values())
        carry = pick[CARRY]
        self.window = pc.fill_null(table["_w_w"], -2).to_numpy()
        self.past = carry[self.window[carry] == -1]

    def column(self, name: str, at: np.ndarray):
        out = self.table[name].take(pa.array(at)).combine_chunks()
        return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out

    def longs(self, name: str, at: np.ndarray) -> np.ndarray:
        return pc.fill_null(self.column(name, at), 0).to_numpy(zero_copy_only=False)

    def channel(self, i: int) -> np.ndarray:
        return sg.limbs(self.column(f"_w_a{i}", self.order))

    def x(self) -> np.ndarray:
        return pc.fill_null(self.column("_w_x", self.order), float("nan")).to_numpy(zero_copy_only=False)

    def value(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rows' values, and which are not null. The carries'
        codes are kept for ``last_time`` and ``paid``."""
        self.all_codes = codes(self.table[name])
        return self.all_codes[self.order], self.column(name, self.order).is_valid().to_numpy(zero_copy_only=False)

    def carried(self, rows: sg.Rows, value: np.ndarray, kind: int, carried: np.ndarray, none: int) -> np.ndarray:
        """What was carried for each row's (segment, value)."""
        at = self.pick[kind]
        out = np.full(rows.n, none)
        if len(at) and rows.n:
            width = int(self.all_codes.max()) + 1
            keys = self.here[at] * width + self.all_codes[at]
            order = np.argsort(keys)
            keys, carried = keys[order], carried[order]
            want = rows.segment * width + value
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out = np.where(keys[place] == want, carried[place], none)
        return out

    def paid(self, rows: sg.Rows, value: np.ndarray) -> np.ndarray:
        return self.carried(rows, value, RECEIVER, self.longs("_w_c", self.pick[RECEIVER]), 0)

    def last_time(self, rows: sg.Rows, value: np.ndarray, valid: np.ndarray) -> np.ndarray:
        last = sg.earlier_equal(rows, value)[1]
        before = self.carried(rows, value, VALUE, self.time[self.pick[VALUE]], sg.NULL_TIME)
        return np.where(last >= 0, rows.time[np.maximum(last, 0)], before) if rows.n else before

    def changes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Counts and limbs of carry or event rows, distinct values last."""
        parts = [self.longs("_w_c", at)[:, None]] + [sg.limbs(self.column(f"_w_a{i}", at)) for i in range((width - 1) // 4)]
        return np.concatenate([*parts, self.longs("_w_d", at)[:, None]], 1)

    def content(self, i: int, width: int) -> tuple[np.ndarray, sg.Events]:
        carry = self.pick[CARRY][self.window[self.pick[CARRY]] == i]
        before = np.zeros((self.n, width + 1), np.int64)
        before[self.here[carry]] = self.changes(carry, width)
        self.before = before[:, -1]
        at = self.pick[EVENT][self.window[self.pick[EVENT]] == i]
        return before[:, :-1], sg.Events(self.here[at], self.time[at], self.changes(at, width))

    def alive(self, i: int) -> np.ndarray:
        return self.before

    def by_segment(self, values: np.ndarray, none) -> np.ndarray:
        out = np.full((self.n, *values.shape[1:]), none, values.dtype)
        out[self.here[self.past]] = values
        return out

    def base(self, i: int) -> np.ndarray:
        return self.by_segment(sg.limbs(self.column(f"_w_a{i}", self.past)), 0)

    def last(self) -> np.ndarray:
        return self.by_segment(self.time[self.past], sg.NULL_TIME)

    def first(self) -> np.ndarray:
        return self.by_segment(pc.fill_null(self.column("_w_f", self.past), sg.NULL_TIME).to_numpy(zero_copy_only=False), sg.NULL_TIME)

    def moments(self) -> tuple[np.ndarray, ...]:
        """Rows, values, their mean and squared deviations before a segment."""
        at = self.past
        doubles = [pc.fill_null(self.column(c, at), 0.0).to_numpy(zero_copy_only=False) for c in ("_w_m", "_w_q")]
        return self.by_segment(self.longs("_w_c", at), 0), self.by_segment(self.longs("_w_n", at), 0), *(self.by_segment(d, 0.0) for d in doubles)


def previous_values(df: DataFrame, cols: list[str], bucket_seconds: int = DEFAULT_BUCKET, *,
                    user_col: str = "user_id", ts_col: str = "timestamp",
                    id_col: str = "transaction_id") -> DataFrame:
    """``prev_<c>``: value of ``c`` on the user's previous row in
    (timestamp, id) order, NULL on the first row.

    Skew-safe like ``time_window_features``: partitions are (user, bucket);
    a bucket's first row takes the last row of the user's latest earlier
    bucket, found from a per-bucket ``max_by`` and a window over the
    bucket table, and delivered as a carry row."""
    B = int(bucket_seconds) * US
    base = df.withColumn("_pv_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    base = base.withColumn("_pv_b", _bucket("_pv_us", B))
    key = F.struct(F.col("_pv_us"), F.col(id_col))
    last = base.groupBy(user_col, "_pv_b").agg(*[F.max_by(F.col(c), key).alias(f"_l_{c}") for c in cols])
    wl = Window.partitionBy(user_col).orderBy("_pv_b")
    carry = last.select(user_col, "_pv_b", *[F.lag(f"_l_{c}").over(wl).alias(f"_l_{c}") for c in cols],
                        F.lag("_pv_b").over(wl).isNotNull().alias("_pv_has"))
    carry = carry.filter("_pv_has").drop("_pv_has")
    rows = base.select("*", F.lit(1).alias("_pv_k"), *[F.lit(None).cast(base.schema[c].dataType)
                                                     .alias(f"_l_{c}") for c in cols])
    carry_rows = carry.select(
        *[F.col(user_col) if c == user_col else F.lit(None).cast(base.schema[c].dataType).alias(c)
          for c in base.columns if c not in ("_pv_b",)],
        "_pv_b", F.lit(0).alias("_pv_k"), *[F.col(f"_l_{c}") for c in cols])
    u = rows.unionByName(carry_rows.select(*rows.columns)).repartition(user_col, "_pv_b")
    w = Window.partitionBy(user_col, "_pv_b").orderBy(F.col("_pv_k"), F.col("_pv_us"), F.col(id_col))
    # the carry row, if there is one, is the bucket's first
    out = u.select("*", *[F.when(F.lag("_pv_k").over(w) == 0, F.lag(f"_l_{c}").over(w)).otherwise(F.lag(c).over(w)).alias(f"_p_{c}")
                          for c in cols])
    out = out.filter(F.col("_pv_k") == 1)
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"_p_{c}").alias(f"prev_{c}") for c in cols])
