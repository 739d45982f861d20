"""Window arithmetic on sorted rows, for the batch job and the stream.

Rows are sorted by (segment, time, id); a segment is a user, or one time
slice of a busy user. Every function works on whole arrays: window bounds by
binary search, sums by differences of prefix sums. Amounts are integers of
10^-12 held in four 32-bit limbs, so these differences are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NULL_TIME = -(1 << 62)  # sorts first
UNIT = 10 ** 12
LOW = 0xFFFFFFFF


def limbs(amounts: pa.Array) -> np.ndarray:
    """decimal(38, 12) values -> (n, 4) limbs, lowest first; null: zero."""
    n = len(amounts)
    if n == 0:
        return np.zeros((0, 4), np.int64)
    raw = np.frombuffer(amounts.buffers()[1], np.int64)[2 * amounts.offset:2 * (amounts.offset + n)].reshape(n, 2)
    low, high = raw[:, 0], raw[:, 1]
    out = np.stack([low & LOW, (low >> 32) & LOW, high & LOW, high >> 32], axis=1)
    if amounts.null_count:
        out[amounts.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


def doubles(sums: np.ndarray) -> np.ndarray:
    """Limb sums -> the nearest doubles."""
    s0, s1, s2, s3 = sums.T
    rough = s0 + s1 * 2.0 ** 32 + s2 * 2.0 ** 64 + s3 * 2.0 ** 96
    whole = s0 + (s1 << 32)  # exact where the sum fits into 64 bits
    micro, rest = np.divmod(whole, 10 ** 6)
    out = micro / 1e6
    odd = (np.abs(rough) >= 2.0 ** 62) | ((rest != 0) | (np.abs(micro) >= 1 << 53)) & (np.abs(rough) >= 2.0 ** 53)
    few = (rest != 0) & ~odd
    out[few] = whole[few] / 1e12
    for i in np.flatnonzero(odd):
        out[i] = (int(s0[i]) + (int(s1[i]) << 32) + (int(s2[i]) << 64) + (int(s3[i]) << 96)) / UNIT
    return out


def prefix(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... n rows."""
    out = np.zeros((len(x) + 1, *x.shape[1:]), np.int64)
    np.cumsum(x, axis=0, out=out[1:])
    return out


class Before:
    """How many of some (segment, time) pairs, sorted, stand before others."""

    def __init__(self, segment: np.ndarray, time: np.ndarray):
        self.times = np.unique(time)
        self.width = len(self.times) + 1
        self.keys = segment * self.width + np.searchsorted(self.times, time)

    def __call__(self, segment: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Pairs of smaller segments, and of the same one with less time."""
        return np.searchsorted(self.keys, segment * self.width + np.searchsorted(self.times, time))


class Rows:
    """Sorted rows. ``segment`` numbers start at 0 without gaps."""

    def __init__(self, segment: np.ndarray, time: np.ndarray):
        self.segment, self.time = segment, time
        self.n = len(segment)
        self.at = np.arange(self.n)
        self.start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if self.n else np.empty(0, np.int64)
        self.length = np.diff(np.append(self.start, self.n))
        self.first = self.start[segment] if self.n else self.at
        self.timed = time != NULL_TIME
        self._before = None

    def before(self) -> Before:
        if self._before is None:
            self._before = Before(self.segment, self.time)
        return self._before

    def window_start(self, width: int) -> np.ndarray:
        """The first row with a time at or after each row's time - width;
        rows without a time have no window."""
        return np.where(self.timed, self.before()(self.segment, np.where(self.timed, self.time - width, 0)), self.at)


class Events:
    """Changes of a window's content at a time, by segment; a row sees those
    before its own time."""

    def __init__(self, segment: np.ndarray, time: np.ndarray, changes: np.ndarray):
        order = np.lexsort((time, segment))
        self.segment, self.time = segment[order], time[order]
        self.sums = prefix(changes[order])

    def until(self, rows: Rows) -> np.ndarray:
        if len(self.segment) == 0:
            return np.zeros((rows.n, *self.sums.shape[1:]), np.int64)
        upto = Before(self.segment, self.time)(rows.segment, rows.time)
        return self.sums[upto] - self.sums[np.searchsorted(self.segment, rows.segment)]


def since(rows: Rows, sums: np.ndarray, start: np.ndarray) -> np.ndarray:
    """From prefix sums: the rows from ``start`` up to, without, each row."""
    return sums[rows.at] - sums[start]


def earlier_equal(rows: Rows, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many earlier rows of the segment have its value, and the
    last of them (-1: none). ``value``: codes from 0."""
    key = rows.segment * (int(value.max(initial=0)) + 1) + value
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if rows.n else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(new, rows.at, 0)) if rows.n else rows.at
    count, last = np.empty(rows.n, np.int64), np.empty(rows.n, np.int64)
    count[order] = rows.at - begin
    last[order] = np.where(new, -1, np.append(-1, order[:-1]) if rows.n else order)
    return count, last


def distinct(rows: Rows, width: int, valid: np.ndarray, last_time: np.ndarray) -> np.ndarray:
    """Distinct valid values in [time - width, time], the row included, given
    the time of the value's previous row (NULL_TIME: none). A value that stands
    again within the width counts on from the end of its previous stay."""
    live = valid & rows.timed
    ends = last_time + width
    again = live & (last_time != NULL_TIME) & (ends >= rows.time)
    begun = prefix((live & ~again).astype(np.int64))
    out = begun[rows.at + 1] - begun[rows.first]
    for when, which, sign in ((ends, again, 1), (rows.time + width, live, -1)):
        e = np.flatnonzero(which)
        out = out + Events(rows.segment[e], when[e], np.full(len(e), sign, np.int64)).until(rows)
    return out


def moments(rows: Rows, x: np.ndarray, n0: np.ndarray, mean0: np.ndarray, m20: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running count, mean and sum of squared deviations of the values that
    are not NaN, each row included, going on from each segment's start
    values. All segments take their next row at the same time."""
    order = np.argsort(-rows.length, kind="stable")
    start, length = rows.start[order], rows.length[order]
    n, mean, m2 = n0[order].astype(float), mean0[order].astype(float), m20[order].astype(float)
    out_n, out_mean, out_m2 = np.empty(rows.n), np.empty(rows.n), np.empty(rows.n)
    j, k = 0, len(start)
    while k > 8 and j < (length[0] if len(length) else 0):
        k = np.searchsorted(-length, -j)  # segments with more than j rows
        if k <= 8:
            break
        at = start[:k] + j
        v = x[at]
        ok = ~np.isnan(v)
        n[:k] += ok
        d = np.where(ok, v - mean[:k], 0.0)
        mean[:k] += d / np.maximum(n[:k], 1)
        m2[:k] += d * np.where(ok, v - mean[:k], 0.0)
        out_n[at], out_mean[at], out_m2[at] = n[:k], mean[:k], m2[:k]
        j += 1
    for s in range(int(np.searchsorted(-length, -j))):  # a few long ones
        a, b = int(start[s]) + j, int(start[s] + length[s])
        c, mu, q = float(n[s]), float(mean[s]), float(m2[s])
        rest = []
        for v in x[a:b].tolist():
            if v == v:
                c += 1.0
                d = v - mu
                mu += d / c
                q += d * (v - mu)
            rest.append((c, mu, q))
        if rest:
            out_n[a:b], out_mean[a:b], out_m2[a:b] = np.array(rest).T
    return out_n, out_mean, out_m2
