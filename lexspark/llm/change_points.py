"""Penalised change points: a day series cut where its spread changes, by best-first search.

A segment of n days with sum S and sum of squares Q costs ``n * floor(1000 * ln(V))`` with
``V = 1 + floor((n * Q - S * S) / (n * n))``; every cut costs ``penalty``. For each end day the best
last segment is sought among all its starts:

* The starts are leaves of a range tree. A node knows the least *prefix cost* of its starts (the
  best cost of what lies before them), taken relative to a steady cost a day, so that the bound of a wide
  block stays close.
* The squared error of a segment only grows when it begins earlier. So the shortest segment of a
  block of starts bounds the squared error of all of them from below, and with the longest length
  their daily cost.
* Blocks are opened in order of their bounds until no open one could hold a better or a tied
  start. Of equal costs the one with fewest segments wins, then the earliest start; as what lies before
  a start is chosen by the same rule, starts are compared from the last segment backwards.

The plan: partial sums by key and day (a hot key costs each task one row a day), one row a key with its
days, and the search inside tasks, for many series in step. A series is bounded by the calendar, never by the
number of rows; nothing goes to the driver.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, require

LEAST, PENALTY = 7, 20_000
#: Starts that the search meets together at the foot of the tree, and days of the series searched in step.
BUCKET, CELLS = 8, 1 << 19
_FAR = np.int64(1) << np.int64(61)


def day_costs(spread: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(V))``."""
    return np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64)


class _Series:
    """Prefix sums of series of like length, one a row; sums that 64 bits cannot hold become Python's integers."""

    def __init__(self, values: np.ndarray, n: np.ndarray) -> None:
        self.n, self.width = n, values.shape[1] + 1
        inside = np.arange(values.shape[1])[None, :] < n[:, None]
        with np.errstate(over="ignore"):
            centre = np.rint(np.where(inside, values, 0).sum(axis=1, dtype=np.float64) / n).astype(np.int64)
        # the spread does not change with the origin
        held = np.where(inside, values.astype(object) - centre[:, None].astype(object), 0)
        if int(np.abs(held).max(initial=0)) ** 2 * self.width**2 < 2**61:
            held = held.astype(np.int64)
        zero = np.zeros((len(n), 1), dtype=held.dtype)
        self.one, self.two = (np.concatenate([zero, np.cumsum(x, axis=1)], axis=1).ravel() for x in (held, held * held))

    def spread(self, row: np.ndarray, a: np.ndarray, e: np.ndarray, over: np.ndarray) -> np.ndarray:
        """``1 + floor(SSE / over)`` of the segments from ``a`` up to ``e``."""
        at, end, n = row * self.width + a, row * self.width + e, e - a
        s = self.one[end] - self.one[at]
        return 1 + (n * (self.two[end] - self.two[at]) - s * s) // (n * over)

    def cost(self, row: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (e - a) * day_costs(self.spread(row, a, e, e - a))


class _Search:
    """Best-first search over range trees of starts, one tree a series, all series in step."""

    def __init__(self, series: _Series, least: int, penalty: int) -> None:
        self.series, self.least, self.penalty = series, least, penalty
        self.rows, days = len(series.n), series.width
        self.short = np.minimum(least, series.n)
        self.leaves = 1 << max(0, int(-(-days // BUCKET) - 1).bit_length())
        starts = self.leaves * BUCKET
        self.prefix = np.full((self.rows, starts), _FAR)
        self.parts = np.zeros((self.rows, days), dtype=np.int64)
        self.start = np.zeros((self.rows, days), dtype=np.int64)
        row = np.arange(self.rows)
        self.steady = day_costs(series.spread(row, np.zeros_like(row), series.n, series.n))
        self.low = np.full((self.rows, 2 * self.leaves), _FAR)
        level = np.floor(np.log2(np.maximum(np.arange(2 * self.leaves), 1))).astype(np.int64)
        self.span = starts >> level
        self.first = (np.arange(2 * self.leaves) - (1 << level)) * self.span
        self.open = np.full((self.rows, 2 * self.leaves), _FAR)
        self.pops = 0
        self._put(row, 0, np.full(self.rows, -penalty))

    def _put(self, row: np.ndarray, start: int, cost: np.ndarray) -> None:
        """The prefix cost of a start, and what the nodes above it know."""
        self.prefix[row, start] = cost
        tilted, node = cost - self.steady[row] * start, self.leaves + start // BUCKET
        while node:
            self.low[row, node] = np.minimum(self.low[row, node], tilted)
            node >>= 1

    def _bound(self, row: np.ndarray, node: np.ndarray, end: int) -> np.ndarray:
        """No start of the block costs less than this; blocks without a start are far."""
        a, low, steady = self.first[node], self.low[row, node], self.steady[row]
        b = np.minimum(a + self.span[node] - 1, end - self.short[row])
        held = (a <= b) & (low < _FAR // 2)
        b = np.where(held, b, 0)
        a = np.where(held, a, 0)
        e = np.full_like(a, end)
        shortest, longest = e - b, e - a
        rate = day_costs(self.series.spread(row, b, e, longest)) - steady
        bound = low + steady * end + self.penalty + rate * np.where(rate >= 0, shortest, longest)
        return np.where(held, bound, _FAR)

    def _tried(self, row: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of ``starts`` (a row of them for each of ``row``): cost, segments, start."""
        prefix = self.prefix[row[:, None], starts]
        held = (starts <= (end - self.short[row])[:, None]) & (prefix < _FAR)
        a = np.where(held, starts, 0)
        r = np.repeat(row, starts.shape[1])
        cost = self.series.cost(r, a.ravel(), np.full(a.size, end)).reshape(a.shape)
        total = np.where(held, prefix + self.penalty + cost, _FAR)
        best = total.min(axis=1)
        held &= total == best[:, None]
        parts = np.where(held, self.parts[row[:, None], a], _FAR)
        fewest = parts.min(axis=1)
        place = np.argmax(parts == fewest[:, None], axis=1)
        return best, fewest + 1, starts[np.arange(len(row)), place]

    def _end(self, row: np.ndarray, end: int) -> None:
        """The best last segment up to ``end`` of every series of ``row``."""
        # what was best a day before begins as the one to beat; the first start is always possible
        known = self.start[row, end - 1]
        cost, parts, start = self._tried(row, np.stack([np.zeros_like(known), known], axis=1), end)
        opened = self.open[: len(row)]
        opened.fill(_FAR)
        opened[:, 1] = self._bound(row, np.ones_like(row), end)
        active = np.arange(len(row))
        while len(active):
            mine = opened[active]
            node = mine.argmin(axis=1)
            alive = mine[np.arange(len(active)), node] <= cost[active]
            active, node = active[alive], node[alive]
            self.pops += len(active)
            opened[active, node] = _FAR
            inner = node < self.leaves
            at, up = active[inner], node[inner]
            for child in (2 * up, 2 * up + 1):
                opened[at, child] = self._bound(row[at], child, end)
            at, leaf = active[~inner], node[~inner]
            if len(at):
                c, p, s = self._tried(row[at], self.first[leaf][:, None] + np.arange(BUCKET), end)
                better = (c < cost[at]) | (c == cost[at]) & ((p < parts[at]) | (p == parts[at]) & (s < start[at]))
                at = at[better]
                cost[at], parts[at], start[at] = c[better], p[better], s[better]
        self.parts[row, end], self.start[row, end] = parts, start
        self.total = cost
        if end >= self.least:
            self._put(row, end, cost)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, start, end)`` of every segment in order, and the best cost of every series."""
        n, best = self.series.n, np.zeros(self.rows, dtype=np.int64)
        for end in range(int(self.short.min()), int(n.max()) + 1):
            row = np.flatnonzero((self.short <= end) & (end <= n))
            if len(row):
                self._end(row, end)
                last = n[row] == end
                best[row[last]] = self.total[last]
        row, end, found = np.arange(self.rows), n.copy(), []
        while len(row):
            start = self.start[row, end]
            found.append((row, start, end))
            row, end = row[start > 0], start[start > 0]
        rows, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((starts, rows))
        return rows[order], starts[order], ends[order], best


def segment_series(series: list[np.ndarray], least: int = LEAST, penalty: int = PENALTY) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(starts, spreads, costs, best cost)`` of each series of daily sums (none of them empty)."""
    out: list = [None] * len(series)
    order, at = sorted(range(len(series)), key=lambda i: len(series[i])), 0
    while at < len(order):
        # as many of the next longer ones as fit
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(series[order[end]]) <= CELLS:
            end += 1
        group = order[at:end]
        n = np.array([len(series[i]) for i in group])
        values = np.zeros((len(group), int(n.max())), dtype=np.int64)
        for k, i in enumerate(group):
            values[k, : n[k]] = series[i]
        held = _Series(values, n)
        rows, starts, ends, best = _Search(held, least, penalty).run()
        spreads = held.spread(rows, starts, ends, ends - starts)
        costs = (ends - starts) * day_costs(spreads)
        edges = np.searchsorted(rows, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            part = slice(edges[k], edges[k + 1])
            out[i] = starts[part], spreads[part], costs[part], int(best[k])
        at = end
    return out


def _segments(least: int, penalty: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Segments of every row ``(key, days)`` of a batch."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy()
    day, value = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    series, firsts = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        low = day[a:b].min()
        whole = np.zeros(int(day[a:b].max() - low) + 1, dtype=np.int64)
        whole[day[a:b] - low] = value[a:b]
        series.append(whole)
        firsts.append(low)
    held: dict[str, list] = {c: [] for c in ("key", "no", "first", "n", "total", "spread", "cost", "parts", "best")}
    for i, (starts, spreads, costs, best) in enumerate(segment_series(series, least, penalty)):
        k = len(starts)
        held["key"].append(np.full(k, i))
        held["no"].append(np.arange(1, k + 1))
        held["first"].append(firsts[i] + starts)
        held["n"].append(np.diff(starts, append=len(series[i])))
        held["total"].append(np.add.reduceat(series[i], starts))
        held["spread"].append(spreads.astype(np.int64))
        held["cost"].append(costs)
        held["parts"].append(np.full(k, k))
        held["best"].append(np.full(k, best))
    flat = {c: np.concatenate(x) if x else np.empty(0, dtype=np.int64) for c, x in held.items()}
    columns = [batch.column(0).take(pa.array(flat.pop("key")))] + [pa.array(x, pa.int32() if c == "no" else pa.int64()) for c, x in flat.items()]
    return pa.RecordBatch.from_arrays(columns, names=["key", "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"])


def change_points(rows: DataFrame, key: str, time: str, value: str, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """``(<key>, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost)``, one row a segment.

    The series of a key is the sum of the whole-numbered ``value`` on each day of ``time`` (a date or a time), from its
    first to its last day; days between without rows count 0. Segments have ``least`` days at least; a
    shorter series is one segment. ``first_day`` counts days since 1970, ``segment_no`` from 1, ``best_cost``
    is that of the whole series with its penalties.

    Defined cases: rows whose ``time`` or ``value`` is null are left out, and a key without other rows has no series; a
    null key has a series like any other; repeated rows add up; negative values are allowed; ties go to fewest
    segments, then to the earliest starts from the last segment backwards; other columns are ignored, whatever their names;
    an empty table gives an empty table.
    """
    require(rows, key, time, value)
    held = rows.select(F.col(key).alias("key"), F.unix_date(F.col(time).cast("date")).cast("long").alias("day"), F.col(value).cast("long").alias("value"))
    daily = held.where("day is not null and value is not null").groupBy("key", "day").agg(F.sum("value").alias("value"))
    series = daily.groupBy("key").agg(F.collect_list(F.struct("day", "value")).alias("days"))
    longs = [T.StructField(c, T.LongType()) for c in ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")]
    schema = T.StructType([T.StructField("key", held.schema["key"].dataType), T.StructField("segment_no", T.IntegerType()), *longs])
    out = map_arrow(series, partial(_segments, least, penalty), schema)
    return out.withColumnRenamed("key", key)
