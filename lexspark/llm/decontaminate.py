"""Benchmark decontamination by the q-gram lemma.

Two strings of which one has m characters and which are ``e`` edits apart share at least
m - q + 1 - e*q character q-grams, on diagonals no more than ``e`` apart. Each shared q-gram of
a document and a benchmark item is counted in the two overlapping diagonal bands it lies in;
a band that reaches the item's bound is a region to verify, by an alignment restricted to
that band. Nothing that is within the budget is missed.

An item too short for that bound to be positive at twelve characters gets shorter q-grams, so
that every length keeps its budget. Hits are counted in slices: a text and an item of one
repeated character meet everywhere, and their bands are few.

The items are a stated query set: they are read in blocks whose text is bounded by
``BLOCK_CHARS``, and each block's index meets all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import decode, fresh, map_arrow, mix, require, text_bytes

#: Characters of a gram at most, edits allowed for each 100 characters of an item.
GRAM, EDITS_PER_100 = 12, 5
#: Benchmark characters of a block (some 20 bytes of index each), what an item counts for besides its
#: characters, document characters handled at once, and hits counted at once.
BLOCK_CHARS, ITEM_CHARS, STRETCH, HITS = 2_000_000, 100, 2_000_000, 1 << 20
#: Stands between documents and in no text.
_GAP = 0x110000

# One code point stays one: letters below 0x250 in lower case, white space as a space.
_FOLD = np.array([ord(low) if len(low := chr(c).lower()) == 1 and not chr(c).isspace() else (32 if chr(c).isspace() else c) for c in range(0x250)], dtype=np.uint32)


def fold(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points)


def grams(points: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` characters from each position on; twelve by doubling 2, 4, 8, 12."""
    p = points.astype(np.uint64)
    n = len(p) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if size == 12:
            two = p[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[1:]
            four = two[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]
            return mix(four[:-8] * np.uint64(0xD6E8FEB86659FD93) + four[4:-4] * np.uint64(0xA0761D6478BD642F) + four[8:])
        total = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + p[i : i + n] + np.uint64(1)
    return mix(total)


class _Postings:
    """Where the q-grams of one size stand in the items: sorted grams, and items and places."""

    BITS = 22

    def __init__(self, size: int, items: list[int], texts: list[np.ndarray]) -> None:
        self.size = size
        each = [grams(texts[i], size) for i in items]
        many = [len(g) for g in each]
        flat = np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.array(items, dtype=np.int32), many)[order]
        self.place = np.concatenate([np.arange(n, dtype=np.int32) for n in many])[order]
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.r_[first, len(flat)].astype(np.int32)
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[(self.grams >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(position, item, place in item)`` of shared q-grams by position, ``HITS`` at a time."""
        found = grams(points, self.size)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
        row = np.searchsorted(self.grams, found[at])
        row[row == len(self.grams)] = 0
        same = self.grams[row] == found[at]
        at, row = at[same], row[same]
        ends = np.cumsum(self.first[row + 1] - self.first[row], dtype=np.int64)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, HITS):
            number = np.arange(begin, min(begin + HITS, int(ends[-1])))
            k = np.searchsorted(ends, number, side="right")
            entry = self.first[row[k] + 1] - (ends[k] - number)
            yield at[k], self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)


class ItemIndex:
    """The q-grams of a block of items, and each item's edit budget and bound."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        held = [(i, f) for i, t in items if t is not None and len(f := fold(t))]
        self.ids = np.array([i for i, _ in held], dtype=np.int64)
        self.texts = [f for _, f in held]
        length = np.array([len(f) for f in self.texts], dtype=np.int64)
        self.length, self.edits = length, length * EDITS_PER_100 // 100
        size = np.minimum(GRAM, length // (self.edits + 1))  # leaves a bound of one gram or more
        self.bound = length - size + 1 - self.edits * size
        self.postings = [_Postings(s, np.flatnonzero(size == s).tolist(), self.texts) for s in sorted(set(size.tolist()))]

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, first diagonal, end diagonal)`` of the bands that reach their bound."""
        span = 2 * len(points) + 2
        out = []
        for postings in self.postings:
            keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            for at, item, place in postings.hits(points):
                band = (at - place + len(points)) // (self.edits[item] + 1)  # shifted, so never negative
                both = np.concatenate([keys, item * span + band, item * span + band - 1])
                weights = np.concatenate([counts, np.ones(2 * len(at), dtype=np.int64)])
                keys, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, weights).astype(np.int64)
                i, b = keys // span, keys % span
                # a band that ends before this slice began gets no more hits
                open_ = (b + 2) * (self.edits[i] + 1) - len(points) + self.length[i] >= at[0]
                full = counts >= self.bound[i]
                out += [(int(x), int(y)) for x, y in zip(i[full & ~open_], b[full & ~open_], strict=True)]
                keys, counts = keys[open_], counts[open_]
            full = counts >= self.bound[keys // span]
            out += [divmod(k, span) for k in keys[full].tolist()]
        strides = [int(self.edits[i]) + 1 for i, _ in out]
        return [(i, b * s - len(points), (b + 2) * s - len(points)) for (i, b), s in zip(out, strides, strict=True)]


def banded(item: np.ndarray, points: np.ndarray, lo: int, hi: int, budget: int) -> tuple[int, int, int] | None:
    """Best ``(edits, start, end)`` of ``item`` within ``points`` on alignments that begin and
    stay within ``budget`` of the diagonals lo..hi-1; None beyond ``budget``."""
    for d in range(lo, hi):  # an exact copy needs no table
        if 0 <= d and d + len(item) <= len(points) and points[d] == item[0] and np.array_equal(points[d : d + len(item)], item):
            return 0, d, d + len(item)
    lo, hi = lo - budget, hi + budget
    width = hi - lo
    steps = np.arange(width)
    big = np.int64(len(item) + width + 1)
    # Cell k of row r stands for r item characters and the text up to position lo + k + r.
    ends = lo + steps
    row = np.where((ends >= 0) & (ends <= len(points)), 0, big).astype(np.int64)
    origin = ends.copy()
    for r, c in enumerate(item):
        ends = lo + steps + r + 1
        inside = (ends >= 0) & (ends <= len(points))
        has = (ends >= 1) & (ends <= len(points))
        letter = points[np.clip(ends - 1, 0, len(points) - 1)] if len(points) else np.zeros(width, dtype=np.uint32)
        swap = np.where(has, row + (letter != c), big)
        drop = np.append(row[1:] + 1, big)  # the item's character is missing in the text
        best = np.where(swap <= drop, swap, drop)
        start = np.where(swap <= drop, origin, np.append(origin[1:], 0))
        best = np.where(inside, best, big)
        # text characters that the item lacks: a running minimum along the row
        slack = best - steps
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, steps, 0))
        row, origin = np.where(inside, low + steps, big), start[source]
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), int(origin[k]), int(lo + k + len(item))


def _stretches(texts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Neighbouring documents laid end to end with a gap, ``STRETCH`` characters at a time; a
    longer document stands alone, whole."""
    rows: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if rows and (t is None or size + len(t) > STRETCH):
            parts = [x for r in rows for x in (texts[r], np.array([_GAP], dtype=np.uint32))]
            starts = np.cumsum([0, *(len(texts[r]) + 1 for r in rows)])
            yield rows, starts, np.concatenate(parts)
            rows, size = [], 0
        if t is not None:
            rows.append(i)
            size += len(t)


def find_items(texts: list[str], index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """``(text number, item id, start, end, edits)``: the best region of each item in each text."""
    folded = [fold(t) for t in texts]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for rows, starts, points in _stretches(folded):
        for item, lo, hi in index.regions(points):
            # The band may touch several short documents; each is aligned on its own.
            m = len(index.texts[item])
            budget = int(index.edits[item])
            a = np.searchsorted(starts, max(lo - budget, 0), side="right") - 1
            b = np.searchsorted(starts, min(hi + budget + m, len(points) - 1), side="right") - 1
            for j in range(a, min(b, len(rows) - 1) + 1):
                own = folded[rows[j]]
                if len(own) < m - budget or lo - budget - starts[j] > len(own):
                    continue
                found = banded(index.texts[item], own, lo - int(starts[j]), hi - int(starts[j]), budget)
                if found and found[0] <= budget:
                    key = (rows[j], int(index.ids[item]))
                    best[key] = min(best.get(key, found), found)
    return [(row, item, s, e, edits) for (row, item), (edits, s, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, at most ``BLOCK_CHARS`` characters at a time (a longer one alone), each counted
    for ``ITEM_CHARS`` more."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("length(text) > 0 and item_id is not null")
    weight = F.length("text") + ITEM_CHARS
    size = items.agg(F.sum(weight)).first()[0]
    if not size:
        return
    if size <= BLOCK_CHARS:
        yield [tuple(r) for r in items.collect()]
        return
    before = Window.partitionBy("slice").orderBy("item_id", "text")
    slices = max(1, 2 * size // BLOCK_CHARS)
    numbered = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    numbered = numbered.withColumn("part", F.floor(F.sum(weight).over(before) / BLOCK_CHARS))
    for r in numbered.select("slice", "part").distinct().toLocalIterator():
        yield [tuple(x) for x in numbered.where((F.col("slice") == r["slice"]) & (F.col("part") == r["part"])).select("item_id", "text").collect()]


def _match(index, batch: pa.RecordBatch) -> pa.RecordBatch:
    found = find_items([decode(raw) for raw in batch.column(1).to_pylist()], index.value)
    rows = pa.array([f[0] for f in found], pa.int64())
    numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(1, 5)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), *numbers], names=["id", "item_id", "start", "end", "edits"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item_id, start, end, edits)``: for each document and item at most
    ``EDITS_PER_100`` edits per 100 characters apart, its best region in code points.

    Letter case and the kind of white space do not count; items of fewer than 20 characters must
    be there as they are. Null or empty texts and items, and items without an id, match
    nothing; repeated rows each give their own; items that share an id are one; the smallest
    edits, then the first place, wins a tie; other columns are not read; an empty table on
    either side gives no row.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, start long, end long, edits long"
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for i, items in enumerate(_blocks(benchmark, item_col, item_text_col)):
        found = map_arrow(source, partial(_match, spark.sparkContext.broadcast(ItemIndex(items))), schema)
        out = found if not i else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _clean(index, batch: pa.RecordBatch) -> pa.RecordBatch:
    hit = {f[0] for f in find_items([decode(raw) for raw in batch.column(0).to_pylist()], index.value)}
    keep = pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_())
    return pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found (see :func:`benchmark_matches`).

    Columns are unchanged, whatever their names; rows with null or empty texts stay; repeated rows
    stay or go together; with an empty benchmark all rows stay."""
    require(docs, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items in _blocks(benchmark, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))
        lead = fresh(docs, "__text")
        docs = map_arrow(docs.select(text_bytes(text_col).alias(lead), *docs.columns), partial(_clean, index), schema)
    return docs
