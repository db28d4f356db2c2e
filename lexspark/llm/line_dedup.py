"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens; tokens that hold a
digit are variable from the start. Below a leaf, lines that agree on most of their tokens
are one template, and where they differ becomes variable. Lines of templates that recur
across documents are dropped, wherever they stand.

"Across documents" means across different ones: copies of a document repeat all its
lines and say nothing about a single one, and they are near-dedup's business. Which documents are copies is
settled first and for all lines alike: documents whose sketches (least hashes of three-word runs, by place) agree in a band
are held against the first of that band, and those that agree in half of all places are linked; what links reach is one
class. A line's documents then count by class. The count is of distinct classes, exact up to the few that decide, of which the
least are kept: they are the same whatever the order of rows, the split into tasks, or a task run twice.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, hash_words, key_long, map_arrow, materialise, mix, remove_dirs, require, shared_dir, text_bytes, window_hashes
from .components import connected_components

#: Leading tokens of a path, and the share of equal tokens that makes two lines one template.
DEPTH, SIMILAR = 3, 0.7
#: Different documents from which a template recurs.
DOCUMENTS = 5
#: Places of a document's sketch, and the share of equal ones from which two documents are copies:
#: below the similarity of two near copies of a third document.
PLACES, COPY = 64, 0.5
#: Places of a band; two documents that agree there are candidates.
BAND = 4
#: Lines whose classes a task remembers; of those beyond them it passes on more rows than it must.
REMEMBERED = 20_000
#: Tokens of a leaf's templates up to which a form is compared with all of them, and forms of a leaf
#: from which those that resemble no other are found first.
COMPARED, MANY = 1 << 15, 64
_VARIABLE = 0


_POWERS = np.multiply.accumulate(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _tokens(joined: bytes, edges: np.ndarray) -> np.ndarray:
    """Hash of each word of ``joined``, 0 of one that holds a digit; words begin and end in turn at ``edges``."""
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    # words and what lies between them, in turn: so values follow one another as Arrow needs them
    every = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(joined)])
    coded = every.dictionary_encode()
    hashes = hash_words(coded.dictionary.to_numpy(zero_copy_only=False))
    hashes[pc.match_substring_regex(coded.dictionary, "[0-9]").to_numpy(zero_copy_only=False)] = _VARIABLE
    return hashes[coded.indices.to_numpy()[::2]]


class Lines:
    """All lines of some texts at once. A line has its text's number, its place in that text, its token
    hashes (0 for a token that holds a digit), its leaf and the hash of itself, its form. Each different
    word of the texts is hashed once."""

    def __init__(self, raws: pa.Array) -> None:
        raws = pc.fill_null(raws, b"")
        joined = b"\n".join(raws.to_pylist())
        held = np.frombuffer(joined, dtype=np.uint8)
        blank = np.ones(len(held) + 2, dtype=bool)
        blank[1:-1] = (held == 32) | (held - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        newline = np.flatnonzero(held == 10)
        line_start = np.r_[0, newline + 1]
        text_start = np.cumsum(np.r_[0, pc.binary_length(raws).to_numpy()[:-1] + 1])
        self.text = np.searchsorted(text_start, line_start, side="right") - 1
        self.place = np.arange(len(line_start)) - np.searchsorted(line_start, text_start)[self.text]
        self.start = np.r_[0, np.searchsorted(edges[::2], newline), len(edges) // 2]
        self.size = np.diff(self.start)
        self.tokens = _tokens(joined, edges)
        place = np.arange(len(self.tokens)) - np.repeat(self.start[:-1], self.size)
        while place.size and place.max() >= len(_POWERS):  # pragma: no cover - lines of many thousand tokens
            place = np.where(place >= len(_POWERS), place - len(_POWERS) + 1, place)
        with np.errstate(over="ignore"):
            weighted = (self.tokens + np.uint64(1)) * _POWERS[place]
            length = self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            lead = np.zeros(len(self.size), dtype=np.uint64)
            for i in range(DEPTH):
                longer = np.flatnonzero(self.size > i)
                lead[longer] += weighted[self.start[longer] + i]
            self.form = mix(self._sums(weighted) + length)
            self.leaf = mix(lead ^ length)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each line's tokens; a difference of running sums, exact modulo 2**64."""
        with np.errstate(over="ignore"):
            run = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)]
            return run[self.start[1:]] - run[self.start[:-1]]

    def sketches(self, n: int) -> np.ndarray:
        """(n, PLACES) bytes: a text's runs of three tokens fall to places by their hash, and the least
        of each place leaves a byte (0: none). A text of one or two tokens is one run."""
        owner = np.repeat(self.text, self.size)
        least = np.full(n * PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
        if len(owner):
            runs = window_hashes(np.r_[self.tokens, np.zeros(2, dtype=np.uint64)], 3)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            ends = np.r_[begin[1:], len(owner)]
            for size in (1, 2):
                short = begin[ends - begin == size]
                runs[short] = mix(self.tokens[short] + np.uint64(size)) ^ (self.tokens[short + 1] if size == 2 else np.uint64(0))
            place = owner * PLACES + (runs >> np.uint64(58)).astype(np.int64)
            for back in (1, 2):  # runs that reach into the next text
                edge = ends - back
                runs[edge[edge > begin]] = np.iinfo(np.uint64).max
            np.minimum.at(least, place, runs)
        mark = (mix(least) >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
        return np.where(least == np.iinfo(np.uint64).max, 0, mark).astype(np.uint8).reshape(n, PLACES)


def copies(a: bytes, b: bytes) -> bool:
    """Whether two sketches are those of copies or near copies."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    return np.count_nonzero((x == y) & (x > 0)) >= COPY * np.count_nonzero(x | y)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`copies` for two columns of sketches."""
    same = np.count_nonzero((a == b) & (a > 0), axis=1)
    return same >= COPY * np.count_nonzero(a | b, axis=1)


_TEXT = "key long, twin long, sketch binary, place array<int>, form array<long>, leaf array<long>, tokens array<binary>"


def _emit(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each different text with a word: its keys, its sketch and its lines that have one; 16 bits of
    each token are carried."""
    _, first = np.unique(np.stack([batch.column(i).to_numpy() for i in range(2)]), axis=1, return_index=True)
    batch = batch.take(pa.array(np.sort(first)))
    lines = Lines(batch.column(2))
    at = np.flatnonzero(lines.size)
    held = np.bincount(lines.text[at], minlength=batch.num_rows)
    edges = pa.array(np.r_[0, np.cumsum(held)].astype(np.int32))
    tokens = _runs(2 * np.r_[lines.start[at], lines.start[-1]], (lines.tokens >> np.uint64(48)).astype(np.uint16))
    values = [pa.array(lines.place[at], pa.int32()), pa.array(key_long(lines.form[at])), pa.array(key_long(lines.leaf[at])), tokens]
    sketch = _runs(PLACES * np.arange(batch.num_rows + 1), lines.sketches(batch.num_rows))
    columns = [*batch.columns[:2], sketch, *(pa.ListArray.from_arrays(edges, v) for v in values)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "twin", "sketch", "place", "form", "leaf", "tokens"]).filter(pa.array(held > 0))


def _runs(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between each of ``edges`` and the next."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(node, band)`` of sketches: a hash of each band without an empty place."""
    held = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, PLACES // BAND, BAND)
    whole = (held > 0).all(axis=2)
    packed = np.ascontiguousarray(held).view(f"<u{BAND}").reshape(len(held), -1).astype(np.uint64)
    keys = mix(packed + (np.arange(PLACES // BAND, dtype=np.uint64) << np.uint64(32)))
    row, _ = np.nonzero(whole)
    node = batch.column(0).to_numpy()[row]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(key_long(keys[whole]))], names=["node", "band"])


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    load = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(near(load(2), load(3))))


def classes(sketches: DataFrame, root: str) -> DataFrame:
    """``(sketch, class)`` of the documents that are linked to others; every other one is a class of its own."""
    nodes = materialise(sketches.distinct().withColumn("node", F.xxhash64("sketch")), f"{root}/sketches")
    bands = map_arrow(nodes.select("node", "sketch"), _bands, "node long, band long")
    first = bands.groupBy("band").agg(F.min("node").alias("dst"), F.max("node").alias("last")).where("dst <> last").select("band", "dst")
    stars = bands.join(first, "band").where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    own = nodes.select("node", "sketch")
    stars = stars.join(own.toDF("src", "s"), "src").join(own.toDF("dst", "t"), "dst").select("src", "dst", "s", "t")
    comps = connected_components(map_arrow(stars, _linked, "src long, dst long"))
    return materialise(nodes.join(comps.withColumnRenamed("id", "node"), "node").select("sketch", F.col("comp").alias("class")), f"{root}/classes")


def least_classes(held: list[int], own: int) -> bool:
    """Puts a class among the ``DOCUMENTS`` least ones, in order; False if it is one of them or none of the least."""
    at = bisect_left(held, own)
    if at == DOCUMENTS or at < len(held) and held[at] == own:
        return False
    held.insert(at, own)
    del held[DOCUMENTS:]
    return True


_CLASSED = "leaf long, form long, tokens binary, class long"


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> rows of their lines, those of each form that are among its least classes so far: no other
    can decide."""
    seen: dict[int, list[int]] = {}
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy()
        leaf, form, tokens = (batch.column(i).flatten() for i in range(3))
        own = np.repeat(batch.column(3).to_numpy(), lengths)
        rows = pa.RecordBatch.from_arrays([leaf, form, tokens, pa.array(own)], names=["leaf", "form", "tokens", "class"])
        forms = form.to_numpy()
        order = np.lexsort((own, forms))
        again = (forms[order][1:] == forms[order][:-1]) & (own[order][1:] == own[order][:-1])
        at = order[np.r_[True, ~again]] if len(order) else order
        keep = []
        for i, f, c in zip(at.tolist(), forms[at].tolist(), own[at].tolist(), strict=True):
            held = seen.get(f)
            if held is None:
                held = []
                if len(seen) < REMEMBERED:
                    seen[f] = held
            if least_classes(held, c):
                keep.append(i)
        yield rows.take(pa.array(keep, pa.int64()))


def segments(width: int) -> list[tuple[int, int]]:
    """The tokens behind the leading ones, cut into more parts than tokens may differ, so that two lines
    similar enough agree on one of them throughout; none for lines so short that all may differ."""
    first, parts = min(DEPTH, width), width - math.ceil(SIMILAR * width) + 1
    edges = [first + (width - first) * i // parts for i in range(parts + 1)] if width - first >= parts else []
    return list(pairwise(edges))


class Leaf:
    """The templates of one leaf, fed with line forms in any number of steps. A form joins the
    template it agrees with most. While there are few templates all are compared; beyond that, only
    those that share a segment."""

    def __init__(self, width: int) -> None:
        self.least, self.segments = math.ceil(SIMILAR * width), segments(width)
        self.by_segment: list[dict[bytes, list[int]]] = [{} for _ in self.segments]
        self.indexed = 0
        #: A row of tokens for each template, -1 where it is variable.
        self.tokens = np.empty((4, width), dtype=np.int32)
        #: The least classes of each.
        self.held: list[list[int]] = []
        self.of: dict[int, int] = {}

    def add(self, form: int, tokens: np.ndarray, own: int) -> None:
        if form not in self.of:
            self.of[form] = self._template(tokens)
        least_classes(self.held[self.of[form]], own)

    def _template(self, tokens: np.ndarray) -> int:
        n = len(self.held)
        near = self._near(tokens) if self.segments and n * len(tokens) > COMPARED else None
        equal = ((self.tokens[:n] if near is None else self.tokens[near]) == tokens).sum(axis=1)
        if len(equal) and equal.max() >= self.least:
            best = int(equal.argmax() if near is None else near[equal.argmax()])
            self.tokens[best][self.tokens[best] != tokens] = -1
            return best
        if n == len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.empty_like(self.tokens)])
        self.tokens[n] = tokens
        self.held.append([])
        return n

    def _near(self, tokens: np.ndarray) -> np.ndarray:
        """Templates that share a segment, in order. The index keeps a template's tokens of the time
        it was entered: where all of a segment still hold, they are the same."""
        for c in range(self.indexed, len(self.held)):
            for (a, b), held in zip(self.segments, self.by_segment, strict=True):
                if (self.tokens[c, a:b] >= 0).all():
                    held.setdefault(self.tokens[c, a:b].tobytes(), []).append(c)
        self.indexed = len(self.held)
        own = tokens.astype(np.int32)
        found = {c for (a, b), held in zip(self.segments, self.by_segment, strict=True) for c in held.get(own[a:b].tobytes(), ())}
        return np.array(sorted(found), dtype=np.int64)

    def recurring(self) -> list[int]:
        return [form for form, c in self.of.items() if len(self.held[c]) >= DOCUMENTS]


def resembling(tokens: np.ndarray) -> np.ndarray:
    """Which of a leaf's different forms share a segment with another; the rest are templates alone."""
    out = np.zeros(len(tokens), dtype=bool)
    for a, b in segments(tokens.shape[1]):
        with np.errstate(over="ignore"):
            key = ((tokens[:, a:b].astype(np.uint64) + np.uint64(1)) * _POWERS[np.arange(b - a) % len(_POWERS)]).sum(axis=1, dtype=np.uint64)
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        out |= times[back] > 1
    return out


def leaf_recurring(forms: np.ndarray, tokens: np.ndarray, owners: np.ndarray) -> list[int]:
    """Forms of one leaf, sorted, whose template recurs. In a large leaf most lines resemble no other:
    these are told by arrays, and only the rest become templates that others may join."""
    begin = np.flatnonzero(np.r_[True, forms[1:] != forms[:-1]])
    ends = np.r_[begin[1:], len(forms)]
    some = resembling(tokens[begin]) if len(begin) >= MANY and segments(tokens.shape[1]) else np.ones(len(begin), dtype=bool)
    out, leaf = [], Leaf(tokens.shape[1])
    for a, b, joins in zip(begin.tolist(), ends.tolist(), some.tolist(), strict=True):
        if joins:
            for i in range(a, b):
                leaf.add(int(forms[i]), tokens[i], int(owners[i]))
        elif b - a >= DOCUMENTS:
            if len(np.unique(owners[a:b])) >= DOCUMENTS:
                out.append(int(forms[a]))
    return out + leaf.recurring()


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms sorted by leaf -> forms whose template recurs. Leaves of too few rows need no
    template; the last leaf of a batch stays open, for it may go on in the next. An open leaf is
    held as arrays, some hundred bytes a row."""
    open_leaf: int | None = None
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def closed() -> list[int]:
        if sum(len(p[0]) for p in parts) < DOCUMENTS:
            return []
        return leaf_recurring(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

    for batch in batches:
        if not batch.num_rows:
            continue
        leaves, forms, owners = (batch.column(i).to_numpy() for i in (0, 1, 3))
        tokens = np.frombuffer(batch.column(2).buffers()[2] or b"", dtype=np.uint16)
        places = np.frombuffer(batch.column(2).buffers()[1], dtype=np.int32)[batch.column(2).offset :][: batch.num_rows + 1] // 2
        begin = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
        ends = np.r_[begin[1:], len(leaves)]
        out: list[int] = []
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            if leaves[a] != open_leaf:
                out += closed()
                open_leaf, parts = leaves[a], []
            if b - a >= DOCUMENTS or parts or b == len(leaves):
                width = int(places[a + 1] - places[a])
                own = tokens[places[a] : places[b]].reshape(b - a, width)
                parts.append((forms[a:b], own, owners[a:b]) if b < len(leaves) else (forms[a:b].copy(), own.copy(), owners[a:b].copy()))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["form"])
    yield pa.RecordBatch.from_arrays([pa.array(closed(), pa.int64())], names=["form"])


def recurring_forms(texts: DataFrame, root: str) -> DataFrame:
    """``(form)``: the hashes of all lines whose template recurs across documents."""
    own = classes(texts.select("sketch"), root)
    classed = texts.join(own, "sketch", "left").select("leaf", "form", "tokens", F.coalesce("class", F.xxhash64("sketch")).alias("class"))
    dealt = classed.mapInArrow(_thin, _CLASSED).repartition("leaf").sortWithinPartitions("leaf", "form", "class")
    return dealt.mapInArrow(_grow, "form long").distinct()


def _zip(batch: pa.RecordBatch) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed = [None if raw is None else squeeze(raw) for raw in batch.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=batch.schema.names)


def _trim(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts without their lost lines, which are told by their places."""
    expand = zstandard.ZstdDecompressor().decompress
    texts = [None if raw is None else expand(raw) for raw in batch.column(0).to_pylist()]
    counts, dropped = [], []
    for i, gone in enumerate(batch.column(1).to_pylist()):
        split = (texts[i] or b"").split(b"\n")
        counts.append(sum(map(bool, map(bytes.strip, split))))
        dropped.append(len(gone or ()))
        if gone:
            for place in gone:
                split[place] = None
            texts[i] = b"\n".join([line for line in split if line is not None])
    columns = [*batch.columns[2:], pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[2:], "kept_text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``kept_text``, ``n_lines`` (lines with a word) and ``n_dropped``.

    A template recurs if documents of ``DOCUMENTS`` classes or more hold it; copies and near copies are one
    class, however many there are. The result does not depend on the order of rows. Lines are cut at ``\\n``; those without
    a word are kept and count for nothing. Null texts stay null with no lines; repeated rows and
    copies get the same result; result columns that clash with the input's replace them;
    an empty table gives an empty table.
    """
    require(docs, text_col)
    out = ("kept_text", "n_lines", "n_dropped")
    root = shared_dir(docs.sparkSession)
    # Equal texts hold equal lines: two hashes of the text carry what it loses, not a row's id. Texts are cut into
    # tokens once; from there on a line is known by its form and its place.
    hashes = F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)
    cut = map_arrow(docs.select(hashes[0].alias("key"), hashes[1].alias("twin"), text_bytes(text_col)), _emit, _TEXT)
    texts = materialise(cut, f"{root}/texts")
    forms = materialise(recurring_forms(texts, root), f"{root}/forms")
    keep = [c for c in docs.columns if c.lower() not in out]
    lead, gone, key, twin = (fresh(docs, stem) for stem in ("__raw", "__gone", "__key", "__twin"))
    keyed = docs.select(text_bytes(text_col).alias(lead), hashes[0].alias(key), hashes[1].alias(twin), *keep)
    lines = texts.select("key", "twin", F.inline(F.arrays_zip("place", "form")))
    lost = lines.join(forms, "form").groupBy(F.col("key").alias(key), F.col("twin").alias(twin)).agg(F.collect_set("place").alias(gone))
    # Written, one row a text, and merged at every size: a join of two scans can be split where one
    # text has many copies, and no executor holds all of what is lost.
    lost = materialise(lost, f"{root}/lost").hint("merge")
    remove_dirs(docs.sparkSession, root, "texts", "sketches", "classes", "forms")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    packed = map_arrow(keyed, _zip, f"`{lead}` binary, `{key}` long, `{twin}` long, {kinds}")
    joined = packed.join(lost, [key, twin], "left").select(lead, gone, *keep)
    return map_arrow(joined, _trim, f"{kinds}, kept_text binary, n_lines long, n_dropped long").withColumn("kept_text", F.col("kept_text").cast("string"))
