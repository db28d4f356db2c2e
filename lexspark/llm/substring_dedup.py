"""Exact substring dedup over words by level-wise doubling.

A window that starts at two places also repeats its halves, so short windows are counted
first, and only those that repeat are extended to twice the length, level by level, until the
asked-for length is reached or no candidate survives. The lowest level looks at one window
of each of twice its length: the one of least hash among those inside it. That choice
depends on nothing but the words, so equal windows choose alike and none is lost, while
only about one start in six is counted. For windows of 20 words the levels are 10 and 20: a level
of 5 would count about twice as many starts.

1. Texts that are equal as word sequences are one text, owned by its smallest id; a copy
   loses everything.
2. Each lower level: one row for each text and hash; a hash met in one text only sends
   itself back to that text, everything else survives. A window of the next level is a
   candidate if those of this level at its beginning and its end survive.
3. Windows of full length over survivors: the smallest id of each sequence owns it. A
   document removes what covers windows it does not own, and its own repeats.

Rows are fixed-width longs with min/max aggregates, combined before the shuffle, so a
passage of a third of all documents is one row for each task. Texts are carried compressed,
and after the lowest level only those with survivors.
"""

from __future__ import annotations

import hashlib
import threading
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_words, key_long, map_arrow, mark_windows, materialise, require, shared_dir, text_bytes, window_hashes, words_of

_local = threading.local()


def _zip(raw: bytes) -> bytes:
    if not hasattr(_local, "zip"):
        _local.zip, _local.unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _local.zip.compress(raw)


def _unzip(raw: bytes) -> bytes:
    if not hasattr(_local, "zip"):
        _zip(b"")
    return _local.unzip.decompress(raw)


#: Words of the lowest level's windows at least, where the asked-for length allows it.
SHORTEST = 8


def levels(width: int) -> list[int]:
    """Lengths of windows, each twice the one before (or one less), up to ``width``."""
    out = [(width + 1) // 2, width]
    while (half := (out[0] + 1) // 2) >= SHORTEST:
        out.insert(0, half)
    return out


def anchors(h: np.ndarray, half: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of ``width`` in word hashes ``h``: the start of its chosen window
    of ``half``; and the hashes of all windows of ``half``."""
    low = window_hashes(h, half)
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), low
    inside = np.lib.stride_tricks.sliding_window_view(low, width - half + 1)
    return np.arange(n) + inside.argmin(axis=1), low


_SPANS = "array<struct<first:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _text_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _owners(width: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, digests, keys = [], [], []
    for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words = words_of(raw)
        if len(words) >= width:
            digest = _digest(b" ".join(words))
            ids.append(doc)
            digests.append(digest)
            keys.append(_text_key(digest))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64())], names=["id", "digest", "text_key"])


def _low(width: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    half, above = levels(width)[:2]
    owners, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for raw in batch.column(1).to_pylist():
        words = words_of(raw)
        if len(words) >= width:
            at, low = anchors(hash_words(words), half, above)
            own = np.unique(low[np.unique(at)])
            owners.append(np.full(len(own), _text_key(_digest(b" ".join(words))), dtype=np.int64))
            keys.append(own)
    return pa.RecordBatch.from_arrays([pa.array(key_long(np.concatenate(keys))), pa.array(np.concatenate(owners))], names=["key", "text_key"])


def _survey(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The words as one compressed string, and its digest."""
    texts, digests = [], []
    for raw in batch.column(1).to_pylist():
        line = b" ".join(words_of(raw))
        texts.append(_zip(line))
        digests.append(_digest(line))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(digests, pa.binary())], names=["id", "zip", "digest"])


def _alone(held) -> np.ndarray:
    return held.values.to_numpy(zero_copy_only=False).view(np.uint64) if held.is_valid else np.empty(0, dtype=np.uint64)


def _extended(starts: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Starts of windows of ``longer`` whose first and last windows of ``length`` both start at ``starts``."""
    return starts[np.isin(starts + longer - length, starts)]


def _candidates(width: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """What is settled here: copies, and texts without a window whose chosen half is not
    alone. The others go on with the starts of such windows."""
    half, above = levels(width)[:2]
    counts, removed, digests, spans, texts, starts_out = [], [], [], [], [], []
    for doc, raw, owner, alone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
        line = _unzip(raw)
        words = line.split()
        copy = owner is not None and doc != owner
        starts = np.empty(0, dtype=np.int64)
        if len(words) >= width and not copy:
            at, low = anchors(hash_words(words), half, above)
            chosen = np.unique(at)
            _, back, times = np.unique(low[chosen], return_inverse=True, return_counts=True)
            live = (times[back] > 1) | ~np.isin(low[chosen], _alone(alone))
            starts = np.flatnonzero(live[np.searchsorted(chosen, at)])
        counts.append(len(words))
        removed.append(len(words) if copy else 0)
        digests.append(hashlib.sha256(b"" if copy else line).hexdigest())
        spans.append([{"first": 0, "end": len(words)}] if copy else [])
        texts.append(raw if len(starts) else None)
        starts_out.append(starts.astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPANS_ARROW), pa.array(texts, pa.binary()), pa.array(starts_out, pa.binary())],
        names=["id", "n_words", "n_removed", "kept", "removed", "zip", "starts"],
    )


def _keys_at(length: int, raw: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    starts = np.frombuffer(blob, dtype=np.int32).astype(np.int64)
    return starts, window_hashes(hash_words(_unzip(raw).split()), length)[starts]


def _level(length: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(key, text_key)`` of the candidates of one level, each once for a text."""
    keys, texts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for raw, blob, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
        keys.append(np.unique(_keys_at(length, raw, blob)[1]))
        texts.append(np.full(len(keys[-1]), text, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key_long(np.concatenate(keys))), pa.array(np.concatenate(texts))], names=["key", "text_key"])


def _survivors(length: int, longer: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Candidates of the next level; ``zip`` is null for a text that has none."""
    texts, blobs = [], []
    for raw, blob, alone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        starts, keys = _keys_at(length, raw, blob)
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        starts = _extended(starts[(times[back] > 1) | ~np.isin(keys, _alone(alone))], length, longer)
        texts.append(raw if len(starts) else None)
        blobs.append(starts.astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.binary()), pa.array(blobs, pa.binary())], names=[*batch.schema.names[3:], "zip", "starts"])


def _full_keys(words: list[bytes], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the windows at ``starts``."""
    h = hash_words(words)
    return window_hashes(h, width, seed=1)[starts], window_hashes(h, width, seed=2)[starts]


def _full(width: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(a, b, id, home)``: each different window of a row once; ``home`` is the row's text."""
    ids, homes, first, second = [], [], [], []
    for doc, raw, blob, home in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        a, b = _full_keys(_unzip(raw).split(), np.frombuffer(blob, dtype=np.int32), width)
        own = np.unique(a, return_index=True)[1]
        ids.append(np.full(len(own), doc, dtype=np.int64))
        homes.append(np.full(len(own), home, dtype=np.int64))
        first.append(a[own])
        second.append(b[own])
    columns = [pa.array(key_long(np.concatenate(first))), pa.array(key_long(np.concatenate(second))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(homes))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "id", "home"])


def _settle(width: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, removed, digests, spans = [], [], [], []
    for raw, blob, owned in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
        words = _unzip(raw).split()
        starts = np.frombuffer(blob, dtype=np.int32).astype(np.int64)
        a, _ = _full_keys(words, starts, width)
        own = owned.values.to_numpy(zero_copy_only=False).view(np.uint64) if owned.is_valid else a[:0]
        first = np.zeros(len(a), dtype=bool)
        first[np.unique(a, return_index=True)[1]] = True
        drop = mark_windows(starts[~(first & np.isin(a, own))], width, len(words))
        counts.append(len(words))
        removed.append(int(drop.sum()))
        digests.append(hashlib.sha256(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])).hexdigest())
        edges = np.flatnonzero(np.diff(np.r_[0, drop, 0].astype(np.int8)))
        spans.append([{"first": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPANS_ARROW)],
        names=["id", "n_words", "n_removed", "kept", "removed"],
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256, removed)``, one row per input row.

    A word is removed if a window of ``width`` consecutive words covers it whose sequence also
    starts earlier: in a smaller id, or earlier in the same document. Windows are judged on
    the input. ``removed`` lists the removed word ranges (end exclusive); ``kept_sha256`` is
    the digest of the kept words joined by one space. :func:`keep_words` applies the ranges.

    Defined cases: null or empty texts have no words and the digest of the empty string; rows
    that share an id are one place in the order, so they are not judged against each other; rows
    with a null id come after all others, likewise as one place; other columns are not read,
    whatever their names; an empty table gives an empty table.
    """
    require(docs, id_col, text_col)
    if width < 2:
        raise ValueError("width must be at least 2")
    root = shared_dir(docs.sparkSession)
    last = F.lit(2**63 - 1)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), text_bytes(text_col).alias("raw"))
    owners = map_arrow(source, partial(_owners, width), "id long, digest binary, text_key long").groupBy("digest", "text_key").agg(F.min("id").alias("owner"))
    low = map_arrow(source, partial(_low, width), "key long, text_key long")
    side = owners.join(_alone_lists(low), "text_key", "left").select("digest", "owner", "alone")
    held = map_arrow(source, _survey, "id long, zip binary, digest binary").join(side, "digest", "left").select("id", "zip", "owner", "alone")
    plain = f"id long, n_words long, n_removed long, kept string, removed {_SPANS}"
    held = map_arrow(held, partial(_candidates, width), f"{plain}, zip binary, starts binary")
    candidates = materialise(held, f"{root}/candidates")
    columns = candidates.columns[:5]
    done = candidates.where("zip is null").select(*columns)
    undecided = candidates.where("zip is not null").withColumn("text_key", F.xxhash64("kept"))
    for length, longer in pairwise(levels(width)[1:]):
        alone = _alone_lists(map_arrow(undecided.select("zip", "starts", "text_key"), partial(_level, length), "key long, text_key long"))
        joined = undecided.join(alone, "text_key", "left").select("zip", "starts", "alone", *columns)
        held = materialise(map_arrow(joined, partial(_survivors, length, longer), f"{plain}, zip binary, starts binary"), f"{root}/candidates{longer}")
        done = done.unionByName(held.where("zip is null").select(*columns))
        undecided = held.where("zip is not null").withColumn("text_key", F.xxhash64("kept"))
        if not undecided.limit(1).count():
            break
    keyed = undecided.select("id", "zip", "starts", "text_key")
    full = map_arrow(keyed, partial(_full, width), "a long, b long, id long, home long")
    owned = full.groupBy("a", "b").agg(F.min("id").alias("id"))
    settle = partial(_settle, width)
    # An id has one row as a rule, and its windows go back to it. Where several rows share an id (all
    # without one share a place), each gets those of the place's windows that it holds.
    crowd = undecided.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not crowd.limit(1).count():
        joined = keyed.join(owned.groupBy("id").agg(F.collect_list("a").alias("owned")), "id", "left")
    else:
        places = full.join(owned, ["a", "b", "id"]).groupBy("id", "home").agg(F.collect_set("a").alias("owned"))
        joined = keyed.join(places.withColumnRenamed("home", "text_key"), ["id", "text_key"], "left")
    settled = map_arrow(joined.select("id", "zip", "starts", "owned"), settle, plain)
    out = done.unionByName(settled)
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("id") != last, F.col("id")).cast(kind).alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256"), "removed")


def _alone_lists(keys: DataFrame) -> DataFrame:
    """``(text_key, alone)``: of ``keys (key, text_key)`` those that one text alone has."""
    alone = keys.groupBy("key").agg(F.min("text_key").alias("text_key"), F.max("text_key").alias("last")).where("text_key = last")
    return alone.groupBy("text_key").agg(F.collect_list("key").alias("alone"))


def keep_words(raw: bytes | None, removed: list[tuple[int, int]]) -> bytes:
    """The words outside the ranges of :func:`substring_dedup`, joined by one space."""
    words = words_of(raw)
    drop = {i for first, end in removed for i in range(first, end)}
    return b" ".join([w for i, w in enumerate(words) if i not in drop])
