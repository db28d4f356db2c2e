"""Alignment of two tokenizers over the same texts, and how often their tokens answer each other.

Both tokenizers see a text behind one space; a byte-level one as it is, a piece one that adds the space itself.
The tokens of each side cut the same bytes at their own ends. The union of both sets of ends cuts them into
elementary intervals; each has one owner on either side, found by binary search, and is the one place
where those two overlap. Where both sides end, a group closes. Tokens that end there together are linked, each
with each. All texts of a batch are one run of bytes here, since at the end of a text both sides end.

The plan: texts are encoded and aligned once, in batches (*chunks*) of bounded bytes; a chunk holds each of its
distinct links once, with its count, and its texts name them by place. Counts over the
corpus are sums over chunks, so a link that stands in every text is one row a chunk. What a
chunk asks comes back to it by a join on the link and one on the chunk; both sides are rows of chunks, none is the
corpus. The best count of each right-hand token is a table no longer than that vocabulary.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, importable, materialise, pieces_of, require, runs_of_ids, shared_dir, slices, text_bytes, texts_of, lists_of_ids
from .bpe import byte_letters
from .token_files import LibraryEncoder

#: Texts of one chunk, in bytes.
CHUNK_BYTES = SLICE_BYTES
_SPACE = "▁"


class ByteSide(LibraryEncoder):
    """A byte-level tokenizer; special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = ()
        byte_of = {letter: bytes([b]) for b, letter in byte_letters().items()}
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.bytes = pa.array([b"".join(byte_of.get(c, c.encode()) for c in t) for t in tokens], pa.binary())

    def ids(self, texts: pa.StringArray) -> pa.ListArray:
        return self.encode(pc.binary_join_element_wise("", texts, " "))


class PieceSide:
    """A sentencepiece model, which sets a space before a text.

    No piece holds a space behind another character, so merges never cross the space before a word: the
    distinct words of a batch are encoded once. Texts with empty words or the model's own sign for a space, and all
    texts under a model of another kind, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)], pa.binary())
        probe = "ﬁ  á "
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and self.model.normalize(probe) == _SPACE + probe.replace(" ", _SPACE)

    def _runs(self, texts: list[str]) -> pa.Array:
        found = self.model.encode(texts, num_threads=1) if texts else []
        return runs_of_ids(np.array([len(f) for f in found], dtype=np.int64), np.array([i for ids in found for i in ids], dtype="<i4"))

    def ids(self, texts: pa.StringArray) -> pa.ListArray:
        n = len(texts)
        words, codes, edges = pieces_of(texts)
        starts = edges[:-1]
        odd = pc.or_(pc.equal(words, ""), pc.match_substring(words, _SPACE)).to_numpy(zero_copy_only=False)
        whole = np.full(n, not self.by_word)
        if n:
            whole |= np.logical_or.reduceat(odd[codes], starts)
        at = np.flatnonzero(whole)
        plain = np.flatnonzero(~odd)
        blobs = pa.concat_arrays([self._runs(words.take(pa.array(plain)).to_pylist()), self._runs(texts.take(pa.array(at)).to_pylist())])
        place = np.zeros(len(words), dtype=np.int64)
        place[plain] = np.arange(len(plain))
        codes = place[codes]
        codes[starts[at]] = len(plain) + np.arange(len(at))
        kept = ~np.repeat(whole, np.diff(edges))
        kept[starts] = True
        ends = np.r_[0, np.cumsum(np.add.reduceat(kept, starts, dtype=np.int64))] if n else edges
        return lists_of_ids(blobs.take(pa.array(codes[kept])), ends)


@cache
def _sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteSide(a_path), PieceSide(b_path)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals of two cuts of the same bytes: their ends, their owners on both sides, and
    which close a group."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends) if len(ends) else np.zeros(0, dtype=bool)


def linked(a_ends: np.ndarray, b_ends: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that end together at one of ``closed``: of tokens without bytes several may end at a
    place, and the product of both sides is spread out."""
    a, b = np.searchsorted(a_ends, closed), np.searchsorted(b_ends, closed)
    p, q = np.searchsorted(a_ends, closed, side="right") - a, np.searchsorted(b_ends, closed, side="right") - b
    size = p * q
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    q = np.repeat(q, size)
    return np.repeat(a, size) + nth // q, np.repeat(b, size) + nth % q


def _spelled(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, first: np.ndarray, names: tuple[pa.Array, int, int]) -> pa.Array:
    """Every token's text in ``a1,a2|b1;a3|b2,b3``, in order. ``first``: groups that begin a text."""
    table, n_a, n_b = names
    head_a, head_b = np.diff(a_group, prepend=-1) > 0, np.diff(b_group, prepend=-1) > 0
    begins = np.zeros(int(a_group[-1]) + 1 if len(a_group) else 0, dtype=bool)
    begins[first] = True
    codes = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    codes[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = a_ids + n_a * np.where(head_a, np.where(begins[a_group], 0, 1), 2)
    codes[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = 3 * n_a + b_ids + n_b * ~head_b
    return table.take(pa.array(codes))


@cache
def _names(n_a: int, n_b: int) -> tuple[pa.Array, int, int]:
    texts = [f"{s}{i}" for s, n in (("", n_a), (";", n_a), (",", n_a), ("|", n_b), (",", n_b)) for i in range(n)]
    return pa.array([t.encode() for t in texts], pa.binary()), n_a, n_b


def _ends(runs: pa.Array) -> np.ndarray:
    """Ends of the values of a gathered binary array, from 0."""
    return np.frombuffer(runs.buffers()[1], dtype=np.int32)[1 : len(runs) + 1].astype(np.int64)


class Chunk:
    """One batch of texts: its counts by text, its groups, its links."""

    def __init__(self, raws: list[bytes | None], a_path: str, b_path: str) -> None:
        left, right = _sides(a_path, b_path)
        texts = texts_of(pa.array(raws, pa.binary()))
        sides = []
        same = np.array([bool(r) for r in raws], dtype=bool)
        for side in (left, right):
            ids = side.ids(texts)
            runs = side.bytes.take(ids.values)
            edges = np.r_[0, _ends(runs)][ids.offsets.to_numpy()].tolist()
            view = memoryview(runs.buffers()[2] or b"").cast("B")
            same &= np.array([r is not None and view[x:y] == b" " + r for r, x, y in zip(raws, edges[:-1], edges[1:], strict=True)], dtype=bool)
            sides.append((ids, side))
        self.same, where = same, pa.array(same)
        (self.a, a_ends), (self.b, b_ends) = ((ids.filter(where), _ends(side.bytes.take(ids.filter(where).flatten()))) for ids, side in sides)
        a_ids, b_ids = (x.flatten().to_numpy(zero_copy_only=False) for x in (self.a, self.b))
        ends, _, _, closes = overlaps(a_ends, b_ends)
        closed = ends[closes]
        stops = np.cumsum([len(r) + 1 for r, s in zip(raws, same.tolist(), strict=True) if s], dtype=np.int64)
        last = np.searchsorted(closed, stops)  # the group that ends each text
        a_group, b_group = np.searchsorted(closed, a_ends), np.searchsorted(closed, b_ends)
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.a, self.b))
        self.n_groups = np.diff(last, prepend=-1)
        first = np.r_[0, last[:-1] + 1] if len(last) else last
        self.spelled = _spelled(a_ids, a_group, b_ids, b_group, first, _names(len(left.bytes), len(right.bytes)))
        p, q = linked(a_ends, b_ends, closed)
        self.links = (a_ids[p].astype(np.int64) << 32) | b_ids[q].astype(np.int64)
        self.n_links = np.diff(np.searchsorted(a_ends[p], stops, side="right"), prepend=0)

    def groups(self) -> Iterator[memoryview]:
        """The spelled groups of each text that has tokens."""
        ends = np.r_[0, _ends(self.spelled)][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        view = memoryview(self.spelled.buffers()[2] or b"").cast("B")
        return (view[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups string"


def _aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool, chunk_bytes: int) -> DataFrame:
    """Rows of texts ``(chunk, id, counts, groups, links)`` and one of each chunk ``(chunk, pairs, counts)``."""
    importable(docs.sparkSession)

    def one(batch: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
        held = Chunk(batch.column(1).to_pylist(), a_path, b_path)
        n, at = batch.num_rows, np.flatnonzero(held.same)
        found = pa.array(held.links).dictionary_encode()
        pairs, place = found.dictionary.to_numpy(), found.indices.to_numpy()
        counts = np.bincount(place, minlength=len(pairs))
        spread = np.zeros((4, n), dtype=np.int64)
        spread[:, at] = held.n_a, held.n_b, held.n_groups, held.n_links
        texts = [""] * n
        for i, g in zip(at.tolist(), held.groups(), strict=True):
            texts[i] = hashlib.sha256(g).hexdigest() if digest else bytes(g).decode()
        edges = pa.array(np.r_[0, np.cumsum(spread[3])], pa.int32())
        links = pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32)))
        none = lambda kind, k: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), batch.column(0), *map(pa.array, spread), pa.array(texts, pa.string()), links, none(pa.list_(pa.int64()), n), none(pa.list_(pa.int64()), n)], names=names
        )
        lists = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x.astype(np.int64))) for x in (pairs, counts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk]), none(pa.int64(), 1), *(none(pa.int64(), 1) for _ in range(4)), none(pa.string(), 1), none(pa.list_(pa.int32()), 1), *lists], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, chunk_bytes):
                    yield from one(part, chunk)
                    chunk += 1
        pa.default_memory_pool().release_unused()

    names = ["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "counts"]
    return docs.mapInArrow(run, f"chunk long, id long, {_DOC}, links array<int>, pairs array<long>, counts array<long>")


def _scored(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Texts of one chunk with the corpus counts of their links."""
    counts, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=np.int64)
    place = pairs.column("place").to_numpy()
    counts[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    links = texts.column("links").combine_chunks()
    values, edges = links.values.to_numpy(zero_copy_only=False), links.offsets.to_numpy()
    total = lambda x: np.diff(np.r_[0, np.cumsum(x[values])][edges])
    out = texts.drop_columns(["chunk", "links"])
    return out.append_column("n_best", pa.array(total(best))).append_column("count_sum", pa.array(total(counts)))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``(a_id, b_id, pair, count, best)`` over rows ``(chunk, pairs, counts)``: how many links hold the two tokens, and
    whether no other pair with ``b_id`` has more."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    counts = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "pair", "count")
    return counts


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(<id>, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)``, one row per input row.

    ``n_a`` and ``n_b`` count the tokens of the byte-level tokenizer ``a_path`` over space+text and of the
    sentencepiece model ``b_path`` over the text. ``groups`` spells the groups in order, ids in decimal:
    ``a1,a2|b1;a3|b2,b3`` (``digest``: their SHA-256 in hex). Links are the pairs of tokens whose byte ranges end together;
    ``count_sum`` adds, over the links of a text, how many links of the corpus hold the same two ids, and
    ``n_best`` counts those whose count is the highest of their right-hand id, ties included.

    Defined cases: a text that is null or empty, or that the tokens of either side do not spell back byte for byte (such
    as one the model normalises, or broken UTF-8), has no tokens: zeros, and ``groups`` is empty. Strings of
    special tokens are plain text. Rows with null or repeated ids count like others; other columns are
    ignored; an empty table gives an empty table.
    """
    require(docs, id_col, text_col)
    root = shared_dir(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    aligned = materialise(_aligned(source, a_path, b_path, digest, chunk_bytes), f"{root}/aligned")
    chunks = aligned.where("pairs is not null").select("chunk", "pairs", "counts")
    counts = materialise(pair_counts(chunks), f"{root}/counts")
    # no longer than the vocabulary
    top = F.broadcast(counts.groupBy("b_id").agg(F.max("count").alias("top")))
    counts = materialise(counts.join(top, "b_id").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best")), f"{root}/best")
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("asker", "place", "count", "best")
    texts = aligned.where("pairs is null").select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    out = texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(_scored, f"id long, {_DOC}, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col)
