"""BPE encoding and decoding.

A word's symbols form a doubly linked list; every adjacent pair that a merge rule names waits
in a priority queue under (rank, place). The lowest is taken, skipped if one of its symbols
has changed since, and otherwise merged, which links two new pairs. Decoding concatenates
vocabulary strings as the tokenizer's decoder says.

Texts are cut at single spaces, which no token of such a vocabulary crosses. Each distinct
piece of a batch is encoded once, and Arrow gathers ids and strings of the texts; words are
encoded once for each Python worker while a bounded table remembers them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, lists_of_ids, map_arrow, pieces_of, require, text_bytes, texts_of

#: Words that one Python worker remembers; beyond it the older half is forgotten.
REMEMBERED = 600_000
#: Bytes of texts whose distinct pieces are encoded together.
BATCH_BYTES = 4 << 20

_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Memory(dict):
    """A table of at most ``limit`` entries: two generations, the elder is dropped when the
    younger is full. Reads go through ``memory[key]``; ``make`` supplies what is missing."""

    def __init__(self, make, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    table = {b: chr(b) for b in plain}
    table.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)})
    return table


class MergeRules:
    """Pairs of symbols by rank, and what each becomes. A pair is one number, and so is a place in the
    queue: the rank, which names the pair, and the left symbol's position."""

    SYMBOL, PLACE = 21, 32

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        self.pairs = [a << self.SYMBOL | b for a, b, _ in merges]
        self.merged = [c for _, _, c in merges]
        self.rank = {pair: rank for rank, pair in enumerate(self.pairs)}


def merge_symbols(symbols: list[int], rules: MergeRules) -> list[int]:
    """Apply merge ``rules`` to a word's symbols."""
    rank, pairs, merged, shift, width = rules.rank.get, rules.pairs, rules.merged, MergeRules.SYMBOL, MergeRules.PLACE
    n = len(symbols)
    queue = [r << width | i for i in range(n - 1) if (r := rank(symbols[i] << shift | symbols[i + 1])) is not None]
    if not queue:
        return symbols
    # -1 is no symbol: at the end, which is also the place before the beginning, and where one was merged away
    symbols = [*symbols, -1]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    heapq.heapify(queue)
    mask = (1 << width) - 1
    while queue:
        entry = heapq.heappop(queue)
        r, left = entry >> width, entry & mask
        right = after[left]
        if symbols[left] < 0 or symbols[left] << shift | symbols[right] != pairs[r]:
            continue  # stale: one of the two has been merged away
        new = merged[r]
        symbols[left], symbols[right] = new, -1
        after[left] = beyond = after[right]
        before[beyond] = left
        if symbols[beyond] >= 0 and (r := rank(new << shift | symbols[beyond])) is not None:
            heapq.heappush(queue, r << width | left)
        prior = before[left]
        if prior >= 0 and (r := rank(symbols[prior] << shift | new)) is not None:
            heapq.heappush(queue, r << width | prior)
    return [s for s in symbols if s >= 0]


class BpeCodec:
    """A BPE tokenizer file whose words end in a suffix and whose white space is dropped:
    NFC, lower case letter by letter, byte-level symbols, no decoder."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._check(spec)
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rules = MergeRules([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        # by id, for whole arrays of ids
        self.names = pa.array([self.strings.get(i) for i in range(max(self.strings) + 1)], pa.large_string())
        self.decimals = pa.array([str(i) for i in range(len(self.names))], pa.large_string())
        letters = byte_letters()
        self.inner, self.last = [self.ids[letters[b]] for b in range(256)], [self.ids[letters[b] + self.suffix] for b in range(256)]
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._mark = os.path.commonprefix(list(self.special))
        self._words = regex.compile(_WORD_PATTERN)
        self._word = Memory(self._encode_word, remembered)

    @staticmethod
    def _check(spec: dict) -> None:
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if spec["pre_tokenizer"]["type"] == "Sequence" else None
        if kinds != ["NFC", "Replace", "Lowercase"] or pattern != _WORD_PATTERN or spec["decoder"]:
            raise ValueError("this codec reads BPE files with word ends, lower case and no decoder")

    def _encode_word(self, word: str) -> bytes:
        *head, end = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        return array("i", merge_symbols([*[inner[b] for b in head], self.last[end]], self.rules)).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._word[piece.lower()]
        out = []
        for k, part in enumerate(self._special.split(piece) if self._mark in piece else (piece,)):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<i4").tobytes())
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [self._word[w] for w in self._words.findall(plain)]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self._encode_piece(p) for p in text.split(" ")]), dtype="<i4")

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


class Coded:
    """The ids of a batch of texts, gathered from its distinct pieces, and strings made from them."""

    def __init__(self, use: BpeCodec, texts: pa.StringArray) -> None:
        self.use = use
        pieces, codes, edges = pieces_of(texts)
        each = pa.array([use._encode_piece(p) for p in pieces.to_pylist()], pa.binary())
        self.ids = lists_of_ids(each.take(pa.array(codes)), edges)

    def _joined(self, names: pa.Array) -> pa.Array:
        lists = pa.ListArray.from_arrays(self.ids.offsets, names.take(self.ids.values))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))

    def decoded(self) -> pa.Array:
        return self._joined(self.use.names)

    def numbers(self) -> pa.Array:
        return self._joined(self.use.decimals)


@cache
def codec(path: str, remembered: int = REMEMBERED) -> BpeCodec:
    return BpeCodec(path, remembered)


def _encode(path: str, remembered: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    coded = Coded(codec(path, remembered), texts_of(batch.column(0)))
    return pa.RecordBatch.from_arrays([*batch.columns[1:], coded.ids], names=[*batch.schema.names[1:], "ids"])


def _decode(path: str, remembered: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    use = codec(path, remembered)
    texts = [use.decode(ids or []) for ids in batch.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "decoded"])


def _apply(df: DataFrame, first: "F.Column", fn, result: str, kind: str) -> DataFrame:
    keep = [c for c in df.columns if c.lower() != result.lower()]
    schema = df.select(*keep).schema
    lead = fresh(df, "__first")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"{result} {kind}"])
    return map_arrow(df.select(first.alias(lead), *keep), fn, out, BATCH_BYTES)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``df`` plus ``ids``: the token ids of every whole text under the tokenizer file ``path``.

    Special-token strings in a text become their ids; no others are added. Null and empty
    texts have no ids. ``remembered`` bounds the words a Python worker keeps: fewer take less
    memory and more time. An ``ids`` column of the input, in any case, is replaced; other columns
    stay; repeated rows each have theirs; an empty table gives an empty table.
    """
    require(df, text_col)
    return _apply(df, text_bytes(text_col), partial(_encode, path, remembered), "ids", "array<int>")


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """``df`` plus ``decoded``: the vocabulary strings of ``ids_col``; null or no ids give ``''``."""
    require(df, ids_col)
    return _apply(df, F.col(ids_col), partial(_decode, path, remembered), "decoded", "string")


def _both(path: str, remembered: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    own = Coded(codec(path, remembered), texts_of(batch.column(0)))
    coded = pa.StructArray.from_arrays([own.ids, own.decoded().cast(pa.string())], names=["ids", "decoded"])
    return pa.RecordBatch.from_arrays([*batch.columns[1:], coded], names=[*batch.schema.names[1:], "coded"])


def bpe_encode_decode(df: DataFrame, path: str, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``df`` plus ``ids`` and ``decoded`` in one pass: one Python worker a task holds one codec. Cases as
    in :func:`bpe_encode`."""
    require(df, text_col)
    df = df.drop(*[c for c in df.columns if c.lower() in ("ids", "decoded")])
    out = _apply(df, text_bytes(text_col), partial(_both, path, remembered), "coded", "struct<ids:array<int>,decoded:string>")
    return out.select(*[c for c in out.columns if c != "coded"], "coded.ids", "coded.decoded")


def _digests(strings: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(s).hexdigest() for s in strings.cast(pa.large_binary()).to_pylist()], pa.string())


def _digest(path: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    coded = Coded(codec(path), texts_of(batch.column(1)))
    counts = pc.list_value_length(coded.ids).cast(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), counts, _digests(coded.numbers()), _digests(coded.decoded())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: encode, then decode those ids, in
    one pass that never ships the ids. One row per input row; null texts count as empty; ids may be
    null or repeat; other columns are not read; an empty table gives an empty table."""
    require(df, id_col, text_col)
    source = df.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    out = map_arrow(source, partial(_digest, path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", BATCH_BYTES)
    return out.withColumnRenamed("id", id_col)
