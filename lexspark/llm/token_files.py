"""Token-ID output: Parquet files of id lists that can be read in part.

Format: one directory of Parquet files in ascending document order (file by file, row by
row), columns ``doc_id``, ``n_tokens``, ``tokens`` (list of int32, the end id included).
Ids are dictionary-encoded with bit-packed indexes, falling back to delta packing (writer
version 2); row groups and pages have fixed target sizes and page indexes are written, so that
a reader after counts never touches the token column, and one after some documents reads
their pages only. Where a document begins among all ids follows from ``n_tokens`` alone.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lists_of_ids, map_arrow, pieces_of, reach_of, require, runs_of_ids, shuffle_width, text_bytes, texts_of
from .bpe import byte_letters

ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10

#: Bytes of texts whose distinct pieces are encoded together.
BATCH_BYTES = 16 << 20
# The word pattern and the settings of byte-level tokenizers of this kind.
_PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BY_WORD = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class LibraryEncoder:
    """Byte-level BPE through the tokenizers library, which sees each distinct word of a batch once.

    The pieces between single spaces, each with the space before it, are split into words and
    merged alike wherever they stand: distinct pieces are split once, distinct words are merged
    once, and Arrow gathers the ids. A text with other white space beside a space, with a
    special token, or under a tokenizer with other settings is given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.by_word = spec["normalizer"] is None and spec["post_processor"] is None and spec["pre_tokenizer"] == _BY_WORD
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        # 0xFF stands in no UTF-8 text: between words
        self.letters = "".join(map({**byte_letters(), 0xFF: " "}.get, range(256)))

    def _whole(self, texts: list[str]) -> pa.Array:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return runs_of_ids(np.array([len(i) for i in found], dtype=np.int64), np.array([i for ids in found for i in ids], dtype="<i4"))

    def _words(self, words: list[str]) -> pa.Array:
        tokenize, ids, sizes = self.model.tokenize, array("i"), array("q")
        if words:
            for symbols in b"\xff".join(map(str.encode, words)).decode("latin-1").translate(self.letters).split(" "):
                found = tokenize(symbols)
                sizes.append(len(found))
                for token in found:
                    ids.append(token.id)
        return runs_of_ids(np.array(sizes), pa.py_buffer(ids))

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece with a space before it."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        words = pa.array(_PATTERN.findall(" " + joined) if len(pieces) else [], pa.string())
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64)), ends)
        distinct = words.dictionary_encode()
        ids = self._words(distinct.dictionary.to_pylist()).take(distinct.indices)
        return runs_of_ids(np.diff(reach_of(ids)[last + 1], prepend=0), ids.buffers()[2])

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> pa.ListArray:
        """The ids of each text, and ``end_id`` behind them."""
        n = len(texts)
        pieces, codes, edges = pieces_of(texts)
        starts, width = edges[:-1], np.diff(edges)
        odd = pc.match_substring_regex(pieces, r"^(?s:$|[\s\x0b\x1c-\x1f\x85\pZ].*|.*[\s\x0b\x1c-\x1f\x85\pZ])$").to_numpy(zero_copy_only=False)
        whole = np.full(n, not self.by_word)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            odd |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        heads = pieces.take(pa.array(codes[starts])).to_pylist()  # no space stands before these
        bad = odd[codes]
        bad[starts] = [h[-1:].isspace() for h in heads]
        if n:
            whole |= np.logical_or.reduceat(bad, starts)
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
        first = pa.array(heads, pa.string()).dictionary_encode()
        end = runs_of_ids(np.ones(1, dtype=np.int64), np.array([end_id], dtype="<i4")) if end_id is not None else pa.array([b""], pa.binary())
        plain = np.flatnonzero(~odd)
        blobs = pa.concat_arrays([self._pieces(pieces.take(pa.array(plain))), self._whole(first.dictionary.to_pylist()), end])
        place = np.zeros(len(pieces), dtype=np.int64)
        place[plain] = np.arange(len(plain))
        codes = place[codes]
        codes[starts] = len(plain) + first.indices.to_numpy()
        kept = ~np.repeat(whole, width)
        kept[starts] = True
        ends = np.cumsum(np.add.reduceat(kept, starts, dtype=np.int64)) if n else starts
        codes = np.insert(codes[kept], ends, len(blobs) - 1)
        ids = blobs.take(pa.array(codes))
        return lists_of_ids(ids, np.r_[0, ends + np.arange(1, n + 1)])


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _encode(path: str, end_id: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens = encoder(path).encode(texts_of(batch.column(1)), end_id)
    counts = pc.list_value_length(tokens).cast(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), counts, tokens], names=["doc_id", "n_tokens", "tokens"])


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> str:
    """Encode every whole text, append ``end_id``, and write the format above to ``out``.

    Texts are dealt by range of the id and sorted before they are encoded, so that only texts
    are shuffled and each file is one task's. Null ids come first; null or empty texts hold the
    end id alone; rows that share an id stand together, by the hash of their text.
    """
    require(docs, id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    dealt = source.repartitionByRange(files or shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("raw"))
    tokens = map_arrow(dealt, partial(_encode, path, end_id), "doc_id long, n_tokens long, tokens array<int>", BATCH_BYTES)
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}
    tokens.write.mode("error").options(**options).parquet(out)
    return out


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, file, row)``; only the selected columns are read."""
    table = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(out)
    return table.select("doc_id", "n_tokens", "tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def _placed(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_tokens` plus ``start``. Counts are summed for each file first; only
    those sums, one row a file, meet in one task. Files follow each other by their least id."""
    files = read_tokens(spark, out).groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("least"))
    before = Window.orderBy(F.asc_nulls_first("least"), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(bases, "file").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))


def token_starts(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, file, row)`` from counts alone: the ids before each document."""
    rows = read_tokens(spark, out).select("doc_id", "n_tokens", "file", "row")
    return _placed(spark, out, rows).select("doc_id", "start", "n_tokens", "file", "row")


def _crc(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(4)
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"])


def token_checksums(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files. A
    document without ids has checksum 0; files without rows give an empty table."""
    rows = read_tokens(spark, out).select("doc_id", "n_tokens", "file", "row", "tokens")
    sums = map_arrow(rows, _crc, "doc_id long, n_tokens long, file string, row long, ids_crc32 long")
    return _placed(spark, out, sums).select("doc_id", "start", "n_tokens", "ids_crc32")
