"""Token files: the encoder against the library, and what the files are laid out like."""

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers

from lexspark.llm.token_files import LibraryEncoder, read_tokens, token_checksums, token_starts, write_tokens

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"abcXYZ'  \n\t .,;!?012é😀ß한　\x85\x1c‍́|<>", "<|endoftext|>", "'s", "'ll", "  ", "\n\n", " the", " a"]


def test_encoder_equals_the_library_on_odd_texts():
    own, rnd = LibraryEncoder(BYTE_BPE), random.Random(5)
    for n in (0, 1, *[150] * 40):
        texts = ["".join(rnd.choices(LETTERS, k=rnd.randint(0, 25))) for _ in range(n)]
        want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)] if n else []
        assert own.encode(pa.array(texts, pa.string())).to_pylist() == want
        assert own.encode(pa.array(["cut", *texts], pa.string()).slice(1), 2).to_pylist() == [[*w, 2] for w in want]


def test_layout_and_selective_reads(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "x9", "Gamma,"], k=400)), "src") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3)
    out = write_tokens(docs, f"file://{tmp_path}/t", BYTE_BPE, 2, files=4)
    files = sorted(glob.glob(f"{tmp_path}/t/part-*"))
    assert len(files) == 4
    ranges = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        group = meta.row_group(0)
        ids, lists = group.column(0), group.column(2)
        assert lists.has_offset_index and lists.has_column_index and ids.has_column_index
        assert "RLE_DICTIONARY" in lists.encodings and lists.compression == "ZSTD"
        ranges.append((ids.statistics.min, group.column(0).statistics.max))
        assert group.total_byte_size <= 2 * (16 << 20)
    assert ranges == sorted(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    some = read_tokens(spark, out).where("doc_id between 1000 and 1003").select("doc_id", "tokens")
    assert "GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in some.collect()) == [1000, 1001, 1002, 1003]
    plan = token_starts(spark, out)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan.replace("n_tokens", "").split("Relation")[0]
    starts = [(r.doc_id, r.start, r.n_tokens) for r in token_starts(spark, out).orderBy("doc_id").collect()]
    at = 0
    for i, (doc, start, n) in enumerate(starts):
        assert (doc, start) == (i, at)
        at += n


def test_null_ids_empty_tables_and_ties(spark, tmp_path):
    rows = [(None, "b"), (None, None), (3, ""), (3, "a a"), (3, "a a"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = write_tokens(docs, f"file://{tmp_path}/n", BYTE_BPE, 2, files=2)
    got = sorted((r.start, r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_checksums(spark, out).collect())
    assert [g[2] for g in got] == [0, 0, 1, 3, 3, 3] and [g[1] for g in got[:2]] == [True, True]
    assert [g[0] for g in got] == [sum(x[3] for x in got[:i]) for i in range(6)]
    empty = write_tokens(docs.limit(0), f"file://{tmp_path}/e", BYTE_BPE, 2)
    assert token_checksums(spark, empty).count() == 0
