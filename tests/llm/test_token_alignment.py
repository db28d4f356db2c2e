"""Token alignment against a plain version that asks both libraries for each text."""

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexspark.llm.bpe import byte_letters
from lexspark.llm.queries import op12_token_alignment
from lexspark.llm.token_alignment import align_tokens, linked, overlaps
from test_cases import SCHEMA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "a", " a ", "a  b", "x\ty\n\nz", "<|endoftext|> hi <s></s>", "▁a b▁ c", "ﬁ é ①  ", "é\x00b", "日本語 テキスト 🙂🙂",
    " ", "   ", "\n", "a b  c", "don't I'll " * 3, " á é", "<0x41> <unk>", "La La La la", "Enerverzu eintete erügeber geie.", "q" * 3000,
]


def plain(texts):
    """Rows of counts by text; every link looked up in a count of all links."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    byte_of = {c: b for b, c in byte_letters().items()}
    held = []
    for text in texts:
        rows = None
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            a_bytes = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (list(accumulate(map(len, x))) for x in (a_bytes, b_bytes))
                links = [(x, y) for x, e in zip(a, a_ends, strict=True) for y, f in zip(b, b_ends, strict=True) if e == f] if len(text) < 5000 else None
                if links is None:
                    of = dict(zip(b_ends, b, strict=True))
                    links = [(x, of[e]) for x, e in zip(a, a_ends, strict=True) if e in of]
                groups, low = [], 0
                at = dict(zip(a_ends, range(len(a)), strict=True)), dict(zip(b_ends, range(len(b)), strict=True))
                i = j = 0
                for low in sorted(set(a_ends) & set(b_ends)):
                    p, q = at[0][low] + 1, at[1][low] + 1
                    groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                    i, j = p, q
                rows = len(a), len(b), links, ";".join(groups), len(groups)
        held.append(rows)
    counts = Counter(p for r in held if r for p in r[2])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for r in held:
        if r is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, links, groups, n = r
            out.append((n_a, n_b, n, len(links), groups, sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links)))
    return out


def told(frame):
    return {r[0]: tuple(r)[1:] for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()}


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_odd_texts_equal_the_plain_version(spark, chunk_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = told(align_tokens(docs, A, B, chunk_bytes=chunk_bytes))
    want = plain(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert sum(w[0] == 0 for w in want) == 3  # null, empty, and one whose sign for a space is taken for one


def test_the_query_equals_the_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain([r.text for r in rows])
    out = op12_token_alignment(spark, sf_dir)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = told(out.withColumnRenamed("groups_sha256", "groups"))
    for r, w in zip(rows, want, strict=True):
        assert got[r.doc_id] == (*w[:4], hashlib.sha256(w[4].encode()).hexdigest() if w[0] else "", *w[5:])


def test_intervals_and_links_of_empty_tokens():
    a, b = np.array([2, 2, 5, 9]), np.array([1, 2, 2, 7, 9, 9])
    ends, left, right, closes = overlaps(a, b)
    assert ends.tolist() == [1, 2, 5, 7, 9] and left.tolist() == [0, 0, 2, 3, 3] and right.tolist() == [0, 1, 3, 3, 4] and ends[closes].tolist() == [2, 9]
    p, q = linked(a, b, ends[closes])
    assert list(zip(p.tolist(), q.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 4), (3, 5)]
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in (*overlaps(none, none), *linked(none, none, none))] == [0] * 6


def test_odd_tables(spark):
    rows = [(i, t, "k", i, None, "f", 1, "x", "y", None) for i, t in enumerate([None, "", "one two", "one two"])]
    rows += [(None, "one two", None, None, None, None, None, None, None, None), rows[2]]
    odd = spark.createDataFrame(rows, SCHEMA)
    out = align_tokens(odd, A, B)
    assert out.count() == 6 and out.where("n_links = 0").count() == 2
    # four texts alike: each link stands in all of them
    assert {r.count_sum for r in out.where("n_links > 0").collect()} == {4 * out.agg(F.max("n_links")).first()[0]}
    assert align_tokens(odd.limit(0), A, B).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(unhex('61ff') as string) as text")
    assert align_tokens(broken, A, B).first().n_a == 0
