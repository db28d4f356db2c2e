"""Odd tables for every operator: nulls in any column, ties, repeated rows, clashing names, no rows."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexspark.llm.bpe import bpe_encode, bpe_round_trip
from lexspark.llm.line_dedup import line_dedup
from lexspark.llm.minhash import near_duplicates
from lexspark.llm.pii import find_pii
from lexspark.llm.quality import quality_filter, quality_report, quality_verdicts
from lexspark.llm.secrets import find_secrets
from lexspark.llm.substring_dedup import levels, substring_dedup
from test_operators import VOCABULARY, brute_components, prose, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, Kept string, `__id` long, `__raw` string, Failed_Rule string, n_lines int, ids string, id string, `key` int"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(44)
    texts = [None, "", prose(30, rnd), prose(30, rnd), "x" * 3000, "a b", prose(2500, rnd)]
    rows = [(i, t, "k", i, None, "f", 1, "x", "y", None) for i, t in enumerate([*texts, texts[2], texts[2]])]
    rows += [(None, texts[2], None, None, None, None, None, None, None, None)] * 2 + [rows[3], (3, texts[5], "other", None, "", "", 2, "", "", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OPERATORS = {
    "minhash": near_duplicates,
    "secrets": find_secrets,
    "pii": find_pii,
    "report": quality_report,
    "verdicts": quality_verdicts,
    "encode": lambda d: bpe_encode(d, WORD_BPE),
    "trip": lambda d: bpe_round_trip(d, WORD_BPE),
    "substring": substring_dedup,
    "lines": line_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_whatever_the_columns(odd, name):
    out = OPERATORS[name](odd)
    assert out.count() == odd.count()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    empty = OPERATORS[name](odd.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_clashing_columns_are_replaced_and_others_stay(odd):
    out = near_duplicates(odd)
    assert {"__id", "__raw", "n_lines"} <= set(out.columns) and "Kept" not in out.columns and dict(out.dtypes)["kept"] == "boolean"
    assert quality_filter(odd).columns == odd.columns


def test_rows_that_share_an_id_link_through_each_of_their_texts(spark):
    rnd = random.Random(3)
    a, b, c = (prose(60, rnd) for _ in range(3))
    near = {t: " ".join([*t.split()[:-1], "end"]) for t in (a, b, c)}
    rows = [(5, a), (5, b), (5, c), (7, near[a]), (2, near[b]), (9, near[c]), (9, near[c]), (4, prose(60, rnd)), (None, a), (8, a)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in out if r.doc_id} == {5: 2, 7: 2, 2: 2, 9: 2, 8: 2, 4: 4}
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]


def test_groups_of_copies_and_chains(spark):
    rnd = random.Random(12)
    rows, at = [], 0
    for size in (1, 2, 30, 300):
        base = prose(80, rnd).split()
        for k in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(80)] = rnd.choice(VOCABULARY)
            rows.append((at * 7919 % 1009, " ".join(text)))
            at += 1
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(rows)


def brute_removed(rows, width):
    """Rows in order of id, null last; those of one id are one place."""
    place = {i: n for n, i in enumerate(sorted({i for i, _ in rows}, key=lambda i: (i is None, i or 0)))}
    first = {}
    for i, t in sorted(rows, key=lambda r: place[r[0]]):
        w = words(t)
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), place[i])
    out = []
    for i, t in rows:
        w, seen = words(t), set()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if first[key] < place[i] or key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        if len(w) >= width and any(x != i and place[x] < place[i] and words(u) == w for x, u in rows):
            gone = [True] * len(w)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [2, 7, 20, 45, 70])
def test_substring_levels_and_shared_ids(spark, width):
    rnd = random.Random(width)
    passages = [prose(rnd.randint(width // 2 + 1, 2 * width + 5), rnd) for _ in range(6)]
    rows = [(i, " ".join(rnd.choice([prose(rnd.randint(0, 30), rnd), rnd.choice(passages)]) for _ in range(6))) for i in range(25)]
    rows += [(None, f"{prose(5, rnd)} {p} {prose(9, rnd)}") for p in passages] + [(3, passages[0]), (3, rows[4][1]), (None, rows[4][1]), (40, None), (41, "la " * 90)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_removed(rows, width)
    assert levels(width)[-1] == width and all(b <= 2 * a for a, b in zip(levels(width), levels(width)[1:]))
