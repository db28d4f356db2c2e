"""Decontamination against edit distance by the plain table, for items of every length."""

import random

import numpy as np
import pytest

from lexspark.llm import decontaminate as module
from lexspark.llm.decontaminate import ItemIndex, benchmark_matches, decontaminate, find_items


def least_edits(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for r, c in enumerate(item, 1):
        last, row[0] = row[0], r
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rnd, item, n, letters):
    out = list(item)
    for _ in range(n):
        at, how = rnd.randrange(len(out)), rnd.randrange(3)
        if how == 0:
            out[at] = rnd.choice(letters)
        elif how == 1:
            out.insert(at, rnd.choice(letters))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("letters,hits", [("abcdefghij ", 1 << 20), ("ab", 64), ("a", 1000)])
def test_every_length_against_the_plain_table(monkeypatch, letters, hits):
    monkeypatch.setattr(module, "HITS", hits)
    rnd = random.Random(hits)
    items = [(n, "".join(rnd.choices(letters, k=n)).strip() or "a") for n in [*range(1, 50), 60, 79, 100]]
    texts = []
    for _, item in items:
        for n in (0, 1, 2, len(item) // 20, len(item) // 20 + 1):
            around = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(2)]
            texts.append(around[0] + edited(rnd, item, n, letters) + around[1])
    texts += ["", " ", "zz"]
    got = {(row, item): edits for row, item, _, _, edits in find_items(texts, ItemIndex(items))}
    some = rnd.sample(range(len(texts)), 30 if len(letters) < 5 else 60)
    want = {}
    for row in some:
        for i, item in items:
            if (n := least_edits(item, texts[row])) <= len(item) // 20:
                want[row, i] = n
    assert {k: v for k, v in got.items() if k[0] in some} == want


def test_long_texts_and_one_repeated_letter_stay_in_memory():
    index = ItemIndex([(1, "-" * 3000), (2, "x" * 40)])
    rng = np.random.default_rng(3)
    text = "-" * 5000 + "".join(map(chr, rng.integers(97, 119, 50_000))) + "x" * 40
    assert [(row, item, edits) for row, item, _, _, edits in find_items([text], index)] == [(0, 1, 0), (0, 2, 0)]


def test_blocks_cases_and_columns(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i, " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(8))) for i in range(30)]
    rows = [(i, f"before {t} after", "src", 1) for i, t in items] + [(100, None, "src", 1), (101, "", None, None), (None, items[0][1], "s", 2), (3, f"before {items[3][1]} after", "src", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `start` string, Item_ID int")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "before"), items[0]], "item_id long, text string")
    want = sorted([(i, i) for i, _ in items] + [(3, 3), (-1, 0)])

    def found():
        return sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in benchmark_matches(docs, bench).collect())

    assert found() == want
    monkeypatch.setattr(module, "BLOCK_CHARS", 400)
    assert found() == want
    left = decontaminate(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [100, 101] and left.columns == docs.columns
    assert benchmark_matches(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(rows)
