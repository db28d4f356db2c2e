"""Parity sketches: the bound, the pigeonhole, and the join against all pairs."""

import random

import numpy as np
import pytest

from lexspark.llm.parity_join import Bands, jaccard_join, may_link, scheme, sketch
from test_cases import SCHEMA
from test_operators import brute_components, prose


def test_the_sketch_distance_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 60, rnd.integers(1, 80))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        words = int(rnd.integers(1, 6))
        (p, x), (q, y) = sketch(a, words), sketch(b, words)
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))
        for own, both in zip((p ^ q, x ^ y), sketch(np.setxor1d(a, b), words), strict=True):
            assert np.array_equal(own, both)


@pytest.mark.parametrize("percent", [50, 80, 90, 99, 100])
def test_bands_hold_every_pair_of_sizes(percent):
    bands = Bands(percent)
    for y in range(1, 700):
        band = bands.of(y)
        assert bands.lows[band] <= y < bands.lows[band + 1]
        for x in range(-(-percent * y // 100), y + 1):
            most = (x + y) * (100 - percent) // (100 + percent)
            if most:
                wanted = [dict(bands.layouts(size)).get(band, 0) for size in (x, y)]
                assert most < min(wanted) and max(wanted) <= bands.words(band)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_key_and_stay_candidates(percent):
    rnd, own, bands = np.random.default_rng(2), scheme(percent), Bands(percent)
    tried = 0
    while tried < 300:
        size = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        gone, new = rnd.integers(0, 1 + size // 12, 2)
        b = np.unique(np.concatenate([np.delete(b, rnd.permutation(len(b))[:gone]), rnd.integers(0, 2**63, new).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        tried += 1
        if tried % 3 == 0:  # few tokens a word: weak words, and sets with too few strong ones
            keep = np.concatenate([a, b])[rnd.permutation(len(a) + len(b))[: 4 + size // 4]]
            a, b = np.intersect1d(a, keep), np.intersect1d(b, keep)
            shared = len(np.intersect1d(a, b))
            if np.array_equal(a, b) or 100 * shared < percent * (len(a) + len(b) - shared):
                continue
        sigs = [own.sign(a), own.sign(b)]
        place, keys = own.keys(sigs)
        assert set(keys[place == 0]) & set(keys[place == 1])
        assert may_link(bands, *sigs)


def families(rnd):
    """Copies, chains of edits whose ends are unlike, pairs just below and above the bound, short texts."""
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three", "One two\tthree four"]
    for n in (12, 40, 75, 200, 900):
        base = prose(n, rnd).split()
        for step in range(14):
            texts.append(" ".join(base))
            for _ in range(rnd.randrange(1, 1 + max(2, n // 50))):
                base[rnd.randrange(n)] = f"new{step}"
            if step % 5 == 0:
                base = [*base, *prose(rnd.randrange(3), rnd).split()]
                n = len(base)
            if step % 4 == 0:
                texts.append(texts[-1])
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    rows = families(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in jaccard_join(docs).collect()}
    want = brute_components(rows, 3, 90)
    assert out == want
    assert 8 < len({c for _, c, _ in want.values()}) < len(rows) - 20


def test_odd_tables(spark):
    text = prose(60, random.Random(4))
    rows = [(i, t, "k", i, None, "f", 1, "x", "y", None) for i, t in enumerate([None, "", text, text, prose(3000)])]
    rows += [(None, text, None, None, None, None, None, None, None, None), rows[2]]
    odd = spark.createDataFrame(rows, SCHEMA)
    out = jaccard_join(odd)
    got = [(r.doc_id, r.component_id) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (1, 1), (2, 2), (3, 2), (4, 4), (None, None), (2, 2)], key=str)
    assert jaccard_join(odd.limit(0)).count() == 0
