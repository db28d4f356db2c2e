"""Line dedup against a plain version: all pairs of lines, transitively, where documents differ."""

import random
import re

import numpy as np
import pytest

from lexspark.llm import line_dedup as module
from lexspark.llm.line_dedup import DEPTH, DOCUMENTS, SIMILAR, line_dedup
from test_operators import VOCABULARY, prose


def tokens(line):
    return [None if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]


def brute(rows):
    """``{id: (kept text, lines, dropped)}``, for documents of which none is a copy of another."""
    lines = [(i, line, tokens(line)) for i, t in rows for line in (t or "").split("\n")]
    lines = [x for x in lines if x[2]]
    group = list(range(len(lines)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            p, q = lines[a][2], lines[b][2]
            if len(p) == len(q) and p[:DEPTH] == q[:DEPTH] and sum(x == y for x, y in zip(p, q)) >= SIMILAR * len(p):
                group[root(a)] = root(b)
    holders = {}
    for n, (i, _, _) in enumerate(lines):
        holders.setdefault(root(n), set()).add(i)
    gone = {(i, line) for n, (i, line, _) in enumerate(lines) if len(holders[root(n)]) >= DOCUMENTS}
    out = {}
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [line for line in split if (i, line) not in gone]
        out[i] = (None if t is None else "\n".join(kept), sum(bool(tokens(x)) for x in split), len(split) - len(kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [[i, [prose(rnd.randint(8, 20), rnd) for _ in range(3)]] for i in range(60)]
    for held in (1, 2, 4, 5, 6, 9, 30, *[rnd.randint(1, 8) for _ in range(12)]):
        width = rnd.choice([1, 2, 3, 4, 6, 10, 17, 30])
        base, slots = rnd.sample(VOCABULARY, width), rnd.sample(range(min(DEPTH, width), width), int(0.15 * width)) if width > DEPTH else []
        for i in rnd.sample(range(60), held):
            line = [rnd.choice(VOCABULARY) if k in slots else w for k, w in enumerate(base)]
            if rnd.random() < 0.3:
                rows[i][1].append("")
            rows[i][1].insert(rnd.randint(0, len(rows[i][1])), rnd.choice([" ", "\t"]).join(line))
    rows = [(i, "\n".join(own)) for i, own in rows] + [(100, None), (101, ""), (102, "\n\n"), (103, "x " * 30_000)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in out} == brute(rows)


def test_forms_that_resemble_no_other_change_nothing(monkeypatch):
    rnd = random.Random(5)
    for width in (1, 3, 4, 5, 8, 12, 25, 60):
        bases = [rnd.choices(range(1, 60), k=width) for _ in range(60)]
        rows = []
        for _ in range(700):
            line = [t if k < DEPTH or rnd.random() < 0.85 else rnd.randint(1, 60) for k, t in enumerate(rnd.choice(bases))]
            line[:DEPTH] = [1, 2, 3][:width]
            rows += [line] * rnd.choice([1, 1, 1, 5, 7])
        forms = [hash(tuple(r)) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: forms[i])
        owners = np.array([rnd.randrange(40) for _ in rows])
        given = (np.array([forms[i] for i in order]), np.array([rows[i] for i in order], dtype=np.uint16), owners)
        fast = module.leaf_recurring(*given)
        monkeypatch.setattr(module, "MANY", 10**9)
        assert sorted(fast) == sorted(module.leaf_recurring(*given)) and len(fast) > 0
        monkeypatch.undo()


def test_a_large_leaf_over_many_batches(spark):
    rnd = random.Random(8)
    lines = [f"all of these {' '.join(rnd.choices(VOCABULARY, k=9))}" for _ in range(30_000)]
    common = "all of these lines end alike on every page here so"
    rows = [(i, f"{prose(12, rnd)}\n{line}" + (f"\n{common} {rnd.choice(VOCABULARY)}" if i % 5000 == 0 else "")) for i, line in enumerate(lines)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_dropped").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id for r in out if r.n_dropped} == {i for i in range(30_000) if i % 5000 == 0}


def kept(spark, rows, parts):
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    return {r.doc_id: (r.kept_text, r.n_dropped) for r in out}


def hub_and_others(rnd):
    """A document that is a near copy of eight others, of which no two are copies, and a footer in all nine."""
    eighths = [prose(40, rnd) for _ in range(8)]
    footer = "this page was made for you by the people of the house"
    texts = ["\n".join([*eighths, footer])]
    for k in range(8):
        texts.append("\n".join([*(eighths[j % 8] for j in range(k, k + 5)), prose(8, rnd), footer]))
    return texts


def test_the_order_of_rows_changes_nothing(spark):
    rnd = random.Random(9)
    common = ["every page of this house ends with the same old line", "and a second one of them stands here and there too"]
    base = [prose(50, rnd) for _ in range(12)]
    texts = hub_and_others(rnd)
    for k, b in enumerate(base):
        copy = b.split()
        for n in range(1 + k % 4):  # near copies
            copy[rnd.randrange(len(copy))] = f"edit{n}"
            texts.append(" ".join(copy) + "\n" + common[k % 2] + (f"\nonly the copies of number{'abcdefghijkl'[k]} have this line in them" if k % 4 == 3 else ""))
    rows = list(enumerate(texts))
    first = None
    for order in range(5):
        rnd.shuffle(rows)
        got = kept(spark, rows, 1 + order)
        first = first or got
        assert got == first
    assert all(common[0] not in t and common[1] not in t for t, _ in first.values())
    # a line of the near copies of one document alone is theirs
    assert sum("only the copies" in t for t, _ in first.values()) == 12


def test_copies_do_not_outvote(spark):
    rnd = random.Random(10)
    own = prose(60, rnd)
    rows = [(i, own + "\nthe line that only copies of one document have at all") for i in range(40)]
    rows += [(100 + i, prose(30, rnd) + "\na line that different documents have in common with others") for i in range(DOCUMENTS)]
    out = kept(spark, rows, 4)
    assert all(n == (i >= 100) for i, (_, n) in out.items())


def test_least_classes_are_free_of_order():
    rnd = random.Random(11)
    for _ in range(200):
        own = [rnd.randrange(12) for _ in range(rnd.randrange(30))]
        held = []
        for c in own:
            module.least_classes(held, c)
        assert held == sorted(set(own))[:DOCUMENTS]


def test_a_text_is_cut_into_tokens_once(spark, monkeypatch):
    """Words hashed in all passes: no more than there are, for each text is cut once and its different words are hashed."""
    hashed, deal = spark.sparkContext.accumulator(0), module.map_arrow

    def counted(df, fn, schema, *more):
        def run(batch):
            seen, real = [], module.hash_words
            module.hash_words = lambda words: seen.append(len(words)) or real(words)
            try:
                return fn(batch)
            finally:
                module.hash_words = real
                hashed.add(sum(seen))

        return deal(df, run, schema, *more)

    monkeypatch.setattr(module, "map_arrow", counted)
    rnd = random.Random(12)
    rows = [(i, "\n".join([*(prose(12, rnd) for _ in range(10)), "one line that every page has at its end"])) for i in range(100)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert all(r.n_dropped == 1 for r in out)
    assert 0 < hashed.value <= sum(len(t.split()) for _, t in rows)


def test_only_the_first_tokens_of_a_long_line_lead(spark):
    rnd = random.Random(13)
    line = rnd.choices(VOCABULARY, k=5000)
    rows = []
    for i in range(DOCUMENTS):
        own = [*line]
        own[4096:4099] = [f"{w}{'abcde'[i]}" for w in own[4096:4099]]
        rows.append((i, "\n".join([*(prose(12, rnd) for _ in range(1600)), " ".join(own)])))
    assert all(n == 1 for _, n in kept(spark, rows, 2).values())


def test_lines_are_cut_as_bytes_are_split():
    rnd = random.Random(14)
    for _ in range(500):
        raws = [rnd.choice([None, b"", b"\n"]) if rnd.random() < 0.2 else bytes(rnd.choices(b"ab1 \n\t\x0b\x0c\r\x00\xff\x1c\x85\xa0", k=rnd.randrange(30))) for _ in range(rnd.randint(1, 6))]
        lines = module.Lines(module.pa.array(raws, module.pa.binary()))
        plain = [(t, p, line.split()) for t, raw in enumerate(raws) for p, line in enumerate((raw or b"").split(b"\n"))]
        assert list(zip(lines.text.tolist(), lines.place.tolist(), lines.size.tolist(), strict=True)) == [(t, p, len(w)) for t, p, w in plain]
        words = [w for _, _, own in plain for w in own]
        fixed = [None if re.search(rb"[0-9]", w) else w for w in words]
        of = dict(zip(fixed, lines.tokens.tolist(), strict=True))
        assert [of[w] for w in fixed] == lines.tokens.tolist() and len(set(of.values())) == len(of) and of.get(None, 0) == 0


def test_texts_that_share_one_hash_stay_apart():
    pa = module.pa
    texts = [b"one two three", b"four\nfive six", b"one two three", None]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7, 8]), pa.array([1, 2, 1, 1]), pa.array(texts, pa.binary())], names=["key", "twin", "text"])
    out = module._emit(batch).to_pylist()
    assert [(r["key"], r["twin"], r["place"], [len(t) for t in r["tokens"]]) for r in out] == [(7, 1, [0], [6]), (7, 2, [0, 1], [2, 4])]
