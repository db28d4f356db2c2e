"""The pipeline over a small folder, against plain versions of what its stages promise."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from test_decontaminate import least_edits
from test_line_dedup import brute as brute_lines
from test_operators import brute_components, prose, words

NOTICE = "Copyright notice that every page of this site repeats below"


def table(spark, folder, rows, items):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def passes_rules(text):
    raw, w = text or "", words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 5)}
    lines = [x for x in raw.split("\n") if words(x)]
    chars = sum(len(x.decode()) for x in w)
    rejected = (
        len(w) < 10, 100 * len(repeated) > 20 * len(w), 10 * len(re.findall(r"[#*$%&|<>]", raw)) > len(w), 100 * (len(lines) - len(set(lines))) > 50 * len(lines),
        100 * sum(a == b for a, b in zip(w, w[1:])) > 30 * len(w), 100 * sum(len(x) > 1 and x.isupper() for x in w) > 50 * len(w), not 2 * len(w) <= chars <= 15 * len(w),
    )
    return not any(rejected)


def brute(rows, items):
    """``{id: (ids, decoded)}`` by loops, for rows of which documents in one line group differ."""
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in rows if passes_rules(t)]
    trimmed = brute_lines(rows)
    rows = [(i, trimmed[i][0]) for i, _ in rows if words(trimmed[i][0]) or not trimmed[i][2]]
    kept = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    fold = lambda t: re.sub(r"\s", " ", t).lower()
    rows = [(i, t) for i, t in rows if all(least_edits(fold(x), fold(t)) > len(x) // 20 for _, x in items if x)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    return {i: (ids, library.decode(ids, skip_special_tokens=False)) for i, ids in coded}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item, base = prose(40), prose(80)
    near = base.split()
    near[40] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, "too short"), (4, "$$$ " * 40), (5, prose(30) + " " + item), (6, None)]
    rows += [(10 + i, f"{prose(60)}\n{NOTICE}") for i in range(12)]
    table(spark, d, rows, [(1, item)])
    return d


def test_pipeline(spark, folder):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(out) == [0, *range(10, 22)]
    assert all("copyright" not in r.decoded for r in out.values())
    assert all(r.n_tokens == len(r.ids) > 0 for r in out.values())
    first = [name for name, _ in corpus_pipeline.STAGES]
    assert len(first) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_the_plain_stages(spark, tmp_path):
    rnd = random.Random(77)
    items = [(k, prose(12, rnd)) for k in range(3)] + [(8, None), (9, "")]
    rows = [(i, f"{prose(rnd.randint(5, 60), rnd)}\n{prose(rnd.randint(8, 20), rnd)}") for i in range(40)]
    for i in rnd.sample(range(40), 9):
        rows[i] = (i, f"{rows[i][1]}\nPage {i} of the {rnd.choice(['first', 'second'])} yearly report of this house")
    for i in rnd.sample(range(40), 4):
        rows[i] = (i, f"{rows[i][1]}\nOnly {i} few hold this line of words")
    rows += [(50 + k, f"{prose(20, rnd)} {t[:20]}{rnd.choice(['', 'q'])}{t[20:]} {prose(20, rnd)}") for k, t in items[:3]]
    rows += [(60, "la " * 40), (61, "AB CD EF GH " * 5), (62, "# $ " * 20 + prose(10, rnd)), (63, None), (64, ""), (65, "\n".join([prose(9, rnd)] * 4))]
    # copies stay below the number of documents from which a line recurs
    copy = prose(70, rnd).split()
    rows += [(70 + k, " ".join([*copy[:k], "new", *copy[k + 1 :]])) for k in range(3)]
    table(spark, str(tmp_path), rows, items)
    out = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == brute(rows, items)
    assert 20 < len(out) < len(rows) - 8


def test_pipeline_of_nothing_and_with_more_columns(spark, tmp_path):
    table(spark, f"{tmp_path}/a", [(1, prose(40))], [])
    spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    docs = spark.createDataFrame([(None, prose(40), None, None, None, "x", 1), (7, prose(40), "de", "s", 3, None, None)], "doc_id long, text string, lang string, source string, n_chars long, kept_text string, Component_Id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/a")
        assert out.columns == docs.columns and out.count() == 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/a").count() == 2
