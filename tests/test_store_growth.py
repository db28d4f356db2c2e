"""What a saved index costs: each text is tokenised once, and its tables grow with the dictionary."""

from pyspark.sql import functions as F

from lexspark import queries as Q
from lexspark.functions import text as T
from lexspark.operators.index import build_index, one_off
from lexspark.operators.search import dictionary_of
from lexspark.operators.store import IndexStore
from lexspark.plans.query import Fuzzy, Settings


def saved(spark, sf_dir, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    store.save(build_index(Q._docs(spark, sf_dir)), Settings())
    return store, store._valid(Settings())[1][0]


def test_tokens_of_a_text_are_taken_once(spark):
    for camel in (False, True):
        plan = spark.createDataFrame([("a",)], "t string").select(T.tokenize(F.col("t"), camel))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract_all(coalesce(t#") == 1


def test_joiners_and_odd_forms_keep_their_order(spark):
    texts = ["", None, "plain Words plain", "x-ray -edge- a_b x", "-- ' _", "Éé ʰ ´ über-all ALL", "don't l’été DON'T", "語-a " + "w" * 65 + " ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r.v == list(dict.fromkeys(T.py_tokenize(r.t or ""))), r.t


def test_typo_forms_are_two_a_term(spark, sf_dir, tmp_path):
    store, part = saved(spark, sf_dir, tmp_path)
    terms, typos = (spark.read.parquet(f"{tmp_path}/ix/parts/{part.name}/{part.sums}/{t}") for t in ("terms", "typos"))
    assert 0 < typos.count() <= 2 * terms.count()
    held = store.load(Settings())
    every = {r.term for r in terms.select("term").distinct().collect()}
    for word in sorted(w for w in every if w.isascii() and 5 <= len(w) <= 9)[::4000]:
        for wanted in (word, word[1:], word + "x", word[:2] + "q" + word[2:], word[:3] + "z" + word[4:]):
            if len(wanted) < 4:
                continue
            near = {r.term for r in terms.where(F.levenshtein("term", F.lit(wanted)) <= 1).select("term").distinct().collect() if 3 <= len(r.term) <= 32}
            assert near == {r.term for r in held.find_typos(wanted).collect()}
            found = {r.term for r in dictionary_of(held, [wanted], Fuzzy(1.4 / len(wanted), 4, 99)).collect()}
            assert near <= found
    assert len(one_off("thing")) == 6


def test_zones_are_the_ends_of_their_files(spark, sf_dir, tmp_path):
    store, part = saved(spark, sf_dir, tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/ix/parts/{part.name}/postings").select("term", F.col("_metadata.file_name").alias("file"))
    want = {(r.file, r.a, r.b) for r in rows.groupBy("file").agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()}
    assert set(store._zones(part.name)) == want


def test_a_query_of_a_store_keeps_no_second_index(spark, sf_dir, monkeypatch):
    def kept(*_):
        raise AssertionError("the session's index is not what is saved")

    monkeypatch.setattr(Q, "index_of", kept)
    for name in ("q_store_search", "q_store_lookup", "q_store_typos"):
        assert Q.QUERIES[name](spark, sf_dir).count()


def test_a_change_reads_its_documents_for_terms_and_manifest_only(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    schema = "path string, mtime long, kind string, content string, basename string, directory string, aliases string, tags string, headings1 string, headings2 string, headings3 string"

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = spark.createDataFrame([(f"d{i}.md", i, "text", "granite", *[""] * 7) for i in range(8)], schema).mapInPandas(counted, schema)
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    store.apply(spark.createDataFrame([("old.md",)], "path string"), docs, Settings())
    part = store._valid(Settings())[1][0].name
    assert {r.path for r in store._read(part, "gone", "path string").collect()} == {"old.md", *(f"d{i}.md" for i in range(8))}
    assert read.value <= 2 * 8


def test_writers_compare_the_snapshot_once(spark, sf_dir, monkeypatch):
    seen, compare = spark.sparkContext.accumulator(0), Q.manifest_diff

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    monkeypatch.setattr(Q, "manifest_diff", lambda *held: compare(*held).mapInPandas(counted, "path string, action string"))
    assert Q.QUERIES["q_store_writers"](spark, sf_dir).count()
    assert 0 < seen.value <= Q._turns(spark, sf_dir).count()


def test_a_merge_joins_no_row_of_postings(spark, tmp_path, monkeypatch):
    schema = "path string, mtime long, kind string, content string, basename string, directory string, aliases string, tags string, headings1 string, headings2 string, headings3 string"
    store, settings, joined = IndexStore(spark, f"file://{tmp_path}/ix"), Settings(), []
    rows = IndexStore._rows
    monkeypatch.setattr(IndexStore, "_rows", lambda self, parts, table, *names: joined.append(table) or rows(self, parts, table, *names))
    merging = IndexStore._merge

    def merge(self, *held, **named):
        joined.clear()
        out = merging(self, *held, **named)
        merged.append(list(joined))
        return out

    merged = []
    monkeypatch.setattr(IndexStore, "_merge", merge)
    none = spark.createDataFrame([], "path string")
    for k, path in enumerate(("a.md", "b.md", "a.md", "c.md")):  # the third replaces the first
        store.apply(none, spark.createDataFrame([(path, k, "text", f"granite word{k}", *[""] * 7)], schema), settings)
    assert merged and all("postings" not in m for m in merged)
    held = store.load(settings)
    assert {(r.path, r.term) for r in held.postings.collect()} == {(p, t) for p, k in (("a.md", 2), ("b.md", 1), ("c.md", 3)) for t in ("granite", f"word{k}")}


def test_diacritics_are_taken_out_without_a_pattern(spark):
    held = T.diacritics()
    assert {"^", "`", "́", "̈"} <= set(held) and len(held) == len(set(held)) > 1000
    assert "regexp_replace" not in spark.createDataFrame([("a",)], "t string").select(T.normalize(F.col("t")))._jdf.queryExecution().analyzed().toString()
    row = spark.createDataFrame([("".join(f"x{c}" for c in held) + "ÉÜß",)], "t string").select(T.normalize(F.col("t")).alias("n")).first()
    assert row.n.replace("x", "").strip().endswith("euß") and not set(row.n) & {"^", "`", "́", "̈"}
