import math
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lexspark.operators import match as M
from lexspark.operators import store as store_module
from lexspark.operators.engine import SearchEngine
from lexspark.operators.index import build_index, manifest_diff, sync
from lexspark.operators.store import IndexStore
from lexspark.operators.search import Fuzzy, ScoringConfig, dictionary_of, expand, max_edits, search
from lexspark.plans.query import Settings
from lexspark.sources.docs import DOC_COLUMNS, canvas_text, extractor, ignored, indexable, read_files

SCHEMA = ", ".join(f"{c} {'long' if c == 'mtime' else 'string'}" for c in DOC_COLUMNS)


def doc(path, content, kind="text", mtime=1, **more):
    folder, _, name = path.rpartition("/")
    row = {c: "" for c in DOC_COLUMNS} | {"path": path, "content": content, "kind": kind, "mtime": mtime, "directory": folder, "basename": name.rsplit(".", 1)[0]}
    return tuple((row | more)[c] for c in DOC_COLUMNS)


CORPUS = [
    doc("garden/tomato.md", "Plant seedlings in spring and water them."),
    doc("garden/compost.md", "A heap feeds every tomato and bean. The quick brown hen digs."),
    doc("code/parser.md", "function readConfigFile loads the settings; quick, brown!"),
    doc("code/notes.txt", "Recuperação de arquivos: tomato seeds"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA)


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs, camel=True).persist()


def paths(df):
    return [r.path for r in df.collect()]


def test_term_finds_its_documents_and_names_rank_first(index):
    got = paths(search(index, "tomato"))
    assert set(got) == {"garden/tomato.md", "garden/compost.md", "code/notes.txt"}
    assert got[0] == "garden/tomato.md"


def test_camel_parts_prefixes_and_accents(index):
    assert paths(search(index, "config")) == ["code/parser.md"]
    assert paths(search(index, "seedlin")) == ["garden/tomato.md"]
    assert paths(search(index, "recuperacao")) == ["code/notes.txt"]


def test_partial_hits_rank_below_full_ones(index):
    hits = search(index, "tomato bean").collect()
    assert hits[0].path == "garden/compost.md" and len(hits) == 3
    assert all(h.score < hits[0].score for h in hits[1:])


def test_typos(index):
    assert paths(search(index, "tomatp", fuzzy=Fuzzy(0.2))) != []
    assert paths(search(index, "tomatp", fuzzy=Fuzzy(0.0))) == []
    assert paths(search(index, "bwan", fuzzy=Fuzzy(0.2, 4))) == ["garden/compost.md"]
    assert paths(search(index, "bwan", fuzzy=Fuzzy(0.2, 5))) == []
    assert max_edits("four", Fuzzy(0.2)) == 1 and max_edits("abc", Fuzzy(0.9)) == 0


def test_exclusions_and_filters(index):
    assert set(paths(search(index, "tomato -compost"))) == {"garden/tomato.md", "code/notes.txt"}
    assert paths(search(index, "tomato .txt")) == ["code/notes.txt"]
    assert set(paths(search(index, "tomato path:GARDEN"))) == {"garden/tomato.md", "garden/compost.md"}
    assert paths(search(index, "tomato -path:garden")) == ["code/notes.txt"]


@pytest.mark.parametrize("raw", ["", "path:garden", "-", "-tomato"])
def test_nothing_to_rank_gives_no_hits(index, raw):
    assert paths(search(index, raw)) == []


def test_upsert_remove_and_phrases(spark, docs):
    engine = SearchEngine(spark, docs)
    engine.add(spark.createDataFrame([doc("garden/tomato.md", "nothing left but gravel")], SCHEMA))
    assert paths(engine.search("gravel seedlings")) == ["garden/tomato.md"]
    engine.remove(["garden/tomato.md", "no/such.md"])
    assert engine.manifest().count() == 3
    assert paths(engine.search('"quick brown" -"brown hen" gravel')) == ["code/parser.md"]
    page = spark.createDataFrame([("garden/compost.md",)], "path string")
    assert "<mark>hen</mark>" in engine.excerpts("hen", page).first().excerpt
    assert engine.lines("code/notes.txt", "seeds").count() == 1


def test_hits_carry_their_terms_to_excerpts_titles_and_jumps(spark, docs):
    engine = SearchEngine(spark, docs, Settings(fuzzy=Fuzzy(0.3)))
    hits = engine.search("tomatp")
    marks = {r.path: r.excerpt for r in engine.excerpts("tomatp", hits).collect()}
    assert "<mark>tomato</mark>" in marks["garden/compost.md"]
    titles = {r.path: r.title for r in engine.titles("tomatp", hits).collect()}
    assert titles["garden/tomato.md"] == "<mark>tomato</mark>" and titles["garden/compost.md"] == "compost"
    assert {r.path: (r.start, r.line) for r in engine.jumps("tomatp", hits).collect()}["garden/compost.md"] == (19, 0)
    engine.close()


def test_sync_restart_and_rebuild(spark, docs, tmp_path):
    current = [docs]
    engine = SearchEngine(spark, lambda: current[0], store=f"file://{tmp_path}/s")
    engine.persist()
    current[0] = docs.where("path <> 'code/parser.md'").unionByName(spark.createDataFrame([doc("new.md", "granite")], SCHEMA))
    assert paths(engine.search("granite")) == [] and paths(engine.search("granite", sync=True)) == ["new.md"]
    assert engine.sync() == (0, 0) and engine.manifest().count() == 4
    assert len(engine.store._names("parts")) == 2  # the change is saved as a part
    assert paths(SearchEngine(spark, current[0], store=f"file://{tmp_path}/s").search("granite")) == ["new.md"]
    engine.add(spark.createDataFrame([doc("own.md", "gravel")], SCHEMA))
    current[0] = current[0].unionByName(spark.createDataFrame([doc("own.md", "gravel"), doc("two.md", "gravel")], SCHEMA))
    assert engine.sync() == (1, 0) and paths(engine.search("gravel")) == ["own.md", "two.md"]
    engine.restart(Settings(split_camel_case=True))  # other options: the saved index does not serve
    assert paths(engine.search("granite")) == ["new.md"] and not engine.store._numbers()
    engine.rebuild()
    assert len(engine.store._numbers()) == 1 and paths(SearchEngine(spark, current[0], Settings(split_camel_case=True), f"file://{tmp_path}/s").search("granite")) == ["new.md"]


def test_populate_in_steps(spark, docs, tmp_path):
    engine = SearchEngine(spark, docs, store=f"file://{tmp_path}/p")
    seen = []
    engine.populate(lambda done, total: seen.append((done, total, sorted(r.path[-3:] for r in engine.store.load(Settings()).manifest.collect()))), step=2)
    assert len(seen) >= 2 and seen[-1][:2] == (4, 4) and "txt" in seen[-1][2]
    assert all("txt" not in kinds for done, _, kinds in seen if done < 4)
    assert paths(engine.search("bean")) == ["garden/compost.md"]
    engine.docs = docs.where("path <> 'garden/compost.md'")
    engine.populate()
    assert paths(engine.search("bean")) == []


def test_canvas(spark):
    canvas = '{"nodes":[{"text":"submarine"},{"file":"x.md"}],"edges":[{"label":"dives"}]}'
    index = build_index(spark.createDataFrame([doc("board.canvas", canvas, "canvas")], SCHEMA))
    assert paths(search(index, "submarine dives")) == ["board.canvas"]
    assert spark.range(1).select(canvas_text(F.lit("{broken"))).first()[0] == ""


def test_store_round_trip_and_validation(spark, docs, index, tmp_path):
    store, settings = IndexStore(spark, f"file://{tmp_path}/index"), Settings(split_camel_case=True)
    assert store.load(settings) is None
    store.save(index, settings)
    held = store.load(settings)
    assert held.manifest.count() == 4
    assert search(held, "tomato bean").collect() == search(index, "tomato bean").collect()
    plan = held.postings_of(["tomato", "bean"])._jdf.queryExecution().toString()
    assert "In(term, [bean,tomato])" in plan or "In(term, [tomato,bean])" in plan
    assert store.load(Settings()) is None  # other options: cleared
    assert store.load(settings) is None


def same_index(held, plain, *queries):
    for raw in queries:
        assert search(held, raw).collect() == search(plain, raw).collect()
    assert sorted(map(tuple, held.terms.select("field", "term", "df").collect())) == sorted(map(tuple, plain.terms.select("field", "term", "df").collect()))
    assert sorted((r.field, r.n, round(r.avg_len, 9)) for r in held.stats.collect()) == sorted((r.field, r.n, round(r.avg_len, 9)) for r in plain.stats.collect())
    assert sorted(held.manifest.collect()) == sorted(plain.manifest.collect())


def test_store_parts_commits_and_damage(spark, docs, tmp_path, monkeypatch):
    root, settings = f"{tmp_path}/ix", Settings()
    store = IndexStore(spark, f"file://{root}", grace=0)
    store.apply(spark.createDataFrame([], "path string"), docs, settings)
    none, new = docs.select("path").limit(0), None
    for k in range(4):
        new = spark.createDataFrame([doc("garden/tomato.md", f"gravel round{k}", mtime=k), doc(f"new/{k}.md", "granite")], SCHEMA)
        gone = none if k else spark.createDataFrame([("code/notes.txt",), ("no/such",)], "path string")
        store.apply(gone, new, settings)
        held = store.load(settings)
        assert paths(search(held, f"round{k}")) == ["garden/tomato.md"] and search(held, "granite").count() == k + 1
    assert store.rewritten and len(store._newest()[1]["parts"]) < 5  # parts of one tier were merged
    plain = build_index(docs.where("path not in ('code/notes.txt', 'garden/tomato.md')").unionByName(new.limit(1)).unionByName(spark.createDataFrame([doc(f"new/{i}.md", "granite") for i in range(k + 1)], SCHEMA)))
    same_index(held, plain, "granite", "tomato quick", f"round{k} bean")
    # without grace, nothing that the newest commit does not name outlives it
    assert len(store._numbers()) == 1 and len(store._names("parts")) == len(store._newest()[1]["parts"])

    def fails(*_):
        raise OSError("the file system does not answer")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(IndexStore, "_commit", fails)
        store.load(settings)
    assert store.load(settings) is not None  # nothing was deleted
    number, commit = store._newest()
    assert not store._take(number, commit["parts"], settings)  # a number is given out once
    with pytest.raises(store_module.StoreMoved):
        store.save(plain, settings, base=number - 1)
    (tmp_path / f"ix/commits/{number + 1:012}.json").write_text("{damaged")
    assert search(store.load(settings), "granite").count() == k + 1
    store.apply(none, spark.createDataFrame([doc("new/9.md", "granite")], SCHEMA), settings)  # a damaged commit keeps its number
    assert search(store.load(settings), "granite").count() == k + 2
    store.clear()
    assert store.load(settings) is None


def test_one_number_goes_to_one_of_many_takers(spark, tmp_path):
    stores = [IndexStore(spark, f"file://{tmp_path}/ix") for _ in range(16)]
    part = store_module.Part("p", "s", 1)
    for number in range(1, 6):
        with ThreadPoolExecutor(16) as pool:
            taken = list(pool.map(lambda s, n=number: s._take(n, [part], Settings()), stores))
        assert sum(taken) == 1
    assert stores[0]._numbers() == [1, 2, 3, 4, 5] and not [n for n in stores[0]._names("commits") if n.endswith(".tmp")]


def test_writers_at_once_lose_nothing(spark, docs, tmp_path):
    settings, root = Settings(), f"file://{tmp_path}/ix"
    IndexStore(spark, root).apply(docs.select("path").limit(0), docs, settings)
    before = IndexStore(spark, root).load(settings)
    start = threading.Barrier(10)

    def write(k):
        store = IndexStore(spark, root)
        new = spark.createDataFrame([doc(f"own/{k}.md", f"granite own{k}"), doc("both.md", f"marble last{k}", mtime=k)], SCHEMA)
        gone = spark.createDataFrame([("code/parser.md",)] if k == 3 else [], "path string")
        # nobody commits before all have written what they began on the same snapshot
        store.apply(gone, new, settings, meanwhile=lambda: start.wait(300))

    with ThreadPoolExecutor(10) as pool:
        list(pool.map(write, range(10)))
    held = IndexStore(spark, root).load(settings)
    last = held.manifest.where("path = 'both.md'").first().mtime
    want = docs.where("path <> 'code/parser.md'").unionByName(spark.createDataFrame([doc(f"own/{k}.md", f"granite own{k}") for k in range(10)] + [doc("both.md", f"marble last{last}", mtime=last)], SCHEMA))
    same_index(held, build_index(want), "granite", "marble", "tomato")
    # a reader who began before them still finds all its files
    assert paths(search(before, "parser")) == ["code/parser.md"] and search(before, "granite").count() == 0


def test_a_writer_whose_parts_were_cleared_is_told(spark, docs, tmp_path):
    store, settings = IndexStore(spark, f"file://{tmp_path}/ix"), Settings()
    store.apply(docs.select("path").limit(0), docs, settings)
    with pytest.raises(store_module.StoreMoved):
        store.apply(docs.select("path").limit(0), docs.limit(1), settings, meanwhile=store.clear)


def opened(frame):
    return {f.rsplit("/", 1)[1] for f in frame.inputFiles()}


def test_only_files_that_may_hold_a_term_are_opened(spark, tmp_path):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß語", k=rnd.randint(3, 9))) for _ in range(3000)})
    docs = spark.createDataFrame([doc(f"d{i}.md", " ".join(rnd.sample(words, 40))) for i in range(300)], SCHEMA)
    store, settings = IndexStore(spark, f"file://{tmp_path}/ix"), Settings()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.save(build_index(docs), settings)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = store.load(settings)
    table = spark.read.parquet(f"{tmp_path}/ix/parts/*/postings").select("term", F.input_file_name().alias("file")).distinct().collect()
    of = {}
    for r in table:
        of.setdefault(r.term, set()).add(r.file.rsplit("/", 1)[1])
    assert len(set().union(*of.values())) >= 10
    known = sorted(of, key=str.encode)
    for names in ([known[5]], known[3:9] + known[-9:-3], [known[0], known[-1]], rnd.sample(known, 14)):
        files = opened(held.postings_of(names))
        assert set().union(*(of[n] for n in names)) <= files
        # a term at the border of two files may lie in the range of both
        assert len(files) <= len({f for n in names for f in of[n]}) + 1 and len(files) < 12 or len(names) > 10
        assert held.postings_of(names).select("path", "term").distinct().count() == held.postings.where(F.col("term").isin(names)).select("path", "term").distinct().count()
    assert held.postings_of(["0 no such term"]).count() == 0


def test_typos_are_found_by_name(spark, tmp_path):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choices("abcé", k=rnd.randint(2, 7))) for _ in range(600)}) + ["x" * 32, "x" * 33, "y" * 40]
    docs = spark.createDataFrame([doc(f"d{i}.md", " ".join(words[i::20])) for i in range(20)], SCHEMA)
    store, settings = IndexStore(spark, f"file://{tmp_path}/ix"), Settings()
    store.save(build_index(docs), settings)
    held, config = store.load(settings), ScoringConfig()
    told = lambda terms, wanted, fuzzy: sorted((r.field, r.term, r.q, r.m) for r in expand(terms, wanted, fuzzy, config).collect())
    for wanted, fuzzy in ((["abca"], Fuzzy(0.2)), (["bacé", "cabb"], Fuzzy(0.3)), (["aabbc"], Fuzzy(0.2, 4, 9)), (["abc", "aaaa"], Fuzzy(0.25, 3)), (["x" * 32], Fuzzy(0.03)), (["aabbccaa"], Fuzzy(0.3))):
        some = dictionary_of(held, wanted, fuzzy)
        assert told(some, wanted, fuzzy) == told(held.terms, wanted, fuzzy)
    few = dictionary_of(held, ["aabbc"], Fuzzy(0.2, 4, 9))
    assert few.count() < 0.2 * held.terms.count()
    assert "PushedFilters: [" in few._jdf.queryExecution().toString() and "In(term" in few._jdf.queryExecution().toString().replace("EqualTo(term", "In(term")


def test_merges_rewrite_n_log_n_rows():
    for n in (64, 1024, 8192):
        parts, written = [], 0
        for k in range(n):
            parts.append(store_module.Part(str(k), "", 2))
            while run := store_module.due_merge(parts):
                a, b = run
                parts[a:b] = [store_module.Part("m", "", sum(p.rows for p in parts[a:b]))]
                written += parts[a].rows
            held = store_module.tiers(parts)
            assert held == sorted(held, reverse=True) and all(held.count(t) < store_module.FAN for t in held)
        assert sum(p.rows for p in parts) == 2 * n
        # each row is written again once for each tier, and there are log4(2n) of them
        assert written <= 2 * n * (math.log(2 * n, store_module.FAN) + 1)
        assert len(parts) <= 3 * (math.log(2 * n, store_module.FAN) + 1)


def test_a_large_change_takes_smaller_parts_before_it_along():
    part = lambda rows: store_module.Part("x", "", rows)
    assert store_module.tiers([part(100), part(1), part(2), part(70)]) == [3, 3, 3, 3]
    assert store_module.due_merge([part(100), part(1), part(2), part(70)]) == (0, 4)
    assert store_module.due_merge([part(1000), part(1), part(2), part(3)]) is None
    assert store_module.due_merge([part(1000), part(1), part(2), part(3), part(1)]) == (1, 5)


def test_manifest_diff_and_sync(spark, docs, index):
    known = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "path string, mtime long")
    now = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1)], "path string, mtime long")
    assert dict(manifest_diff(known, now).collect()) == {"a": "update", "b": "keep", "c": "remove", "d": "add"}
    changed = docs.where("path <> 'code/parser.md'").withColumn("mtime", F.when(F.col("path") == "garden/compost.md", 9).otherwise(F.col("mtime")))
    changed = changed.withColumn("content", F.when(F.col("mtime") == 9, "granite").otherwise(F.col("content")))
    after = sync(index, changed)
    assert paths(search(after, "granite")) == ["garden/compost.md"] and after.manifest.count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.md").write_text("---\naliases: [one, two]\ntags: x\n---\n# Head\n## Second\ntext #tagged\n#### deep\n")
    (tmp_path / "skip.bin").write_text("zz")
    (tmp_path / "sub" / "secret.md").write_text("hidden")
    got = read_files(spark, str(tmp_path), filters=["sub/secret"]).collect()
    assert [(r.path, r.basename, r.directory, r.aliases, r.tags, r.headings1, r.headings2, r.headings3) for r in got] == [("sub/note.md", "note", "sub", "one two", "x tagged", "Head", "Second", "")]
    (tmp_path / "sub" / "broken.md").write_bytes(b"caf\xe9 \xff text")
    (tmp_path / "sub" / "paper.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub" / "bad.pdf").write_bytes(b"bad")
    (tmp_path / "sub" / "other.pdf").write_bytes(b"%PDF")

    def reader(path, content):
        return None if path.endswith("other.pdf") else {b"%PDF": "paper text"}[content]

    got = {r.path: r.content for r in read_files(spark, str(tmp_path), Settings(index_pdf=True), ["sub/secret"], extractor(reader), lambda p: ~p.contains("none")).collect()}
    assert got["sub/broken.md"] == "caf\ufffd \ufffd text" and got["sub/paper.pdf"] == "paper text" and got["sub/bad.pdf"] == got["sub/other.pdf"] == ""
    assert "sub/paper.pdf" not in {r.path for r in read_files(spark, str(tmp_path), Settings(index_pdf=True), None, extractor(reader), lambda p: p.contains("bad")).collect()}
    assert "sub/paper.pdf" not in {r.path for r in read_files(spark, str(tmp_path), Settings(), None, extractor(reader)).collect()}
    df = spark.createDataFrame([("a.pdf",), ("A.MD",), ("b.org",)], "p string")
    assert [r[0] for r in df.where(indexable(F.col("p"), Settings(extra_file_types=("org",)))).collect()] == ["A.MD", "b.org"]
    assert df.where(ignored(F.col("p"), ["a.", "/ORG$/", "/(/"])).count() == 2
    # the engine that runs an expression decides what one is
    assert df.where(ignored(F.col("p"), [r"/\p{Lu}\.MD/", "/(?P<n>x)/"])).count() == 1


def spans(spark, text):
    from lexspark.functions.text import token_spans

    return token_spans(spark.createDataFrame([("d", text)], "path string, t string"), "path", "t")


def test_phrases_and_places(spark):
    text = "Recuperação de arquivos; de arquivo"
    found = [(r.start, r.length) for r in M.phrase_offsets(spans(spark, text), "de arquivos").collect()]
    assert found == [(12, 11)]
    near = [r.start for r in M.approx_phrase_offsets(spans(spark, text), "recuperacao de arquivo").collect()]
    assert near == [0]
    assert M.approx_phrase_offsets(spans(spark, text), "arquivos").count() == 0
    places = [(r.start, r.length, r.term) for r in M.term_offsets(spans(spark, "prefixes pre-fix"), ["pref", "fix"]).orderBy("start").collect()]
    assert places == [(0, 4, "pref"), (9, 7, "fix")]


def test_window_prefers_different_terms(spark):
    text = "cat cat cat " + "filler " * 60 + "cat dog"
    got = M.best_window(M.term_offsets(spans(spark, text), ["cat", "dog"])).orderBy("start").collect()
    assert [r.term for r in got] == ["cat", "dog"]


def test_excerpt_and_highlight(spark):
    df = spark.createDataFrame([("d", "x " * 100 + "needle here\nnext " + "y " * 300)], "path string, content string")
    out = M.excerpts(df, "needle", ["needle"]).first().excerpt
    assert out.startswith("…") and "<mark>needle</mark> here next" in out and out.endswith("…")
    assert M.excerpts(df, "zzz", ["zzz"]).first().excerpt.startswith("x x")


def test_lines(spark):
    df = spark.createDataFrame([("d", "a cat\r\nno\ncat and dog\ncat dog")], "path string, content string")
    got = [(r.line, r.distinct_terms, r.phrase) for r in M.search_lines(df, "cat dog").orderBy("rank").collect()]
    assert got == [(3, 2, True), (2, 2, False), (0, 1, False)]
