"""Spans stay in the row of their document."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import match as M
from lexspark.operators.engine import deal_steps, in_steps
from lexspark.operators.search import ScoringConfig, expansion_weight
from lexspark.plans.query import Fuzzy
from lexspark.queries import ORACLE_SQL, QUERIES
from lexspark.streaming import pending

TEXTS = ["is the", "is -- the", "is é the", "is\nall the", "Is “thé” end", "is " + "x" * 65 + " the", "isthe", "is ́ the", "this the other", None, ""]


def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")


def test_running_sums(spark):
    for n in (0, 1, 15, 16, 17, 5000):
        got = spark.range(1).select(T.running_sums(F.when(F.lit(n > 0), F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>")))).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_phrases_agree_with_all_tokens_and_move_none(spark):
    df = table(spark)
    for phrase in ("is the", "is the end"):
        words = T.phrase_sequence(phrase)
        every = {r.k for r in M.phrase_offsets(T.token_spans(df, "k", "t"), phrase, "k").collect()}
        assert {r.k for r in M.contains_phrase(df, phrase, "k", "t").collect()} == every
        few = M.phrase_offsets(T.span_rows(df, "k", "t", words=words), phrase, "k")
        assert {r.k for r in few.collect()} == every and every
    for plan in (few, T.token_spans(df, "k", "t"), M.search_lines(df, "is the", "k", "t"), M.term_offsets(T.span_rows(df, "k", "t", words=["is"]), ["is"], "k")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Sort" not in text and "Window" not in text


ODD = ["is-the the", "xIs TheX", "thé’is the", "ﬁ is the", "is " + "-" * 70 + " the", "ís t\u0301he", "isé thé", "well-known is", "’ is ’ the", "é " * 5000, "a-" * 5000 + "is the", "is the-", "K the", "is, x the"]


def test_phrases_by_patterns_are_those_of_all_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS + ODD)), "k long, t string")
    for camel in (False, True):
        every = T.token_spans(df, "k", "t", camel).persist()
        for phrase in ("is the", "the", "fi is", "well-known is", "k the", "é é"):
            want = {r.k for r in M.phrase_offsets(every, phrase, "k").collect()}
            assert {r.k for r in M.contains_phrase(df, phrase, "k", "t", camel).collect()} == want and want, phrase


def test_a_refined_search_reads_texts_once_and_cuts_few_into_spans(spark, tmp_path):
    spark.createDataFrame([("a.md", "is the"), ("b.md", "this is the of the"), ("c.txt", "no"), ("d.md", "thesis the"), ("e.md", None)], "path string, content string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    hits = spark.createDataFrame([(p,) for p in ("a.md", "b.md", "c.txt", "d.md", "e.md", "gone.md")], "path string")
    out = M.refine(hits, docs, ["is the"], ["of the"], text_like=("md",))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(r.path for r in out.collect()) == ["a.md", "c.txt"]
    assert sorted(r.path for r in M.refine(hits, docs, [], ["of the"]).collect()) == ["a.md", "c.txt", "d.md", "e.md", "gone.md"]
    assert docs.where(F.regexp_count("content", F.lit(T.chains_of(["is", "the"]))) > 0).count() == 2  # only "is the" and "this is the of the" have one


def test_the_best_window_may_lie_behind_any_number_of_matches(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    far = "thing " + "filler " * 40
    rows = [(1, far * 2500 + "thing, ation"), (2, "thing " * 700 + "x " * 200 + "Thing-ation ation"), (3, "thing ation " * 300), (4, "no"), (5, None), (6, "ation")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.term_offsets(T.span_rows(spark.createDataFrame(rows, "k long, t string"), "k", "t", words=["thing"]), ["thing"], "k").where("k = 1").count() == 2501
    got = QUERIES["q_excerpt_window"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["q_excerpt_window"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert [r.start for r in got.where("doc_id = 1").orderBy("start").collect()] == [2500 * len(far), 2500 * len(far) + 7]


def test_a_window_is_held_against_its_stretch_alone(spark):
    rows = spark.range(40_000).select(F.lit("d").alias("path"), (F.col("id") * 2).cast("int").alias("start"), F.lit(1).alias("length"), F.when(F.col("id") == 39_000, "b").otherwise("a").alias("term"))
    out = M.best_window(rows).agg(F.min("start"), F.max("start"), F.count("*")).first()
    assert tuple(out) == (77_762, 78_000, 120)  # most terms, most matches, first


def test_small_steps_have_one_file_and_are_read_at_once(spark, tmp_path):
    docs = spark.range(100).select(F.concat("id", F.when(F.col("id") % 4 == 0, ".txt").otherwise(".md")).alias("path"))
    dealt = deal_steps(docs, f"file://{tmp_path}/one", 10)
    assert sorted(dealt.select("path").collect()) == sorted(docs.collect())
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "one").glob("__step=*"))
    sizes = {r["__step"]: r["count"] for r in dealt.groupBy("__step").count().collect()}
    assert [n for _, n in in_steps(docs, f"file://{tmp_path}/two", 10)] == [sizes[k] for k in sorted(sizes)]


def test_pending_edits_keep_their_state_without_python(spark, tmp_path):
    spark.range(1).selectExpr("timestamp'2024-01-01' as ts", "id as event_id", "'a' as path", "'modify' as op").write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("ts timestamp, event_id long, path string, op string").parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    plan = pending.pending_edits(feed, 2_000_000)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "session_window" in plan


def test_a_burst_ends_where_the_gap_ends(spark, tmp_path):
    rows = "inline(array(struct(0L, 1L), struct(2000000L, 2L), struct(3999999L, 3L), struct(90000000L, 4L))) as (us, event_id)"
    spark.range(1).selectExpr(rows).selectExpr("timestamp_micros(us) as ts", "event_id", "if(event_id = 4, 'b', 'a') as path", "if(event_id = 4, 'delete', 'modify') as op").write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("ts timestamp, event_id long, path string, op string").parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    with pending.rocks_state(spark):
        query = pending.pending_edits(feed, 2_000_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 4]


def test_edits_in_characters_or_in_bytes(spark):
    terms = spark.createDataFrame([("erenß",), ("erenk",)], "term string")
    for in_bytes, want in ((False, ["erenk", "erenß"]), (True, ["erenk"])):
        weight = expansion_weight(F.col("term"), "ereng", True, Fuzzy(0.2, 4, 3, in_bytes), ScoringConfig())
        assert sorted(r.term for r in terms.where(weight.isNotNull()).collect()) == want
