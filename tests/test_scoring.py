"""Scoring moves few postings, and scores once."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import search as S
from lexspark.operators.index import build_index
from lexspark.plans.query import Fuzzy, parse_query
from lexspark.queries import turns_as_docs


@pytest.fixture(scope="module")
def index(spark):
    words = ["thing", "things", "is", "island", "the", "then", "other", "gone"]
    text = F.array_join(F.transform(F.array(*map(F.lit, words)), lambda w, i: F.when((F.col("id") + 1) % (i + 2) != 0, w)), " ")
    return build_index(turns_as_docs(spark.range(60).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), text.alias("text")))).persist()


def rows(hits):
    return sorted((r.path, r.score, tuple(r.terms)) for r in hits.collect())


def test_postings_that_answer_no_word_do_not_move(spark, index, monkeypatch):
    wanted, fuzzy = ["thing", "is"], Fuzzy()
    by_name = rows(S.score_terms(index, wanted, fuzzy))
    monkeypatch.setattr(S, "EXPANDED", 1)  # too many to be sought by name
    scored = S.score_terms(index, wanted, fuzzy)
    assert rows(scored) == by_name and by_name
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    postings = plan[plan.index("Join Inner") : plan.index("explode(terms")]
    assert "StartsWith(term" in postings  # tried before the join, which shuffles


@pytest.mark.parametrize("raw", ["thing is the", "is the", "thing the", "gone is xx", "i-s-land the"])
def test_both_passes_are_scored_at_once(spark, index, monkeypatch, raw):
    for limit in (1, 50):
        at_once = S.ranked(index, parse_query(raw), limit)
        plan = at_once._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("explode(terms") == 2  # the hits, and the subquery that counts them
        got = rows(at_once)
        monkeypatch.setattr(S, "_worth_the_same", lambda *_: False)
        assert rows(S.ranked(index, parse_query(raw), limit)) == got and got
        monkeypatch.undo()


def test_a_last_short_word_may_be_worth_less():
    assert S._worth_the_same(["thing", "is", "the"], ["thing", "the"], Fuzzy())
    assert not S._worth_the_same(["thing", "is"], ["thing"], Fuzzy(prefix_min=6))
    assert not S._worth_the_same(["thing", "is"], ["thing", "x"], Fuzzy())
