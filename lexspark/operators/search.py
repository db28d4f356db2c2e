"""Ranked search: exact, prefix and typo-tolerant terms over boosted fields, all terms first,
then any term at a penalty, then exclusions and filters, then the best k.

Scores follow BM25+ with term frequency one (Robertson and Zaragoza 2009; Lv and Zhai 2011):
a term in a field is worth idf * ((k1 + 1) / (k1 * (1 - b + b * len / avg) + 1) + delta); a
query term takes its best expansion in each field, times the field's boost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, py_tokenize
from ..plans.query import Fuzzy, Query, parse_query
from .index import FIELDS, TYPO_LENGTHS, Index, among

#: Expanded terms up to which they are sought by name.
EXPANDED = 5_000
HIT = "path string, score double, terms array<string>"


@dataclass(frozen=True)
class ScoringConfig:
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    prefix_weight: float = 0.5
    fuzzy_weight: float = 0.5
    any_penalty: float = 0.5
    digits: int = 6


def max_edits(term: str, fuzzy: Fuzzy) -> int:
    """Edits a query term may be off, rounded to the nearest whole number."""
    return 0 if len(term) < fuzzy.min_length else math.floor(fuzzy.fuzziness * len(term) + 0.5)


def expansion_weight(term: Column, wanted: str, last: bool, fuzzy: Fuzzy, config: ScoringConfig) -> Column:
    """What an index term is worth for a query term: exact, else prefix, else fuzzy, else null."""
    size, edits = len(wanted), max_edits(wanted, fuzzy)
    weight = F.when(term == wanted, 1.0)
    if size >= fuzzy.prefix_min or (last and size >= 2):
        weight = weight.when(term.startswith(wanted), F.lit(config.prefix_weight) * size / F.length(term))
    if edits:
        bytewise = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") if fuzzy.in_bytes else c
        off = F.levenshtein(bytewise(term), bytewise(F.lit(wanted)), edits)
        close = F.abs(F.length(term) - size) <= edits
        weight = weight.when(close & (off >= 0), F.lit(config.fuzzy_weight) * (1 - off / F.lit(float(size))))
    return weight


def expand(terms: DataFrame, wanted: list[str], fuzzy: Fuzzy, config: ScoringConfig, exact: bool = False) -> DataFrame:
    """``terms(field, term, df)`` that answer a query term: ``+ (q, m)``. One pass over the
    dictionary for all query terms; their number bounds the literals, nothing is joined."""
    if exact:
        return terms.where(F.col("term").isin(wanted)).withColumn("q", F.col("term")).withColumn("m", F.lit(1.0))
    each = [F.struct(F.lit(q).alias("q"), expansion_weight(F.col("term"), q, i == len(wanted) - 1, fuzzy, config).alias("m")) for i, q in enumerate(wanted)]
    return terms.withColumn("e", F.explode(F.filter(F.array(*each), lambda e: e["m"].isNotNull()))).select("field", "term", "df", "e.q", "e.m")


def dictionary_of(index: Index, wanted: list[str], fuzzy: Fuzzy) -> DataFrame:
    """Terms among which all expansions of the wanted ones are: by name, by prefix and, of a store, by one edit, so that a scan
    of the dictionary in its order reads what it has to. A word that may be two edits off, or one in the memory's
    index, asks for the whole dictionary."""
    term, held, names = F.col("term"), F.lit(False), set(wanted)
    for i, word in enumerate(wanted):
        edits = max_edits(word, fuzzy)
        if edits > 1 or edits and (index.find_typos is None or not {len(word) - 1, len(word) + 1} <= set(TYPO_LENGTHS)):
            return index.terms
        if edits:
            found = index.find_typos(word).limit(EXPANDED + 1).collect()
            if len(found) > EXPANDED:
                return index.terms
            names |= {r["term"] for r in found}
        if len(word) >= fuzzy.prefix_min or (i == len(wanted) - 1 and len(word) >= 2):
            held = held | term.startswith(word)
    return index.terms.where(among(term, list(names)) | held)


def _weights(index: Index, wanted: list[str], fuzzy: Fuzzy, config: ScoringConfig) -> tuple[DataFrame, list[str] | None]:
    """``(field, term, q, gain, avg_len)`` of the expanded terms; and the terms, if they are few. Few
    ones come to the driver, so that the scan of the postings can look for them by name; the
    rest of the world, such as a prefix of one letter over a large dictionary, stays a join."""
    found = expand(dictionary_of(index, wanted, fuzzy), wanted, fuzzy, config).join(F.broadcast(index.stats), "field")  # stats: one row a field
    found = found.select("field", "term", "q", (F.log((F.col("n") + 1) / F.col("df")) * F.col("m")).alias("gain"), "avg_len")
    rows = found.limit(EXPANDED + 1).collect()
    if len(rows) > EXPANDED:
        return found, None
    held = index.fields.sparkSession.createDataFrame(rows, "field string, term string, q string, gain double, avg_len double")
    return F.broadcast(held), sorted({r["term"] for r in rows})


def _answers(term: Column, wanted: list[str], fuzzy: Fuzzy, config: ScoringConfig) -> Column:
    """Whether an index term is an expansion of a wanted one."""
    out = F.lit(False)
    for i, q in enumerate(wanted):
        out = out | expansion_weight(term, q, i == len(wanted) - 1, fuzzy, config).isNotNull()
    return out


def score_terms(index: Index, wanted: list[str], fuzzy: Fuzzy, config: ScoringConfig = ScoringConfig(), part: list[str] | None = None) -> DataFrame:
    """``(path, score, matched, terms)`` of every document that holds an expansion of a term; with ``part``, some of the terms,
    the same over these alone as ``part_score``, ``part_matched``, ``part_terms``.

    Only expanded terms meet the postings, which a store keeps in order of terms; where they are too many to be sought by name,
    postings are tried against the wanted terms before any of them moves. Products are
    per posting; one exchange by path serves the maximum over expansions and the sum over fields and terms.
    """
    weights, names = _weights(index, wanted, fuzzy, config)
    postings = index.postings.where(_answers(F.col("term"), wanted, fuzzy, config)) if names is None else index.postings_of(names)
    hits = postings.join(weights, ["field", "term"])
    norm = config.k1 * (1 - config.b + config.b * F.col("len") / F.col("avg_len")) + 1
    boost = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])[F.col("field")]
    hits = hits.select("path", "q", "field", "term", (boost * F.col("gain") * ((config.k1 + 1) / norm + config.delta)).alias("s"))
    best = hits.repartition("path").groupBy("path", "q", "field").agg(F.max("s").alias("s"), F.collect_set("term").alias("t"))
    spelled = lambda *held: F.sort_array(F.array_distinct(F.flatten(F.concat(*[F.collect_list(t) for t in held]))))
    if part is None:
        return best.groupBy("path").agg(F.sum("s").alias("score"), F.size(F.collect_set("q")).alias("matched"), spelled(F.col("t")).alias("terms"))
    of_part = lambda c: F.when(F.col("q").isin(part), F.col(c))
    rest = F.when(~F.col("q").isin(part), F.col("t"))
    own = [F.sum(of_part("s")).alias("part_score"), F.size(F.collect_set(of_part("q"))).alias("part_matched"), spelled(of_part("t")).alias("part_terms")]
    return best.groupBy("path").agg(F.sum("s").alias("score"), F.size(F.collect_set("q")).alias("matched"), spelled(of_part("t"), rest).alias("terms"), *own)


def exclude_terms(hits: DataFrame, index: Index, words: list[str]) -> DataFrame:
    """Without documents that hold one of the words, exactly, in any field."""
    gone = [t for w in words for t in py_tokenize(w, index.camel)]
    if not gone:
        return hits
    return hits.join(index.postings_of(gone).select("path").distinct(), "path", "left_anti")


def filter_paths(hits: DataFrame, query: Query) -> DataFrame:
    low = F.lower(F.col("path"))
    if query.ext:
        hits = hits.where(extension(F.col("path")).isin(query.ext))
    if query.paths:
        some = F.lit(False)
        for p in query.paths:
            some = some | low.contains(p)
        hits = hits.where(some)
    for p in query.excluded_paths:
        hits = hits.where(~low.contains(p))
    return hits


def _worth_the_same(wanted: list[str], again: list[str], fuzzy: Fuzzy) -> bool:
    """Whether each term of ``again`` is one of ``wanted`` and has the same expansions there: only the last term may be the
    beginning of others at fewer than ``prefix_min`` characters."""
    lasts = {wanted[-1], again[-1]} if again else set()
    return set(again) <= set(wanted) and (len(lasts) == 1 or all(len(t) >= fuzzy.prefix_min or len(t) < 2 for t in lasts))


def ranked(index: Index, query: Query, limit: int = 50, fuzzy: Fuzzy = Fuzzy(), config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """All hits before the limit: documents with every term and, if those are fewer than
    ``limit`` before any filter, documents with some term of three characters or more. Whether
    they are is a subquery of the same plan."""
    spark = index.fields.sparkSession
    wanted = py_tokenize(query.text, index.camel) if query.text else []
    if not wanted:
        return spark.createDataFrame([], HIT)
    every = F.col("matched") == len(wanted)
    some = [t for t in wanted if len(t) >= 3]
    again = py_tokenize(" ".join(some), index.camel)
    together = some and again != wanted and _worth_the_same(wanted, again, fuzzy)  # else one that is scored anew, or nothing more
    scored = score_terms(index, wanted, fuzzy, config, again if together else None)
    full = scored.where(every)
    rounded = lambda c: F.round(c, config.digits).alias("score")
    if not some:
        hits = full.select("path", rounded(F.col("score")), "terms")
    else:
        # asks for all columns, so that its plan is that of the hits and what it has exchanged serves both
        held = "score is not null and size(terms) > 0" + (" and (part_score is null or part_matched >= 0 and size(part_terms) >= 0)" if together else "")
        few = full.where(held).limit(limit).agg(F.count("*").alias("n")).scalar() < limit
        penalised = lambda score, matched: F.col(score) * F.lit(config.any_penalty) * F.col(matched) / len(some)
        if again == wanted:  # one scoring serves both passes
            hits = scored.where(every | few).select("path", rounded(F.when(every, F.col("score")).otherwise(penalised("score", "matched"))), "terms")
        elif together:
            shown = F.when(every, F.col("terms")).otherwise(F.col("part_terms")).alias("terms")
            score = rounded(F.when(every, F.col("score")).otherwise(penalised("part_score", "part_matched")))
            hits = scored.where(every | few & (F.col("part_matched") > 0)).select("path", score, shown)
        else:
            part = score_terms(index, again, fuzzy, config).where(few).join(full.select("path"), "path", "left_anti")
            hits = full.select("path", rounded(F.col("score")), "terms").unionByName(part.select("path", rounded(penalised("score", "matched")), "terms"))
    return filter_paths(exclude_terms(hits, index, query.excluded_terms), query)


def top_k(hits: DataFrame, limit: int) -> DataFrame:
    """Best first; the path settles ties."""
    return hits.orderBy(F.desc("score"), "path").limit(limit)


def search(index: Index, raw: str | Query, limit: int = 50, fuzzy: Fuzzy = Fuzzy(), config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """``(path, score, terms)`` of the best ``limit`` documents for a query string."""
    query = parse_query(raw) if isinstance(raw, str) else raw
    return top_k(ranked(index, query, limit, fuzzy, config), limit)


def latest_requests(requests: DataFrame) -> DataFrame:
    """Of each session's requests ``(session, search_id, query)`` the newest; older ones are stale."""
    return requests.groupBy("session").agg(F.max("search_id").alias("search_id"), F.max_by("query", "search_id").alias("query"))


def clamp_selection(selected: Column, count: Column) -> Column:
    """A list position moved into the list."""
    return F.greatest(F.lit(0), F.least(selected, count - 1))
