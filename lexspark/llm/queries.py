"""One registered query for each operator, over its whole table, and the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, shared_dir
from .bpe import bpe_round_trip
from .change_points import change_points
from .decontaminate import benchmark_matches
from .language_id import identify, train
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .parity_join import jaccard_join
from .pii import find_pii
from .quality import quality_report
from .secrets import find_secrets
from .substring_dedup import substring_dedup
from .token_alignment import align_tokens
from .token_files import token_checksums, write_tokens


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (their source stands for a host) and all pages (all four kinds of evidence)."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = train(docs)
    columns = ["declared", "suffix", "text_lang", "lang", "confidence"]
    none = F.lit(None).cast("long")
    texts = identify(docs, model, "doc_id", "text", host_col="source").select(F.col("id").alias("doc_id"), none.alias("page_id"), "host", *columns)
    web = identify(pages, model, "page_id", "html", url_col="url", markup=True).select(none.alias("doc_id"), F.col("id").alias("page_id"), "host", *columns)
    return texts.unionByName(web)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir).select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    scores = F.array_join(F.transform("found", lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select("*", scores.alias("scores")).drop("found")


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir).select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_matches(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs, width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = write_tokens(docs, f"{shared_dir(spark)}/tokens", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_checksums(spark, out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_text")


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the kept quantities that each vendor shipped a day."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("flag = 'kept'")
    return change_points(lines, "vendor_id", "shipped_at", "quantity")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard_join(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_pii": op4_pii,
    "op5_quality_cascade": op5_quality_cascade,
    "op6_bpe": op6_bpe,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_change_points": op11_change_points,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _linked_sql(width: int, percent: int, kept: str = "") -> str:
    """Documents linked by the similarity of their shingle sets, and the least id that each reaches."""
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= {percent} * (p.n + q.n - common)
), both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other
), comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id{kept}
FROM documents d JOIN comps c ON c.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


OP2_SQL = _linked_sql(4, 80, ", d.doc_id = c.component_id AS kept")
OP13_SQL = _linked_sql(3, 90)

OP5_SQL = rf"""
WITH base AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents
), lines AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base
), line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS s, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS seq
  FROM base WHERE len(w) >= 5
), twice AS MATERIALIZED (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 5)) FROM twice) GROUP BY doc_id
), facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
    len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted
  FROM base LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeats USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_stutters > 30 * n_words
    OR 100 * n_shouted > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM judged
"""

OP8_SQL = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS seq
  FROM words WHERE len(w) >= 20
), later AS MATERIALIZED (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)) AS k
  FROM words LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

OP11_SQL = """
WITH RECURSIVE daily AS MATERIALIZED (
  SELECT vendor_id, shipped_at::DATE - DATE '1970-01-01' AS d, sum(quantity)::BIGINT AS q
  FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2
), days AS MATERIALIZED (
  SELECT s.vendor_id, s.d, coalesce(daily.q, 0) AS q
  FROM (SELECT vendor_id, unnest(range(min(d), max(d) + 1)) AS d FROM daily GROUP BY vendor_id) s
  LEFT JOIN daily ON daily.vendor_id IS NOT DISTINCT FROM s.vendor_id AND daily.d = s.d
), sums AS (
  SELECT vendor_id, d, sum(q) OVER w AS s, sum(q * q) OVER w AS ss FROM days WINDOW w AS (PARTITION BY vendor_id ORDER BY d)
), series AS MATERIALIZED (
  SELECT vendor_id, min(d) AS first, count(*)::BIGINT AS n, list_prepend(0::BIGINT, list(s::BIGINT ORDER BY d)) AS p, list_prepend(0::BIGINT, list(ss::BIGINT ORDER BY d)) AS pp
  FROM sums GROUP BY vendor_id
), dp AS (
  SELECT vendor_id, n, p, pp, least(7, n) - 1 AS e,
    list_transform(range(0, least(7, n)), lambda i: CASE WHEN i = 0 THEN {'t': -20000::BIGINT, 'c': 0::BIGINT, 's': 0::BIGINT} END) AS best
  FROM series
  UNION ALL
  SELECT vendor_id, n, p, pp, e + 1, list_append(best, list_min(list_transform(
    list_filter(range(0, e + 2 - least(7, n)), lambda a: a = 0 OR a >= 7),
    lambda a: {'t': best[a + 1].t + 20000 + (e + 1 - a) * floor(1000 * ln(1 + ((e + 1 - a) * (pp[e + 2] - pp[a + 1]) - (p[e + 2] - p[a + 1]) * (p[e + 2] - p[a + 1])) // ((e + 1 - a) * (e + 1 - a))))::BIGINT,
      'c': best[a + 1].c + 1, 's': a})))
  FROM dp WHERE e < n
), cut AS (
  SELECT vendor_id, best, best[n + 1].s AS a, n AS e FROM dp WHERE e = n
  UNION ALL
  SELECT vendor_id, best, best[a + 1].s, a FROM cut WHERE a > 0
), parts AS (
  SELECT cut.vendor_id, first, a, e - a AS n, p[e + 1] - p[a + 1] AS total, pp[e + 1] - pp[a + 1] AS square, best[series.n + 1].c AS parts, best[series.n + 1].t AS t
  FROM cut JOIN series ON series.vendor_id IS NOT DISTINCT FROM cut.vendor_id
)
SELECT vendor_id, (row_number() OVER (PARTITION BY vendor_id ORDER BY a))::INTEGER AS segment_no, (first + a)::BIGINT AS first_day, n::BIGINT AS n_days, total,
  1 + (n * square - total * total) // (n * n) AS spread, n * floor(1000 * ln(1 + (n * square - total * total) // (n * n)))::BIGINT AS cost, parts AS n_segments, t AS best_cost
FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": OP2_SQL,
    "op5_quality_cascade": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_change_points": OP11_SQL,
    "op13_ngram_jaccard_join": OP13_SQL,
}
