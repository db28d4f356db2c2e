"""Language identification by fusing evidence in Bayes' rule.

For each document: log prior of its host + log likelihood of its text + log likelihood of the
declared markup language + log likelihood of the address suffix, normalised over the
languages. Text likelihoods are byte trigrams with additive smoothing, from a bounded sample
of labelled rows. How far a declaration or a suffix is to be trusted is counted on all
rows, against the text's own verdict. Host priors are smoothed towards the host's domain,
and those towards the whole table; a row's own verdict is taken out of all three, for it is
its text's evidence already. Counts come from grouped aggregates joined back, so a host
with a third of all rows costs one row of partial sums for each task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, materialise, require, shared_dir, text_bytes

#: Labelled rows for the text model: at most so many of each language, whole texts.
TRAIN_ROWS = 400
#: Labels that may be told apart; a model holds a column for each.
LABELS = 256
#: Buckets of trigrams, additive smoothing, and how many trigrams count as independent at most.
BUCKETS, SMOOTH, EVIDENCE = 1 << 16, 0.5, 200
#: Weight, in rows, of the domain's share in a host's, and of the table's share in a domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0

_MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
# The language a country suffix speaks for.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en"}
# Labels below which a country registers its domains, as in .co.uk.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (BUCKETS, languages) of log probabilities

    def scores(self, raw: bytes) -> np.ndarray:
        """Log likelihood of each language, tempered to ``EVIDENCE`` trigrams."""
        bucket = trigrams(raw)
        if not len(bucket):
            return np.zeros(len(self.languages))
        counts = np.bincount(bucket, minlength=BUCKETS) if len(bucket) > 8 * BUCKETS else None
        total = counts @ self.table if counts is not None else self.table[bucket].sum(axis=0)
        return total * (min(len(bucket), EVIDENCE) / len(bucket))


def trigrams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw.lower(), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Counts over whole texts of at most ``rows`` rows of each language, chosen by the hash of the text; only
    counts of a fixed number of buckets reach the driver. Without labelled rows the one
    language is ``und``; every label is told apart, and more than ``LABELS`` are an error."""
    labels = labelled.select(lang_col).where(F.col(lang_col).isNotNull()).distinct().limit(LABELS + 1).collect()
    if len(labels) > LABELS:
        raise ValueError(f"more than {LABELS} labels in {lang_col}")
    languages = tuple(sorted(r[0] for r in labels)) or ("und",)
    total = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isin(*languages)).select(F.col(lang_col).alias("lang"), text_bytes(text_col).alias("raw"))
    size = {r["lang"]: r["n"] for r in total.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, (rows + 4 * rows**0.5) / n))) for lang, n in size.items()], F.lit(0.0))
    chosen = total.withColumn("nth", F.xxhash64("raw")).where(F.pmod("nth", F.lit(1_000_003)) < share * 1_000_003)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("nth"))  # limited in each task first
    sample = chosen.withColumn("place", place).where(F.col("place") <= rows).select("lang", "raw")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.bincount(trigrams(raw), minlength=BUCKETS)
            out[lang] = out.get(lang, 0) + counts
        flat = [(lang, int(i), int(n)) for lang, counts in out.items() for i, n in zip(np.flatnonzero(counts), counts[counts > 0], strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(("lang", "bucket", "n"), f, strict=True)) for f in flat], schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))

    counts = np.full((BUCKETS, len(languages)), SMOOTH)
    for r in map_arrow(sample, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return TextModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def visible(html: bytes) -> bytes:
    """The text outside tags, comments, scripts and styles."""
    return _MARKUP.sub(b" ", html)


def _score(model, markup: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
    use = model.value
    scores = [use.scores(visible(raw or b"") if markup else raw or b"") for raw in batch.column(0).to_pylist()]
    flat = np.concatenate(scores).astype(np.float64) if scores else np.empty(0)
    ends = np.arange(len(scores) + 1, dtype=np.int32) * len(use.languages)
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*batch.schema.names[1:], "scores"])


def _shares(languages: tuple[str, ...]) -> list:
    return [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]


def identify(docs: DataFrame, model: TextModel, id_col: str, text_col: str, url_col: str | None = None, host_col: str | None = None, markup: bool = False) -> DataFrame:
    """``(id, host, declared, suffix, text_lang, lang, confidence)``, one row per input row.

    ``url_col`` gives host and suffix, or ``host_col`` the host alone; with ``markup`` the text
    is HTML, whose declared language counts and whose tags do not. Missing evidence (null or
    empty text, no declaration, unknown suffix, null host) adds nothing; with none at all the
    table's shares decide; ``text_lang`` is null for a text of fewer than three bytes; ties go to the
    language first in the alphabet. A host's domain is its last
    two labels, or three where the last but one is a registry's. Ids may repeat or
    be null; other columns are not read; an empty table gives an empty table.
    """
    require(docs, *[c for c in (id_col, text_col, url_col, host_col) if c])
    langs = model.languages
    html = F.col(text_col).cast("string")
    address = F.lower(F.col(url_col)) if url_col else F.lit(None).cast("string")
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1) if url_col else F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)) if markup else F.lit("")
    base = docs.select(
        text_bytes(text_col).alias("raw"), F.col(id_col).alias("id"), F.nullif(F.coalesce(host, F.lit("")), F.lit("")).alias("host"),
        F.when(declared.isin(*langs), declared).alias("declared"),
    )
    domain = F.regexp_extract("host", rf"([^.]+\.(?:(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}|[^.]+))$", 1)
    base = base.withColumn("domain", domain).withColumn("suffix", F.regexp_extract("host", r"\.([a-z]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    base = base.withColumn("suffix", F.when(known[F.col("suffix")].isin(*langs), known[F.col("suffix")]))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_arrow(base, partial(_score, spark.sparkContext.broadcast(model), markup), f"id {kind}, host string, declared string, domain string, suffix string, scores array<double>")
    # Written once: the texts are read and scored in one pass, the statistics need scores only.
    root = shared_dir(spark)
    # Log likelihoods of a text are below 0; a text without a trigram says nothing and votes for nothing.
    scored = materialise(scored.withColumn("best", F.expr("if(array_max(scores) < 0, array_position(scores, array_max(scores)) - 1, null)")), f"{root}/scored")
    counted = materialise(scored.groupBy("host", "domain", "declared", "suffix").agg(*_shares(langs)), f"{root}/counted")
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))]
    top = counted.agg(*sums).first()
    n = [float(top[i] or 0) for i in range(len(langs))]

    def trust(column: str) -> float:
        """How often the declaration names what the text says, over all rows that have one."""
        hit = sum((F.when(F.col(column) == lang, F.col(f"n{i}")).otherwise(0) for i, lang in enumerate(langs)), F.lit(0))
        row = counted.where(F.col(column).isNotNull()).agg(F.sum(hit), F.sum(sum((F.col(f"n{i}") for i in range(len(langs))), F.lit(0)))).first()
        return ((row[0] or 0) + 8) / ((row[1] or 0) + 10)

    trusted = {c: trust(c) for c in ("declared", "suffix")}
    counts = F.array(*[F.col(f"n{i}").cast("double") for i in range(len(langs))])
    all_n = sum((F.col(f"n{i}") for i in range(len(langs))), F.lit(0)).cast("double")
    domains = counted.groupBy("domain").agg(*sums).select("domain", counts.alias("domain_n"), all_n.alias("domain_all"))
    hosts = counted.where("host is not null").groupBy("host", "domain").agg(*sums).select("host", "domain", counts.alias("host_n"), all_n.alias("host_all"))
    joined = scored.drop("domain").join(hosts.join(domains, "domain"), "host", "left")

    def prior(i: int):
        """Logarithm of the language's share on the row's host, without the row itself."""
        own, one = F.coalesce((F.col("best") == i).cast("double"), F.lit(0.0)), F.col("best").isNotNull().cast("double")
        table = (n[i] - own + 1) / (sum(n) - one + len(langs))
        of_domain = (F.col("domain_n")[i] - own + DOMAIN_WEIGHT * table) / (F.col("domain_all") - one + DOMAIN_WEIGHT)
        of_host = (F.col("host_n")[i] - own + HOST_WEIGHT * of_domain) / (F.col("host_all") - one + HOST_WEIGHT)
        return F.log(F.when(F.col("host").isNull(), table).otherwise(of_host))

    def said(column: str, i: int):
        right, wrong = trusted[column], (1 - trusted[column]) / max(1, len(langs) - 1)
        return F.when(F.col(column).isNull(), 0.0).when(F.col(column) == langs[i], float(np.log(right))).otherwise(float(np.log(wrong)))

    fused = F.array(*[F.round(prior(i) + F.col("scores")[i] + said("declared", i) + said("suffix", i), 9) for i in range(len(langs))])
    names = F.array(*[F.lit(x) for x in langs])
    best = F.expr("array_max(fused)")
    return joined.withColumn("fused", fused).select(
        "id", "host", "declared", "suffix",
        F.get(names, F.col("best").cast("int")).alias("text_lang"),
        names[(F.array_position("fused", best) - 1).cast("int")].alias("lang"),
        F.round(1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - best)), 6).alias("confidence"),
    )
