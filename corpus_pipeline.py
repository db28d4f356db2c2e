"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
Null or empty texts fail the quality rules and go there; repeated rows count as copies and
share an id's fate; null ids pass near-dedup unlinked; columns beside those of ``documents`` are
carried along until the last stage, which names its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm._common import documents, materialise, remove_dirs, shared_dir
from lexspark.llm.bpe import bpe_encode_decode
from lexspark.llm.decontaminate import decontaminate
from lexspark.llm.line_dedup import line_dedup
from lexspark.llm.minhash import near_duplicates
from lexspark.llm.quality import quality_filter

#: Python workers live on from stage to stage, and so does what they remember: less than the
#: codec's own default leaves room for the other stages.
REMEMBERED = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that had no other line."""
    out = line_dedup(docs).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0))
    text = F.col("kept_text")
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_duplicates(docs, width=5, percent=80).where("kept").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe_encode_decode(docs, path, remembered=REMEMBERED)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Line templates and alignments are not expressible in SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next; what a
    stage has read goes when the next one stands. An empty table gives an empty table."""
    root, before = shared_dir(spark), []
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"{root}/{name}")
        remove_dirs(spark, root, *before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
