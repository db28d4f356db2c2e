"""The index as tables: build, upsert, remove, and the manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.docs import canvas_text

# Fields that are indexed, and what a match in each is worth.
FIELDS = {"basename": 3.0, "aliases": 3.0, "tags": 2.0, "headings1": 1.8, "directory": 1.5, "headings2": 1.4, "headings3": 1.2, "content": 1.0}


@dataclass(frozen=True)
class Index:
    """``fields(path, field, terms, len)``, the distinct terms of each field, and ``manifest(path, mtime)``.

    What else a search reads follows from these: ``postings(path, field, term, len)``, which carry
    their field's length so that scoring joins nothing but the few expanded terms,
    ``terms(field, term, df)`` and ``stats(field, n, avg_len)``; a store or :meth:`persist` holds them ready.
    """

    fields: DataFrame
    manifest: DataFrame
    camel: bool = False
    held_postings: DataFrame | None = None
    held_terms: DataFrame | None = None
    held_stats: DataFrame | None = None
    #: Of a store: the postings of some terms from the files that may hold them, and the terms that are one edit
    #: or none away from a word.
    find_postings: Callable[[list[str]], DataFrame] | None = None
    find_typos: Callable[[str], DataFrame] | None = None

    @property
    def postings(self) -> DataFrame:
        if self.held_postings is not None:
            return self.held_postings
        return self.fields.select("path", "field", F.explode("terms").alias("term"), "len")

    def postings_of(self, names: list[str]) -> DataFrame:
        """A store looks into the files that may hold the terms; of other indexes each posting is tried against a set."""
        return self.find_postings(names) if self.find_postings else self.postings.where(F.col("term").isin(names))

    @property
    def lengths(self) -> DataFrame:
        return self.fields.select("path", "field", "len").where("len > 0")

    @property
    def terms(self) -> DataFrame:
        if self.held_terms is not None:
            return self.held_terms
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))

    @property
    def stats(self) -> DataFrame:
        """Averages run over all documents, whether or not they have the field."""
        if self.held_stats is not None:
            return self.held_stats
        n = self.manifest.agg(F.count("*").alias("n"))
        fields = self.lengths.groupBy("field").agg(F.sum("len").alias("total"))
        return fields.join(F.broadcast(n)).select("field", "n", (F.col("total") / F.col("n")).alias("avg_len"))

    def persist(self) -> Index:
        """Kept by the executors, with the dictionary and the averages, for many searches: texts are
        tokenised once."""
        held = self if self.held_postings is not None else replace(self, fields=self.fields.persist())
        return replace(held, held_terms=held.terms.persist(), held_stats=held.stats.persist())

    def unpersist(self) -> None:
        for table in (self.held_stats, self.held_terms, self.fields):
            if table is not None:
                table.unpersist()


def among(column: Column, values: list[str]) -> Column:
    """``column`` is one of ``values``. Up to ``BY_TENS`` of them are asked for by tens of neighbours, for a Parquet scan takes a
    longer list as one range from its least to its greatest value; more are one list, which runs as a set."""
    held, out = sorted(set(values)), F.lit(False)
    if len(held) > BY_TENS:
        return column.isin(held)
    for k in range(0, len(held), 10):
        out = out | column.isin(held[k : k + 10])
    return out


#: Values that a filter names by tens.
BY_TENS = 200
#: Lengths of terms that are kept by their halves, so that those one edit away are found by name.
TYPO_LENGTHS = range(3, 33)


def one_off(word: str) -> list[str]:
    """The forms of all terms that may be one edit away from ``word``. An edit falls into one half of a term
    and leaves the other: the word begins with the first half, or it ends with the second one."""
    sizes = range(len(word) - 1, len(word) + 2)
    return [f for n in sizes for f in (f"{n}<{word[: n // 2]}", f"{n}>{word[len(word) - (n - n // 2) :]}")]


def typo_forms(terms: DataFrame) -> DataFrame:
    """``(form, term)``: the length of every term of ``TYPO_LENGTHS`` with its first and with its second half."""
    term, size = F.col("term"), F.length("term")
    half = F.floor(size / 2).cast("int")
    halves = F.array(F.concat(size, F.lit("<"), F.substring(term, F.lit(1), half)), F.concat(size, F.lit(">"), F.substring(term, half + 1, size)))
    return terms.where(size.between(TYPO_LENGTHS[0], TYPO_LENGTHS[-1])).select(F.explode(halves).alias("form"), "term")


def field_terms(docs: DataFrame, camel: bool = False) -> DataFrame:
    """``(path, field, terms, len)``: the distinct terms of each field of each document. Everything
    happens within a row: no shuffle, however large the collection."""
    content = F.when(F.col("kind") == "canvas", canvas_text(F.col("content"))).otherwise(F.col("content"))
    held = docs.withColumn("content", content)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS]))
    rows = held.select("path", each.alias("f")).where("f.text is not null and f.text <> ''")
    return rows.select("path", "f.field", tokenize(F.col("f.text"), camel).alias("terms")).withColumn("len", F.size("terms"))


def build_index(docs: DataFrame, camel: bool = False) -> Index:
    """``docs`` must hold one row for each path. A plan over ``docs`` until it is persisted or saved."""
    return Index(field_terms(docs, camel), docs.select("path", "mtime"), camel)


def remove(index: Index, paths: DataFrame) -> Index:
    """Without the documents of ``paths(path)``; unknown ones are ignored."""
    gone = paths.select("path").distinct()
    drop = lambda df: df.join(gone, "path", "left_anti")
    return Index(drop(index.fields), drop(index.manifest), index.camel, drop(index.held_postings) if index.held_postings is not None else None)


def upsert(index: Index, docs: DataFrame) -> Index:
    """``docs`` replace what the index holds under their paths."""
    rest, new = remove(index, docs), build_index(docs, index.camel)
    postings = rest.held_postings.unionByName(new.postings) if rest.held_postings is not None else None
    return Index(rest.fields.unionByName(new.fields), rest.manifest.unionByName(new.manifest), index.camel, postings)


def manifest_diff(known: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, action)``: add, update, remove or keep. Any other time of change updates, an
    older one too."""
    k, c = known.select("path", F.col("mtime").alias("old")), current.select("path", F.col("mtime").alias("new"))
    both = k.withColumn("known", F.lit(True)).join(c.withColumn("now", F.lit(True)), "path", "full_outer")
    action = F.when(F.col("known").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return both.select("path", action.alias("action"))


def sync(index: Index, docs: DataFrame) -> Index:
    """The index after bringing it in step with ``docs``: only changed documents are tokenised."""
    diff = manifest_diff(index.manifest, docs)
    stale = remove(index, diff.where(F.col("action").isin("remove", "update")))
    return upsert(stale, docs.join(diff.where(F.col("action").isin("add", "update")).select("path"), "path", "left_semi"))
