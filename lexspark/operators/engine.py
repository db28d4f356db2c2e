"""The engine in one object: index, search, refine, excerpts, and keeping in step."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, py_tokenize, significant_for_query
from ..plans.query import Settings, parse_query
from .index import Index, build_index, manifest_diff, remove, sync, upsert
from .match import TEXT_LIKE, excerpts, highlight_titles, jump_targets, refine, search_lines
from .search import ranked, top_k
from .store import IndexStore

#: Documents of one step of :meth:`SearchEngine.populate`.
STEP = 100_000
#: Files of one step, at most, and rows of one of them, at least.
FILES, FILE_ROWS = 8, 5_000


def deal_steps(docs: DataFrame, root: str, step: int = STEP) -> DataFrame | None:
    """``docs`` with ``__step``, dealt into parts of about ``step`` rows, notes (``.md``) before other kinds; None without any.

    They are read once, however many steps there are: one pass writes them to the folder ``root``, dealt by kind and
    by a hash of the path. How many steps a kind needs is counted from paths alone."""
    note = extension(F.col("path")) == "md"
    spark, counts = docs.sparkSession, dict(docs.groupBy(note.alias("note")).count().collect())
    notes, others = (-(-counts.get(kind, 0) // step) for kind in (True, False))
    if not notes + others:
        return None
    slot = lambda n: F.pmod(F.xxhash64("path"), F.lit(max(n, 1)))
    dealt = docs.withColumn("__step", F.when(note, slot(notes)).otherwise(notes + slot(others)))
    # a step's rows meet in a few files, not in one of every task
    files = min(FILES, -(-step // FILE_ROWS))
    dealt = dealt.repartition(F.col("__step"), F.pmod(F.xxhash64("path", F.lit(1)), F.lit(files)))
    dealt.write.partitionBy("__step").parquet(root)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, __step long").parquet(root)


def in_steps(docs: DataFrame, root: str, step: int = STEP) -> Iterator[tuple[DataFrame, int]]:
    """The steps of :func:`deal_steps` one after the other, with their sizes; each reads its own files."""
    dealt = deal_steps(docs, root, step)
    if dealt is None:
        return
    sizes = dict(dealt.groupBy("__step").count().collect())
    for k in sorted(sizes):
        yield docs.sparkSession.read.schema(docs.schema).parquet(f"{root}/__step={k}"), sizes[k]


class SearchEngine:
    """Reads see a whole index at a time: mutations replace it, and ``persist`` commits it.

    ``docs`` are the documents, or a function that gives the current ones, which :meth:`sync` asks."""

    def __init__(self, spark: SparkSession, docs: DataFrame | Callable[[], DataFrame], settings: Settings = Settings(), store: str | None = None) -> None:
        self.spark, self.settings, self.store_path = spark, settings, store
        self._current = docs if callable(docs) else None
        self.docs = docs() if callable(docs) else docs
        self.index: Index | None = None
        self._open()

    def _open(self) -> None:
        self.store = IndexStore(self.spark, self.store_path) if self.store_path and self.settings.use_cache else None
        self._version = self.store.version() if self.store else 0
        saved = self.store.load(self.settings) if self.store else None
        if saved:
            self._take(saved, saved=True)
            self._bring()
        else:
            self._take(build_index(self.docs, self.settings.split_camel_case))

    def _take(self, index: Index, saved: bool = False) -> None:
        """Kept by the executors for many searches; the one before is let go when this one is there.
        ``saved``: it is the store's newest snapshot."""
        before, self.index, self._saved = self.index, index.persist(), saved
        if before is not None:
            self.index.fields.count()
            before.unpersist()

    def _reload(self) -> None:
        """Go on from the store's newest snapshot, if it has one."""
        self._version = self.store.version()
        if saved := self.store.load(self.settings):
            self._take(saved, saved=True)

    def add(self, docs: DataFrame) -> None:
        self._take(upsert(self.index, docs))
        self.docs = self.docs.join(docs.select("path"), "path", "left_anti").unionByName(docs)

    def remove(self, paths: list[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._take(remove(self.index, gone))
        self.docs = self.docs.join(gone, "path", "left_anti")

    def sync(self) -> tuple[int, int]:
        """Read your writes: the index is brought in step with the current documents, by path and time
        of change. Costs a comparison of manifests if nothing changed. Gives how many documents came
        or changed, and how many went."""
        if self._current is not None:
            self.docs = self._current()
        return self._bring()

    def _bring(self) -> tuple[int, int]:
        """Changes go to the store as a part where the engine stands on its newest snapshot."""
        diff = manifest_diff(self.index.manifest, self.docs).persist()
        n = dict(diff.groupBy("action").count().collect())
        came, went = n.get("add", 0) + n.get("update", 0), n.get("remove", 0)
        if (came or went) and self._saved:
            new = self.docs.join(diff.where(F.col("action").isin("add", "update")).select("path"), "path", "left_semi")
            self.store.apply(diff.where("action = 'remove'").select("path"), new, self.settings)
            self._reload()
        elif came or went:
            self._take(sync(self.index, self.docs))
        diff.unpersist()
        return came, went

    def populate(self, progress: Callable[[int, int], None] | None = None, step: int = STEP) -> None:
        """What the saved index lacks, written to the store step by step, notes first, so that they can be
        searched before the rest is there. ``progress(done, total)`` is called after each step."""
        if self.store is None:
            raise ValueError("populate writes to a store")
        held = self.store.load(self.settings)
        known = held.manifest if held else self.spark.createDataFrame([], "path string, mtime long")
        diff = manifest_diff(known, self.docs)
        gone = diff.where("action = 'remove'").select("path")
        new = self.docs.join(diff.where(F.col("action").isin("add", "update")).select("path"), "path", "left_semi")
        total, done = diff.where(F.col("action").isin("add", "update")).count(), 0
        if held and gone.limit(1).count():
            self.store.apply(gone, self.docs.limit(0), self.settings)
        staged = f"{self.store_path.rstrip('/')}/staged-{uuid.uuid4().hex}"
        try:
            for part, n in in_steps(new, staged, step):
                self.store.apply(gone.limit(0), part, self.settings)
                done += n
                if progress:
                    progress(done, total)
        finally:
            self.store.remove(staged)
        self._reload()

    def persist(self) -> None:
        """Commit, and go on from what was saved: plans of earlier mutations end here. Raises
        :class:`.store.StoreMoved` if another writer has changed the store meanwhile; :meth:`restart` then starts from there."""
        if self.store:
            self.store.save(self.index, self.settings, self._version)
            self._reload()

    def restart(self, settings: Settings | None = None) -> None:
        """Start again with other settings; what was not persisted is indexed from the documents."""
        self.settings = settings or self.settings
        self._open()

    def rebuild(self) -> None:
        """Clear the store and index all documents."""
        if self.store:
            self.store.clear()
            self._version = 0
        self._take(build_index(self.docs, self.settings.split_camel_case))
        self.persist()

    def close(self) -> None:
        if self.index is not None:
            self.index.unpersist()

    def manifest(self) -> DataFrame:
        return self.index.manifest

    def search(self, raw: str, limit: int | None = None, refine_first: bool = True, sync: bool = False) -> DataFrame:
        """Best hits. Phrases are verified before the limit, so that a page is full if it can be;
        ``refine_first=False`` takes the page first and drops from it; ``sync`` first looks for changes."""
        if sync:
            self.sync()
        query, limit = parse_query(raw), limit or self.settings.limit
        hits = ranked(self.index, query, limit, self.settings.fuzzy)
        if not refine_first:
            hits = top_k(hits, limit)
        hits = refine(hits, self.docs, query.phrases, query.excluded_phrases, self.settings.split_camel_case, self._text_like(), page=not refine_first)
        return top_k(hits, limit)

    def _text_like(self) -> tuple[str, ...]:
        return (*TEXT_LIKE, *self.settings.extra_file_types)

    def _shown(self, raw: str, hits: DataFrame) -> DataFrame:
        """``(path, terms)``: of each hit the terms that answer a significant word of the query; paths
        without terms get the query's own."""
        fuzzy, wanted = self.settings.fuzzy, py_tokenize(raw, self.settings.split_camel_case)
        words = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
        if "terms" not in hits.columns:
            hits = hits.withColumn("terms", words)
        return hits.select("path", significant_for_query(F.col("terms"), words, fuzzy.fuzziness, fuzzy.min_length).alias("terms"))

    def _page(self, hits: DataFrame) -> DataFrame:
        """Documents of the hits that have text of their own."""
        held = self.docs.join(hits.select("path"), "path", "left_semi")
        return held.where(extension(F.col("path")).isin(*self._text_like()))

    def excerpts(self, raw: str, hits: DataFrame) -> DataFrame:
        """``(path, excerpt)`` of the given hits only, marked where their terms stand: other texts are not read."""
        return excerpts(self._page(hits), parse_query(raw).text, self._shown(raw, hits), camel=self.settings.split_camel_case)

    def titles(self, raw: str, hits: DataFrame) -> DataFrame:
        """``(path, title)``: names of the hits with their terms marked."""
        held = self.docs.join(hits.select("path"), "path", "left_semi")
        return highlight_titles(held, self._shown(raw, hits), camel=self.settings.split_camel_case)

    def jumps(self, raw: str, hits: DataFrame) -> DataFrame:
        """``(path, start, length, line)``: where to open each hit."""
        return jump_targets(self._page(hits), parse_query(raw).text, self._shown(raw, hits), camel=self.settings.split_camel_case)

    def lines(self, path: str, raw: str) -> DataFrame:
        return search_lines(self.docs.where(F.col("path") == path), raw, camel=self.settings.split_camel_case)
