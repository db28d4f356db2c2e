"""A first build as a stream: the source is read once, some files at a time, and can be gone on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.store import IndexStore
from ..plans.query import Settings
from ..sources.docs import other_kinds, stream_files


class BuildProgress(StreamingQueryListener):
    """Adds up the rows that the batches of one query have read, and tells ``told(done)`` of each."""

    def __init__(self, told: Callable[[int], None] | None = None) -> None:
        self.rows, self.batches, self.told, self.run = 0, set(), told, None
        self.held: list = []

    def watch(self, query: StreamingQuery) -> None:
        """Events may come before the query is known here: they are kept until then."""
        self.run = str(query.runId)
        held, self.held = self.held, []
        for progress in held:
            self._add(progress)

    def _add(self, progress) -> None:
        if str(progress.runId) != self.run or progress.batchId in self.batches:
            return
        self.batches.add(progress.batchId)
        self.rows += sum(s.numInputRows for s in progress.sources)
        if self.told and progress.numInputRows:
            self.told(self.rows)

    def onQueryProgress(self, event) -> None:
        if self.run is None:
            self.held.append(event.progress)
        else:
            self._add(event.progress)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def index_stream(docs: DataFrame, store: IndexStore, settings: Settings, checkpoint: str, progress: Callable[[int], None] | None = None) -> int:
    """Add the documents of a bounded stream to a saved index, one part a batch, and give the rows read.

    ``docs`` is a stream with the columns of documents, of which ``maxFilesPerTrigger`` and the like bound a batch; everything that
    is there at the start is taken. After a failure the same checkpoint goes on with the batch that failed, which
    may come twice and then replaces itself. ``progress`` gets the rows read so far after each batch.
    """
    spark: SparkSession = docs.sparkSession
    none = spark.createDataFrame([], "path string")
    listener = BuildProgress(progress)
    spark.streams.addListener(listener)
    try:

        def add(batch: DataFrame, batch_id: int) -> None:
            # terms, the manifest and replaced paths are made from what one pass has read
            with store.staged(batch) as held:
                store.apply(none, held, settings)

        query = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        listener.watch(query)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return listener.rows


def index_files(
    spark: SparkSession, root: str, store: IndexStore, settings: Settings, checkpoint: str, files_per_batch: int = 1000, progress: Callable[[int], None] | None = None, **options
) -> int:
    """Index the files below ``root``, notes before other kinds, each read once; gives how many were read.
    ``options`` are those of :func:`..sources.docs.stream_files`. A checkpoint for each kind lies below ``checkpoint``."""
    done = 0
    for name, kinds in (("notes", ["md"]), ("others", other_kinds(settings, options.get("extract") is not None))):
        files = stream_files(spark, root, settings, kinds=kinds, files_per_batch=files_per_batch, **options)
        before = done
        done += index_stream(files, store, settings, f"{checkpoint.rstrip('/')}/{name}", (lambda n: progress(before + n)) if progress else None)
    return done
