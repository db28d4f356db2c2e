"""Change feeds: events to row changes, debounce, and upkeep of a saved index.

Events are ``(ts, path, op[, new_path])`` with op create, modify, delete or rename.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_index
from ..operators.store import IndexStore
from ..plans.query import Settings
from ..sources.docs import indexable
from .pending import pending_edits, rocks_state

DEBOUNCE = "2 seconds"


def row_changes(events: DataFrame) -> DataFrame:
    """Renames become a delete of the old path and a create of the new one; unknown ops go."""
    moved = F.array(
        F.struct(F.col("path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("new_path").alias("path"), F.lit("create").alias("op"))
    )
    own = F.array(F.struct(F.col("path").alias("path"), F.col("op").alias("op")))
    rows = events.withColumn("c", F.explode(F.when(F.col("op") == "rename", moved).otherwise(own)))
    # asked of what came out, so that on a stream events with other ops still reach the watermark
    return rows.where("c.path is not null and c.op in ('create', 'modify', 'delete')").drop("path", "op", "new_path").select("*", "c.path", "c.op").drop("c")


def latest_changes(changes: DataFrame, tie: str = "event_id") -> DataFrame:
    """The last change of each path: one aggregate row a path, combined before the shuffle."""
    last = F.max_by(F.struct("op", "ts", tie), F.struct("ts", tie)).alias("last")
    return changes.groupBy("path").agg(last).select("path", "last.op", "last.ts", f"last.{tie}")


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """One row for each burst of events of a key: it ends ``gap`` after its last one. On a stream
    the watermark closes bursts and bounds the state."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    burst = events.groupBy(F.session_window(ts, gap).alias("w"), key)
    return burst.agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("first"), "last", "n")


def settled_edits(changes: DataFrame, gap: str = DEBOUNCE, tie: str = "event_id") -> DataFrame:
    """Edits that survive: the last of its burst, and not followed within ``gap`` by a delete,
    which cancels it."""
    order = Window.partitionBy("path").orderBy("ts", tie)
    nxt = changes.withColumn("__ts", F.lead("ts").over(order))
    quiet = F.col("__ts").isNull() | (F.col("__ts") >= F.col("ts") + F.expr(f"interval {gap}"))
    return nxt.where((F.col("op") != "modify") | quiet).drop("__ts")


def settled_requests(requests: DataFrame, gap: str = "80 milliseconds", session: str = "session", order: str = "search_id") -> DataFrame:
    """Requests ``(session, search_id, ts, ...)`` that no other of their session follows within ``gap``: what a
    reader who is still typing has asked is not run."""
    nxt = F.lead("ts").over(Window.partitionBy(session).orderBy("ts", order))
    return requests.withColumn("__next", nxt).where(F.col("__next").isNull() | (F.col("__next") >= F.col("ts") + F.expr(f"interval {gap}"))).drop("__next")


def due_changes(events: DataFrame, settings: Settings, filters: list[str] | None = None, gap: str = DEBOUNCE, tie: str = "event_id") -> DataFrame:
    """What a batch of events asks of an index: ``(path, op, ts)``, one row a path. Only indexable paths are
    created or modified; of a burst of edits the last counts, and a delete cancels it."""
    rows = row_changes(events).where((F.col("op") == "delete") | indexable(F.col("path"), settings, filters))
    return latest_changes(settled_edits(rows, gap, tie), tie)


def due_stream(feed: DataFrame, settings: Settings, filters: list[str] | None = None, gap: str = DEBOUNCE, late: str = "0 seconds", tie: str = "event_id") -> DataFrame:
    """The same of a stream of events, whatever batches they come in: ``(path, op, ts, <tie>)``, edits once they are settled.
    A query of it must start within :class:`.pending.rocks_state`.

    The watermark follows the newest event less ``late``, of any path and any op; the last edits of a feed that falls
    silent wait for the next event. Events with an op that is none, such as a tick of a clock, move it and do nothing else."""
    seen = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = row_changes(seen).where((F.col("op") == "delete") | indexable(F.col("path"), settings, filters))
    return pending_edits(rows, interval_us(gap), tie)


def interval_us(text: str) -> int:
    """An interval such as ``2 seconds`` in microseconds."""
    number, unit = text.split()
    return int(float(number) * {"millisecond": 1e3, "second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10}[unit.rstrip("s")])


def ticks(spark: SparkSession, tie: str = "event_id") -> DataFrame:
    """A stream of events that only move the clock, one a second, to be put together with a feed."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    text = F.lit(None).cast("string")
    return rate.select(F.col("timestamp").alias("ts"), F.col("value").alias(tie), text.alias("path"), F.lit("tick").alias("op"), text.alias("new_path"))


def keep_index(
    feed: DataFrame, docs: Callable[[], DataFrame], store: IndexStore, settings: Settings, checkpoint: str, trigger: str = "60 seconds", once: bool = False, filters: list[str] | None = None, gap: str = DEBOUNCE, late: str = "0 seconds"
) -> StreamingQuery:
    """Apply a stream of changes to a saved index, one batch after the other; readers see the
    version before or after a batch, never between. ``docs`` gives the current documents, of
    which only the changed are read; a batch with changes that are due adds one part to the store. Edits are pending across
    batches and restarts (see :func:`due_stream`). Replaying a batch does no harm."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = latest_changes(batch).persist()
        try:
            if store.load(settings) is None:
                gone = last.where("op = 'delete'").select("path")
                store.save(build_index(docs().join(gone, "path", "left_anti"), settings.split_camel_case), settings)
            elif last.limit(1).count():
                store.apply(last.where("op = 'delete'").select("path"), docs().join(last.where("op <> 'delete'").select("path"), "path", "left_semi"), settings)
        finally:
            last.unpersist()

    with rocks_state(feed.sparkSession):
        writer = due_stream(feed, settings, filters, gap, late).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
