"""Debounce as a stateful stream: pending edits live in state until the watermark lets them go.

State of a path: its open bursts, runs of events of which each follows the one before within the gap, as Spark's session windows.
A burst is one row, its end and its last event, however many events it has. When the watermark shows that nothing can follow
within the gap any more, a burst that ends in an edit gives that edit, one that ends in anything else gives nothing,
for a create, a delete or a rename is passed on at once and cancels the edits that it ends. Then its state is dropped.
Bursts go on from batch to batch and, through the checkpoint, from run to run; events out of order
join the burst that they belong to as long as the watermark admits them. No row meets Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: State lies on disk, not in the heap of an executor.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def join_bursts(bursts: list[tuple[int, int, int, str]], gap: int) -> list[tuple[int, int, int, str]]:
    """Bursts ``(first, last, tie, op)`` in order; those that come within the gap of each other become one, which ends
    in the later event."""
    out: list[tuple[int, int, int, str]] = []
    for first, last, tie, op in sorted(bursts):
        if out and first < out[-1][1] + gap:
            held = out[-1]
            end = max(held[1:], (last, tie, op))
            out[-1] = (held[0], *end)
        else:
            out.append((first, last, tie, op))
    return out


def pending_edits(changes: DataFrame, gap_us: int, tie: str = "event_id") -> DataFrame:
    """``(path, op, ts, <tie>)`` of a stream of row changes ``(path, op, ts, <tie>)`` with a watermark on ``ts``: what
    :func:`.changes.settled_edits` gives for all of them together, as soon as it is settled. The stream is read by two
    branches: changes that are passed on at once, and bursts."""
    own = [F.col("path"), F.col("op"), F.col("ts").cast("timestamp").alias("ts"), F.col(tie).cast("long").alias(tie)]
    # a session takes in what begins where it ends; a burst does not
    gap = f"{gap_us - 1} microseconds"
    last = F.max(F.struct("ts", tie, "op")).alias("last")
    ends = changes.groupBy(F.session_window("ts", gap), "path").agg(last).where("last.op = 'modify'")
    return changes.where("op <> 'modify'").select(*own).unionByName(ends.select("path", "last.op", "last.ts", F.col(f"last.{tie}").cast("long").alias(tie)))


class rocks_state:
    """Within it, queries that start keep their state in RocksDB; they hold on to it after."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.before)
