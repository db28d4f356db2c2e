import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexspark.operators.store import IndexStore
from lexspark.operators.search import latest_requests, search
from lexspark.plans.query import Settings
from lexspark.streaming.build import index_files
from lexspark.streaming.changes import debounce, due_changes, due_stream, keep_index, latest_changes, row_changes, settled_edits, settled_requests
from lexspark.streaming.pending import join_bursts, rocks_state
from test_engine import SCHEMA, doc

T0 = datetime(2024, 1, 1)


def events(spark, *rows):
    data = [(T0 + timedelta(seconds=s), i, path, op, new) for i, (s, path, op, new) in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp, event_id long, path string, op string, new_path string")


def test_rename_is_delete_and_create(spark):
    df = row_changes(events(spark, (0, "a", "create", None), (1, "a", "rename", "b"), (2, "c", "look", None)))
    assert {(r.path, r.op) for r in latest_changes(df).collect()} == {("a", "delete"), ("b", "create")}


def test_debounce_and_cancel(spark):
    feed = events(spark, (0, "a", "modify", None), (1, "a", "modify", None), (10, "a", "modify", None), (20, "b", "modify", None), (21, "b", "delete", None))
    bursts = sorted((r.path, r.n) for r in debounce(feed).collect())
    assert bursts == [("a", 1), ("a", 2), ("b", 2)]
    assert [(r.event_id, r.op) for r in settled_edits(feed).orderBy("event_id").collect()] == [(1, "modify"), (2, "modify"), (4, "delete")]


def test_due_changes_are_indexable_settled_and_not_cancelled(spark):
    feed = events(
        spark, (0, "a.md", "modify", None), (1, "a.md", "modify", None), (2, "b.md", "modify", None), (3, "b.md", "delete", None), (4, "x.png", "create", None),
        (5, "c.md", "rename", "d.bin"), (6, "old.txt", "rename", "new.md"), (7, "skip/e.md", "create", None), (8, "gone.png", "delete", None), (9, None, "create", None),
    )
    got = {(r.path, r.op) for r in due_changes(feed, Settings(), ["skip/"]).collect()}
    assert got == {("a.md", "modify"), ("b.md", "delete"), ("c.md", "delete"), ("old.txt", "delete"), ("new.md", "create"), ("gone.png", "delete")}


def test_requests_of_a_reader_who_still_types_are_not_run(spark):
    rows = [("s", i, T0 + timedelta(milliseconds=ms)) for i, ms in enumerate((0, 50, 129, 300, 300))] + [("t", 9, T0)]
    df = spark.createDataFrame(rows, "session string, search_id long, ts timestamp")
    assert sorted((r.session, r.search_id) for r in settled_requests(df).collect()) == [("s", 2), ("s", 4), ("t", 9)]


FEED = "ts timestamp, event_id long, path string, op string, new_path string"
TICK = (None, "tick", None)


class Feed:
    """Events in files that come one after the other, a run of the stream for each."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0

    def add(self, *rows):
        data = [(T0 + timedelta(seconds=s), self.n + i, path, op, new) for i, (s, path, op, new) in enumerate(rows)]
        self.n += len(rows)
        self.spark.createDataFrame(data, FEED).coalesce(1).write.mode("append").parquet(f"{self.root}/feed")

    def stream(self):
        return self.spark.readStream.schema(FEED).parquet(f"{self.root}/feed")

    def due(self, late="0 seconds"):
        """What one run over the files so far gives."""
        with rocks_state(self.spark):
            query = due_stream(self.stream(), Settings(), late=late).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.path, r.op, r.event_id) for r in self.spark.read.parquet(f"{self.root}/out").collect()), query.lastProgress


def test_an_edit_is_pending_across_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.add((0, "a.md", "modify", None))
    assert feed.due()[0] == []
    feed.add((1, "a.md", "modify", None), (1, "b.md", "modify", None))  # another run, one second later: the same burst
    assert feed.due()[0] == []
    feed.add((2.5, "b.md", "delete", None), (2.6, "c.md", "rename", "d.md"))
    got, progress = feed.due()
    assert got == [("b.md", "delete", 3), ("c.md", "delete", 4), ("d.md", "create", 4)]
    feed.add((60, *TICK))
    got, progress = feed.due()
    assert got == [("a.md", "modify", 1), ("b.md", "delete", 3), ("c.md", "delete", 4), ("d.md", "create", 4)]
    assert [s.numRowsTotal for s in progress.stateOperators] == [0]  # nothing is kept of what is settled


def test_events_out_of_order_join_their_burst(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.add((10, "a.md", "modify", None), (14, "a.md", "modify", None), (10, "b.md", "modify", None), (16, "b.md", "modify", None))
    feed.due("30 seconds")
    feed.add((11.5, "a.md", "modify", None), (13, "a.md", "modify", None), (12.5, "b.md", "modify", None))
    feed.add((90, *TICK))
    assert feed.due("30 seconds")[0] == [("a.md", "modify", 1), ("b.md", "modify", 2), ("b.md", "modify", 3), ("b.md", "modify", 6)]


def test_bursts():
    rnd = random.Random(7)
    for _ in range(200):
        events = [(t, t, i, "modify") for i, t in enumerate(rnd.choices(range(60), k=rnd.randrange(1, 25)))]
        ordered = sorted(e[1:3] for e in events)
        want = [e for e, nxt in zip(ordered, [*ordered[1:], (999, 0)], strict=True) if nxt[0] - e[0] >= 4]
        rnd.shuffle(events)
        held = []
        while events:  # whatever batches they come in
            k = rnd.randrange(1, 6)
            held, events = join_bursts([*held, *events[:k]], 4), events[k:]
        assert [(last, tie) for _, last, tie, _ in held] == want


def test_stream_keeps_the_index(spark, tmp_path):
    docs = spark.createDataFrame([doc("a.md", "apple"), doc("b.md", "berry")], SCHEMA)
    store, settings, feed = IndexStore(spark, f"file://{tmp_path}/ix"), Settings(), Feed(spark, str(tmp_path))

    def run(current):
        keep_index(feed.stream(), lambda: current, store, settings, str(tmp_path / "keep"), once=True).awaitTermination()

    feed.add((0, "a.md", "create", None))
    run(docs)
    assert store.load(settings).manifest.count() == 2 and len(store._names("parts")) == 1
    feed.add((5, "b.md", "delete", None), (6, "a.md", "modify", None))
    now = docs.where("path = 'a.md'").withColumn("content", F.lit("avocado"))
    run(now)
    assert search(store.load(settings), "berry").count() == 0 and search(store.load(settings), "avocado").count() == 0
    feed.add((7, "a.md", "modify", None))
    run(now)
    feed.add((20, *TICK))
    run(now)
    assert [r.path for r in search(store.load(settings), "avocado").collect()] == ["a.md"]
    # a part for the delete and one for both edits; a batch without due changes adds none
    assert len(store._names("parts")) == 3


def files(root, n):
    for i in range(n):
        (root / f"sub{i % 2}").mkdir(exist_ok=True, parents=True)
        (root / f"sub{i % 2}" / f"n{i}.{'md' if i % 3 else 'TXT'}").write_text(f"word{i} shared")
    (root / "x.b.md").write_text("dotted")
    (root / "skip.bin").write_bytes(b"zz")


def test_a_first_build_reads_each_file_once(spark, tmp_path):
    files(tmp_path / "src", 9)
    settings, seen = Settings(extra_file_types=("txt",)), []
    store = IndexStore(spark, f"file://{tmp_path}/ix")

    def told(n):
        held = store.load(settings).manifest.collect()
        seen.append((n, any(r.path.endswith("TXT") for r in held)))

    read = index_files(spark, f"file://{tmp_path}/src", store, settings, f"file://{tmp_path}/cp", files_per_batch=2, progress=told)
    assert read == 10 and seen[-1] == (10, True)  # indexable files, each once
    assert not seen[0][1]  # notes come first
    index = store.load(settings)
    assert {r.path for r in search(index, "shared").collect()} == {f"sub{i % 2}/n{i}.{'md' if i % 3 else 'TXT'}" for i in range(9)}
    assert [r.path for r in search(index, "dotted").collect()] == ["x.b.md"]
    (tmp_path / "src" / "late.md").write_text("later")
    assert index_files(spark, f"file://{tmp_path}/src", store, settings, f"file://{tmp_path}/cp") == 1  # only what is new
    assert store.load(settings).manifest.count() == 11


def test_stale_requests(spark):
    df = spark.createDataFrame([("s", 2, "new"), ("s", 1, "old")], "session string, search_id long, query string")
    assert [tuple(r) for r in latest_requests(df).collect()] == [("s", 2, "new")]
