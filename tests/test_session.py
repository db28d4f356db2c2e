import threading
import time

import pytest
from pyspark.sql import functions as F

from lexspark.operators.engine import SearchEngine
from lexspark.operators.session import SearchSession
from test_engine import CORPUS, SCHEMA


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine(spark, spark.createDataFrame(CORPUS, SCHEMA))


class Slow:
    """An engine whose searches for ``slow`` take minutes of work in tasks."""

    def __init__(self, engine):
        self.engine, self.spark, self.started = engine, engine.spark, threading.Event()

    def search(self, raw, limit=None):
        if raw != "slow":
            return self.engine.search(raw, limit)

        def wait(batches):
            for b in batches:
                time.sleep(120)
                yield b

        self.started.set()
        return self.spark.range(4).repartition(2).mapInPandas(wait, "id long").select(F.col("id").cast("string").alias("path"))


def test_a_newer_request_ends_the_one_before(engine):
    slow = Slow(engine)
    session, other, answers = SearchSession(slow), SearchSession(engine), {}
    began = time.perf_counter()
    first = threading.Thread(target=lambda: answers.update(first=session.search(1, "slow")))
    first.start()
    assert slow.started.wait(60)
    time.sleep(2)  # the job is under way
    assert {r.path for r in session.search(2, "tomato")} == {"garden/tomato.md", "garden/compost.md", "code/notes.txt"}
    first.join(60)
    assert not first.is_alive() and answers["first"] == [] and time.perf_counter() - began < 110
    assert session.search(1, "tomato") == [] and session.search(2, "tomato") == []  # late ones
    assert other.search(1, "bean") and session.search(3, "bean")


def test_errors_of_the_newest_request_are_raised(engine):
    class Broken(Slow):
        def search(self, raw, limit=None):
            return self.spark.range(1).select(F.raise_error(F.lit("broken")))

    session = SearchSession(Broken(engine))
    with pytest.raises(Exception, match="broken"):
        session.search(1, "x")
    assert not session._running
