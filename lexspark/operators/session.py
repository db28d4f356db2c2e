"""Searches of one reader: a newer request ends the work of the one before it."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Row

from .engine import SearchEngine


#: What Spark knows the jobs of a thread by.
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class SearchSession:
    """Runs the searches of one reader, from any threads. A request that a newer one has followed is stale: its jobs are
    ended where they run and those it has yet to start never begin, and it answers with nothing, as does one that comes late. Other
    sessions, and other work of the same application, are not touched: the jobs of a request are a group of their own."""

    def __init__(self, engine: SearchEngine) -> None:
        self.engine, self.context = engine, engine.spark.sparkContext
        self._id, self._lock = uuid.uuid4().hex, threading.Lock()
        self._latest, self._running = -1, set()

    def _group(self, search_id: int) -> str:
        return f"search-{self._id}-{search_id}"

    def _begin(self, search_id: int) -> bool:
        """Whether the request is the newest; those before it end."""
        with self._lock:
            if search_id <= self._latest:
                return False
            self._latest, before = search_id, list(self._running)
            self._running.add(search_id)
        for old in before:
            self.context._jsc.sc().cancelJobGroupAndFutureJobs(self._group(old))
        return True

    def latest(self) -> int:
        """The newest request so far, -1 before the first."""
        with self._lock:
            return self._latest

    def stale(self, search_id: int) -> bool:
        with self._lock:
            return search_id < self._latest

    def _run(self, search_id: int, raw: str, limit: int | None, tries: int = 4) -> list[Row]:
        """The search, again if what ended was work that it shared with an older request, such as filling a cache."""
        while True:
            try:
                return self.engine.search(raw, limit).collect()
            except Exception as error:
                tries -= 1
                shared = "SPARK_JOB_CANCELLED" in str(error) and f"search-{self._id}-" in str(error)
                if self.stale(search_id) or not shared or not tries:
                    raise

    def search(self, search_id: int, raw: str, limit: int | None = None) -> list[Row]:
        """The best hits, or none if a newer request has come before they were there."""
        if not self._begin(search_id):
            return []
        before = {p: self.context.getLocalProperty(p) for p in _GROUP}
        self.context.setJobGroup(self._group(search_id), raw, interruptOnCancel=True)
        try:
            rows = self._run(search_id, raw, limit)
        except Exception:
            if self.stale(search_id):  # ended, by whatever error that shows
                return []
            raise
        finally:
            for name, value in before.items():
                self.context.setLocalProperty(name, value)
            with self._lock:
                self._running.discard(search_id)
        return [] if self.stale(search_id) else rows
