"""A saved index: parts in Parquet, and commits that name them.

A part holds the documents that a change wrote and the paths that it removed or replaced.
A row counts if no later part has its path among those. The dictionary and the averages
are kept as sums that parts add to or take from, so a change reads what it replaces and
nothing else.

A commit is one small file, ``commits/<number>.json``, that lists the parts of a snapshot in order. It
appears whole, and a number is given out once: a writer writes its part, then tries to take the number
after the newest one. If another was faster, it looks at what that one brought. Where both changed
the same paths, it counts its sums anew over the winner's snapshot; then it sets its part behind the winner's
and tries again. No change is lost, and none is written twice.

Postings, the dictionary and its typo forms lie in order of their terms. A part knows the least and the greatest term of each of
its files of postings (zones), so that a search opens the files in whose range one of its terms falls, and no other.

Parts fall into tiers by their rows. Once ``FAN`` parts of a tier follow each other they are merged into one, with the
paths that they replace in older ones; so a row is written again once for each tier that it climbs, and n changes of like size
cost n log n rows. Merging is a commit like any other; it gives way to a writer who merged the same parts before.

A commit that another has followed is kept for ``grace`` seconds, and so is every part that one of the kept commits names or
that is younger than that: readers of an older snapshot find all its files, and a writer keeps the part that it has not
committed yet.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Settings
from .index import Index, among, build_index, one_off, typo_forms

SCHEMA_VERSION = 5
#: Parts of one tier that are merged, and how much larger the next tier is.
FAN = 4
#: Seconds that files outlive the snapshot that names them.
GRACE = 24 * 3600
_DOCS = {"fields": "path string, field string, terms array<string>, len int", "postings": "path string, field string, term string, len int", "manifest": "path string, mtime long"}
_TYPOS = "form string, term string"
_SUMS = {"terms": "field string, term string, df long", "totals": "field string, total long, n long"}


@dataclass(frozen=True)
class Part:
    """``sums``: the folder of its sums; ``rows``: documents and replaced paths; ``at``: the commit that brought
    the newest of what it holds."""

    name: str
    sums: str
    rows: int
    at: int = 0


class StoreMoved(RuntimeError):
    """Another writer has changed the store since the snapshot that a whole index stands on."""


def tiers(parts: list[Part]) -> list[int]:
    """A part's tier follows from its rows; one that a part of a higher tier follows is of that tier."""
    out, high = [], 0
    for part in reversed(parts):
        tier = 0
        while part.rows >= FAN ** (tier + 1):
            tier += 1
        high = max(high, tier)
        out.append(high)
    return out[::-1]


def due_merge(parts: list[Part]) -> tuple[int, int] | None:
    """The run of parts to be merged next, from the newest tier on."""
    held, end = tiers(parts), len(parts)
    while end:
        start = end
        while start and held[start - 1] == held[end - 1]:
            start -= 1
        if end - start >= FAN:
            return start, end
        end = start
    return None


class IndexStore:
    """Works on any Hadoop file system whose rename does not replace (HDFS), and on local ones, by links.
    ``spark`` reads and writes; the driver lists commits only. ``rewritten`` counts rows that merges wrote."""

    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE) -> None:
        self.spark, self.root, self.grace, self.rewritten = spark, root.rstrip("/"), grace, 0
        self._known_zones: dict[str, list[tuple[str, str, str]]] = {}
        self._jvm = spark.sparkContext._jvm

    # --- files ---

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and their times of change."""
        fs, path = self._fs(), self._path(folder)
        try:
            return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)) if fs.exists(path) else []
        except Exception as error:  # another writer has removed the folder meanwhile
            if "FileNotFoundException" in str(error):
                return []
            raise

    def _names(self, folder: str) -> list[str]:
        return [n for n, _ in self._listed(folder)]

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json")]

    def _commit(self, number: int) -> dict | None:
        """A commit's content; None if it is not one, or is gone."""
        try:
            stream = self._fs().open(self._path(f"commits/{number:012}.json"))
        except Exception as error:
            if "FileNotFoundException" in str(error):
                return None
            raise
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            return held | {"parts": [Part(**p) for p in held["parts"]]}
        except (ValueError, TypeError, KeyError):
            return None
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict | None]:
        """The highest number given out, and the newest commit that can be read."""
        numbers = self._numbers()
        return max(numbers, default=0), next((c for n in reversed(numbers) if (c := self._commit(n))), None)

    def _take(self, number: int, parts: list[Part], settings: Settings) -> bool:
        """Make commit ``number``; False if another has it. The file is written under another name first, and then
        named in one step that fails if the name is taken."""
        fs, own, name = self._fs(), self._path(f"commits/{uuid.uuid4().hex}.tmp"), self._path(f"commits/{number:012}.json")
        held = {"schema_version": SCHEMA_VERSION, "options_hash": settings.options_hash(SCHEMA_VERSION), "parts": [asdict(p) for p in parts]}
        stream = fs.create(own, False)
        stream.write(bytearray(json.dumps(held), "utf-8"))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename there would replace; a link does not
                try:
                    os.link(own.toUri().getPath(), name.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not fs.exists(name) and fs.rename(own, name)
        finally:
            fs.delete(own, False)

    def _collect(self) -> None:
        """Delete commits that were followed, and parts that no commit has named, for longer than ``grace``."""
        fs, listed = self._fs(), [(int(n[:-5]), t) for n, t in self._listed("commits") if n.endswith(".json")]
        if not listed:
            return
        oldest = max(t for _, t in listed) - self.grace * 1000  # by the clock of the file system
        followed = dict(zip((n for n, _ in listed), [t for _, t in listed[1:]], strict=False))
        kept = [n for n, _ in listed if n not in followed or followed[n] > oldest]
        held = [c for n in kept if (c := self._commit(n))]
        named = {p.name for c in held for p in c["parts"]}
        for part, _ in self._listed("parts"):
            times = [t for _, t in self._listed(f"parts/{part}")]
            if held and part not in named and times and max(times) < oldest:
                fs.delete(self._path(f"parts/{part}"), True)
        for n, _ in listed:
            if n not in kept:
                fs.delete(self._path(f"commits/{n:012}.json"), False)

    # --- parts ---

    def _read(self, part: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/parts/{part}/{table}")

    def _write_postings(self, postings: DataFrame, out: str) -> None:
        """Dealt by term, so that a search for few terms reads few files, and few row groups of them."""
        postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{out}/postings")
        # a file lies in order of terms: its first and its last row have the least and the greatest one. Rows are told by their
        # number alone, so some of other files' lasts come along, and change neither
        rows = self.spark.read.schema(_DOCS["postings"]).parquet(f"{out}/postings").select("term", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        edges = rows.groupBy("file").agg(F.max("at").alias("at")).select(F.explode(F.array(F.lit(0).cast("long"), "at")).alias("at")).distinct()
        ends = rows.join(F.broadcast(edges), "at", "left_semi")  # two numbers a file, at most
        ends.groupBy("file").agg(F.min("term").alias("least"), F.max("term").alias("greatest")).coalesce(1).write.json(f"{out}/zones")

    def _zones(self, part: str) -> list[tuple[str, str, str]]:
        """Files of postings, the least and the greatest term of each; a part never changes, so they are read once."""
        if part not in self._known_zones:
            rows = self.spark.read.schema("file string, least string, greatest string").json(f"{self.root}/parts/{part}/zones").collect()
            self._known_zones[part] = sorted((r["least"], r["greatest"], r["file"]) for r in rows)
        return [(f, a, b) for a, b, f in self._known_zones[part]]

    def _files_of(self, part: str, names: list[str]) -> list[str]:
        """Files of postings in whose range one of the names falls. Terms compare by their bytes, as in the files."""
        held, out = sorted(n.encode() for n in names), []
        for file, least, greatest in self._zones(part):
            at = bisect_left(held, least.encode())
            if at < len(held) and held[at] <= greatest.encode():
                out.append(f"{self.root}/parts/{part}/postings/{file}")
        return out

    def _weigh(self, part: str) -> int:
        return self._read(part, "manifest", _DOCS["manifest"]).select("path").unionByName(self._read(part, "gone", "path string")).count()

    def _new_part(self, fields: DataFrame, manifest: DataFrame, gone: DataFrame | None) -> str:
        """Terms of documents are written first, so that texts are tokenised once. ``gone``: paths that the part removes;
        it replaces those of its own documents as well, which are read back from it. None: it is a whole index."""
        part = uuid.uuid4().hex
        out = f"{self.root}/parts/{part}"
        fields.write.parquet(f"{out}/fields")
        held = Index(self._read(part, "fields", _DOCS["fields"]), manifest)
        self._write_postings(held.postings, out)
        manifest.write.parquet(f"{out}/manifest")
        own = self._read(part, "manifest", _DOCS["manifest"]).select("path")
        (own.limit(0) if gone is None else gone.select("path").unionByName(own).distinct()).write.parquet(f"{out}/gone")
        return part

    def _write_sums(self, part: str, terms: DataFrame, totals: DataFrame) -> str:
        folder = f"sums-{uuid.uuid4().hex}"
        out = f"{self.root}/parts/{part}/{folder}"
        sums = terms.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        sums.repartitionByRange("term").sortWithinPartitions("term", "field").write.parquet(f"{out}/terms")
        forms = typo_forms(self.spark.read.schema(_SUMS["terms"]).parquet(f"{out}/terms"))
        forms.repartitionByRange("form").sortWithinPartitions("form").write.parquet(f"{out}/typos")
        totals.groupBy("field").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).coalesce(1).write.parquet(f"{out}/totals")
        return folder

    def _sums(self, part: str, old: Index | None) -> str:
        """What the part adds to the dictionary and the averages, less what it takes out of ``old``."""
        # postings lie in order of terms, so that those of a term are counted where they are read
        new = Index(*(self._read(part, t, _DOCS[t]) for t in ("fields", "manifest")), held_postings=self._read(part, "postings", _DOCS["postings"]))
        signed = [(new, 1)]
        if old is not None:
            paths = self._read(part, "gone", "path string")
            signed.append((Index(old.fields.join(paths, "path", "left_semi"), old.manifest.join(paths, "path", "left_semi")), -1))
        terms = totals = None
        for index, sign in signed:
            rows = index.postings.select("field", "term", F.lit(sign).alias("df"))
            count = index.manifest.agg(F.lit("").alias("field"), F.lit(0).cast("long").alias("total"), (F.count("*") * sign).alias("n"))
            sizes = index.fields.select("field", (F.col("len") * sign).cast("long").alias("total"), F.lit(0).cast("long").alias("n")).unionByName(count)
            terms, totals = (rows, sizes) if terms is None else (terms.unionByName(rows), totals.unionByName(sizes))
        return self._write_sums(part, terms, totals)

    def _meet(self, part: str, others: list[Part]) -> bool:
        """Whether the part and one of the others change the same path."""
        if not others:
            return False
        paths = self._read(part, "gone", "path string")
        names = [p.name for p in others]
        theirs = self._union(names, "gone", "path string").unionByName(self._union(names, "manifest", _DOCS["manifest"]).select("path"))
        return paths.join(theirs, "path", "left_semi").limit(1).count() > 0

    # --- changes ---

    def save(self, index: Index, settings: Settings, base: int | None = None) -> str:
        """The whole index as one part. ``base``: the commit that it stands on; if the store has moved on
        from there, :class:`StoreMoved` is raised and nothing changes."""
        if not settings.use_cache:
            return ""
        part = self._new_part(index.fields, index.manifest, None)
        held = Part(part, self._sums(part, None), self._weigh(part))
        while True:
            number = max(self._numbers(), default=0)
            if base is not None and number != base:
                raise StoreMoved(f"commit {number} has followed commit {base}")
            if self._take(number + 1, [replace(held, at=number + 1)], settings):
                break
        self._collect()
        return part

    def apply(self, gone: DataFrame, docs: DataFrame, settings: Settings, meanwhile: Callable[[], None] | None = None) -> str:
        """Documents of ``gone(path)`` go, ``docs`` come or replace others. Reads of the old snapshot
        are those of the paths concerned. Without a saved index ``docs`` are the index. ``meanwhile`` is called
        between writing and committing, for tests of writers at once."""
        if not settings.use_cache:
            return ""
        base, snapshot = self._base(settings)
        new = build_index(docs, settings.split_camel_case)
        part = self._new_part(new.fields, new.manifest, gone)
        held = Part(part, self._sums(part, snapshot), self._weigh(part))
        if meanwhile:
            meanwhile()
        while True:
            number, parts = self._valid(settings)
            if number != base:
                fresh = [p for p in parts if p.at > base]
                if (snapshot is None and parts) or self._meet(part, fresh):
                    held = replace(held, sums=self._sums(part, self._snapshot(parts, settings) if parts else None))
                base, snapshot = number, parts or None
            if not self._fs().exists(self._path(f"parts/{part}/{held.sums}")):
                raise StoreMoved("the store was cleared, and with it what this writer had written")
            if self._take(number + 1, [*parts, replace(held, at=number + 1)], settings):
                break
        self.compact(settings)
        self._collect()
        return part

    def _valid(self, settings: Settings) -> tuple[int, list[Part]]:
        """The highest number, and the parts of the newest commit if it is of these options."""
        number, held = self._newest()
        own = held and (held["schema_version"], held["options_hash"]) == (SCHEMA_VERSION, settings.options_hash(SCHEMA_VERSION))
        return number, held["parts"] if own else []

    def _base(self, settings: Settings) -> tuple[int, Index | None]:
        number, parts = self._valid(settings)
        return number, self._snapshot(parts, settings) if parts else None

    def compact(self, settings: Settings) -> None:
        """Merge runs of parts of one tier until there is none."""
        while True:
            number, parts = self._valid(settings)
            run = due_merge(parts)
            if run is None:
                return
            start, end = run
            merged = self._merge(parts[start:end], first=start == 0)
            self.rewritten += merged.rows
            while not self._take(number + 1, [*parts[:start], merged, *parts[end:]], settings):
                names = [p.name for p in parts[start:end]]
                number, parts = self._valid(settings)
                place = [p.name for p in parts]
                start = place.index(names[0]) if names[0] in place else len(place)
                end = start + len(names)
                if place[start:end] != names:  # another writer has merged them
                    return

    def _merge(self, run: list[Part], first: bool) -> Part:
        """Parts that follow each other as one; the oldest parts of all need not tell what they replace."""
        part = uuid.uuid4().hex
        out = f"{self.root}/parts/{part}"
        for table in ("fields", "manifest"):
            self._rows(run, table).write.parquet(f"{out}/{table}")
        # replaced paths are left out of fields already, which have far fewer rows than postings
        self._write_postings(Index(self._read(part, "fields", _DOCS["fields"]), self._read(part, "manifest", _DOCS["manifest"])).postings, out)
        gone = self._union([p.name for p in run], "gone", "path string").distinct()
        (gone.limit(0) if first else gone).write.parquet(f"{out}/gone")
        terms, totals = (self._union_sums(run, t) for t in _SUMS)
        sums = self._write_sums(part, terms, totals)
        return Part(part, sums, self._weigh(part), max(p.at for p in run))

    # --- snapshots ---

    def _union(self, names: list[str], table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{n}/{table}" for n in names])

    def _union_sums(self, parts: list[Part], table: str) -> DataFrame:
        each = [self._read(p.name, f"{p.sums}/{table}", _SUMS[table]) for p in parts]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    def _rows(self, parts: list[Part], table: str, names: list[str] | None = None) -> DataFrame:
        """Rows of all parts that no later part replaces: one join with the newest replacement of each path,
        which is small against the oldest part. ``names``: postings of these terms, from the files that may hold them."""
        out = gone = None
        for k, part in enumerate(parts):
            if names is None:
                rows = self._read(part.name, table, _DOCS[table])
            elif files := self._files_of(part.name, names):
                rows = self.spark.read.schema(_DOCS[table]).parquet(*files).where(among(F.col("term"), names))
            else:
                rows = self.spark.createDataFrame([], _DOCS[table])
            rows = rows.withColumn("__part", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
            if k:
                own = self._read(part.name, "gone", "path string").withColumn("__gone", F.lit(k))
                gone = own if gone is None else gone.unionByName(own)
        if gone is None:
            return out.drop("__part")
        last = gone.groupBy("path").agg(F.max("__gone").alias("__gone"))
        return out.join(last, "path", "left").where("__gone is null or __part >= __gone").drop("__part", "__gone")

    def _snapshot(self, parts: list[Part], settings: Settings) -> Index:
        terms, totals = (self._union_sums(parts, t) for t in _SUMS)
        if len(parts) > 1:
            terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        n = totals.agg(F.sum("n").alias("n"))
        fields = totals.groupBy("field").agg(F.sum("total").alias("total")).where("total > 0")
        stats = fields.join(F.broadcast(n)).select("field", "n", (F.col("total") / F.col("n")).alias("avg_len"))  # one row
        return Index(self._rows(parts, "fields"), self._rows(parts, "manifest"), settings.split_camel_case, self._rows(parts, "postings"), terms, stats, lambda names: self._rows(parts, "postings", names), lambda word: self._typos(parts, word))

    def _typos(self, parts: list[Part], word: str) -> DataFrame:
        """Terms one edit away from the word, or none."""
        found = among(F.col("form"), one_off(word)) & (F.levenshtein("term", F.lit(word), 1) >= 0)
        each = [self._read(p.name, f"{p.sums}/typos", _TYPOS).where(found) for p in parts]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out.select("term").distinct()

    def version(self) -> int:
        """The number of the newest commit, 0 without one."""
        return max(self._numbers(), default=0)

    def load(self, settings: Settings) -> Index | None:
        """The newest snapshot, or None. One of another version or of other options is cleared; a
        commit that is damaged or lacks a part gives way to the one before it; any other error,
        such as a file system that does not answer, is raised and nothing is deleted."""
        for number in reversed(self._numbers()):
            held = self._commit(number)
            if held is None:
                continue
            if (held["schema_version"], held["options_hash"]) != (SCHEMA_VERSION, settings.options_hash(SCHEMA_VERSION)):
                self.clear()
                return None
            try:
                if all(self._fs().exists(self._path(f"parts/{p.name}/{p.sums}/totals/_SUCCESS")) for p in held["parts"]):
                    return self._snapshot(held["parts"], settings)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return None

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` written beside the parts for as long as the block runs: read once, and there for
        executors that are lost."""
        folder = f"{self.root}/staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(folder)
            yield self.spark.read.schema(rows.schema).parquet(folder)
        finally:
            self.remove(folder)

    def remove(self, folder: str) -> None:
        self._fs().delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)

    def clear(self) -> None:
        self.remove(self.root)
