"""Sources of documents: files of notes and canvases, and tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..plans.query import Settings

DOC_COLUMNS = ("path", "mtime", "kind", "content", "basename", "directory", "aliases", "tags", "headings1", "headings2", "headings3")
# Extensions.
ALWAYS = ("md", "canvas")
IMAGES, OFFICE = ("png", "jpg", "jpeg", "webp", "gif", "bmp"), ("docx", "xlsx")
_CANVAS = "nodes array<struct<text:string,file:string,url:string,label:string>>, edges array<struct<label:string>>"


def documents_as_docs(documents: DataFrame) -> DataFrame:
    """The table ``documents`` as notes: source and language make the folder, every tenth is ``.txt``."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    folder = F.concat_ws("/", "source", "lang")
    end = F.when(F.col("doc_id") % 10 == 0, ".txt").otherwise(".md")
    none = F.lit("")
    return documents.select(
        F.concat(folder, F.lit("/"), name, end).alias("path"), F.col("doc_id").alias("mtime"), F.lit("text").alias("kind"), F.col("text").alias("content"), name.alias("basename"),
        folder.alias("directory"), none.alias("aliases"), F.concat_ws(" ", "lang", "source").alias("tags"), none.alias("headings1"), none.alias("headings2"), none.alias("headings3"),
    )


def table_as_docs(table: DataFrame, path: Column, content: Column, title: Column | None = None, heading: Column | None = None) -> DataFrame:
    """Any table with a key and a text as documents; ``path`` must be unique."""
    none = F.lit("")
    return table.select(
        path.cast("string").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit("text").alias("kind"), content.alias("content"), (none if title is None else title).alias("basename"),
        none.alias("directory"), none.alias("aliases"), none.alias("tags"), (none if heading is None else heading).alias("headings1"), none.alias("headings2"), none.alias("headings3"),
    )


def canvas_text(json: Column) -> Column:
    """Text, file, address and label of each node in order, then edge labels, one to a line;
    malformed JSON is the empty text."""
    parsed = F.from_json(json, _CANVAS)
    nodes = F.flatten(F.transform(parsed["nodes"], lambda n: F.array(n["text"], n["file"], n["url"], n["label"])))
    empty = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(nodes, empty), F.coalesce(F.transform(parsed["edges"], lambda e: e["label"]), empty))
    return F.coalesce(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n"), F.lit(""))


def parse_ignore_filters(filters: list[str]) -> tuple[list[str], list[str]]:
    """Path prefixes (lower case) and regular expressions (written ``/.../``). The engine that will
    run an expression says whether it is one; broken ones are skipped."""
    compiled = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile
    prefixes, patterns = [], []
    for f in filters:
        if len(f) > 2 and f[0] == f[-1] == "/":
            try:
                compiled(f[1:-1])
            except IllegalArgumentException:
                continue
            patterns.append(f[1:-1])
        else:
            prefixes.append(f.lower())
    return prefixes, patterns


def ignored(path: Column, filters: list[str]) -> Column:
    prefixes, patterns = parse_ignore_filters(filters)
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(path).startswith(p)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def extractable(path: Column, settings: Settings, accepts: Column | bool = True) -> Column:
    """Of a kind that is switched on, and accepted by the extractor."""
    kinds = ["pdf"] * settings.index_pdf + [*IMAGES] * settings.index_images + [*OFFICE] * settings.index_office
    accepted = accepts if isinstance(accepts, Column) else F.lit(accepts)
    return extension(path).isin(kinds) & F.coalesce(accepted, F.lit(False)) if kinds else F.lit(False)


def indexable(path: Column, settings: Settings, filters: list[str] | None = None, accepts: Column | bool = False) -> Column:
    """Allowed by extension or extractable, and not ignored."""
    allowed = extension(path).isin(*ALWAYS, *settings.extra_file_types) | extractable(path, settings, accepts)
    return allowed & ~ignored(path, filters or []) if settings.respect_excluded else allowed


def extractor(read: Callable[[str, bytes], str | None]) -> Callable[[Column, Column], Column]:
    """A function of path and bytes as the extractor of :func:`read_files`, in Arrow batches: a
    file that it cannot read, or has no text for, is the empty text."""

    def one(path: str, content: bytes) -> str:
        try:
            return read(path, content) or ""
        except Exception:  # whatever the library raises on a broken file
            return ""

    @F.pandas_udf("string")
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([one(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return run


def with_frontmatter(files: DataFrame) -> DataFrame:
    """Documents from ``(path, mtime, content)``: names from the path; aliases, tags and the
    first three heading levels from the text."""
    block = F.regexp_extract("content", r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)", 1)
    body = F.regexp_replace("content", r"\A---\r?\n[\s\S]*?\r?\n---(?:\r?\n|\z)", "")

    def listed(name: str) -> Column:
        inline = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\[?([^\]\r\n]*)\]?[ \t]*$", 1)
        items = F.regexp_extract_all(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1), F.lit(r"-[ \t]*([^\r\n]+)"), 1)
        parts = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(items)
        return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "^['\"]|['\"]$", "")), lambda p: p != "")

    tags = F.array_distinct(F.concat(listed("tags"), F.regexp_extract_all(body, F.lit(r"(?:^|\s)#([\p{L}\p{N}_/-]+)"), 1)))
    name = F.element_at(F.split("path", "/"), -1)
    heading = lambda n: F.array_join(F.regexp_extract_all(body, F.lit(rf"(?m)^#{{{n}}}[ \t]+(.*?)[ \t]*\r?$"), 1), " ")
    canvas = extension(F.col("path")) == "canvas"
    plain = lambda c: F.when(canvas, F.lit("")).otherwise(c)
    return files.select(
        "path", "mtime", F.when(canvas, "canvas").otherwise("text").alias("kind"), "content", F.regexp_replace(name, r"\.[^.]*$", "").alias("basename"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), plain(F.array_join(listed("aliases"), " ")).alias("aliases"),
        plain(F.array_join(F.transform(tags, lambda t: F.regexp_replace(t, "^#", "")), " ")).alias("tags"), *[plain(heading(n)).alias(f"headings{n}") for n in (1, 2, 3)],
    )


def _documents(files: DataFrame, root: str, settings: Settings, filters: list[str] | None, extract: Callable[[Column, Column], Column] | None, accepts: Callable[[Column], Column] | None) -> DataFrame:
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    accepted = False if extract is None else True if accepts is None else accepts(F.col("path"))
    files = files.withColumn("path", path).where(indexable(F.col("path"), settings, filters, accepted))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if extract is not None:
        own = True if accepts is None else accepts(F.col("path"))
        text = F.when(extractable(F.col("path"), settings, own), extract(F.col("path"), F.col("content"))).otherwise(text)
    mtime = (F.col("modificationTime").cast("double") * 1000).cast("long")
    return with_frontmatter(files.select("path", mtime.alias("mtime"), F.coalesce(text, F.lit("")).alias("content")))


def read_files(
    spark: SparkSession, root: str, settings: Settings | None = None, filters: list[str] | None = None, extract: Callable[[Column, Column], Column] | None = None, accepts: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Indexable files below ``root``. ``extract`` (see :func:`extractor`) maps path and bytes to text for
    other kinds of file, those whose path ``accepts`` is true for; bytes that are no UTF-8 become
    U+FFFD, so that no file can stop a build."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    return _documents(files, root, settings or Settings(), filters, extract, accepts)


def name_glob(kinds: list[str]) -> str:
    """File names that end in one of ``kinds``, in either case."""
    letter = lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.sub(r"([^\w])", r"\\\1", c)
    return "*.{" + ",".join("".join(map(letter, k)) for k in kinds) + "}"


def other_kinds(settings: Settings, extracted: bool) -> list[str]:
    """Kinds of file beside notes that are indexed."""
    drawn = ["pdf"] * settings.index_pdf + [*IMAGES] * settings.index_images + [*OFFICE] * settings.index_office
    return [k for k in dict.fromkeys([*ALWAYS, *settings.extra_file_types, *(drawn if extracted else [])]) if k != "md"]


def stream_files(
    spark: SparkSession, root: str, settings: Settings | None = None, filters: list[str] | None = None, extract: Callable[[Column, Column], Column] | None = None, accepts: Callable[[Column], Column] | None = None, kinds: list[str] | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """The same as a stream of the files of some ``kinds`` (all that are indexed), ``files_per_batch`` at a time: others are not
    opened. A file that comes later is read when it comes."""
    settings = settings or Settings()
    glob = name_glob(["md", *other_kinds(settings, extract is not None)] if kinds is None else kinds)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(root.rstrip("/"))
    return _documents(files, root, settings or Settings(), filters, extract, accepts)
