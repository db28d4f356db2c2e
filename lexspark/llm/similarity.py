"""Documents whose shingle sets are similar, by candidate keys that miss no pair.

A :class:`Scheme` turns a set into a signature, a signature into keys such that two sets which may be
similar share one, and tells from two signatures whether they may be. The rest is common to all schemes:
identical sets collapse first (partial aggregation), so copies cost one row each. A
first pass verifies every member of a key's group against the group's smallest document only
and joins what is linked into components. Groups that still hold several components are
finished exactly: their members are dealt into blocks of bounded size, pairs of blocks
that share such a key are compared set against set inside a task, and only the links between
components come out. No group is ever emitted as pairs, none is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, hash_words, map_arrow, materialise, remove_dirs, require, shared_dir, text_bytes, window_hashes, words_of
from .components import connected_components

#: Documents of one block, and bytes of their sets, in the exact pass.
BLOCK, BLOCK_BYTES = 256, 4 << 20


@dataclass(frozen=True)
class Scheme:
    """``sign``: sorted distinct hashes of a set to bytes. ``keys``: signatures to the place of a key's signature
    among them, and the key (64 bits). ``near``: which of two columns of signatures may be similar."""

    sign: Callable[[np.ndarray], bytes]
    keys: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    near: Callable[[list[bytes], list[bytes]], np.ndarray]


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles, A-Z lower-cased; a shorter
    text is one shingle, a text without words none."""
    words = words_of(raw.lower() if raw else raw)
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(hash_words(words), min(width, len(words))))


def signatures(docs: DataFrame, width: int, sign: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``(id, n_shingles, digest, sig)`` of every row of ``docs (id, raw)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sigs = [], [], []
        for raw in batch.column(1).to_pylist():
            s = shingle_set(raw, width)
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            sigs.append(sign(s) if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
            names=["id", "n_shingles", "digest", "sig"],
        )

    return map_arrow(docs, run, "id long, n_shingles long, digest binary, sig binary")


def _keys(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(node, key)``: the keys of each signature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, keys = scheme.keys(batch.column(1).to_pylist())
        node = batch.column(0).to_numpy(zero_copy_only=False)[place]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys)], names=["node", "key"])

    return map_arrow(nodes.select("node", "sig"), run, "node long, key long")


def _within(stars: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = scheme.near(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return map_arrow(stars.select("src", "dst", "s", "t"), run, "src long, dst long")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, blob)`` of ``docs (node, digest, raw)``: the set, if it has that digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(raw, width) for raw in batch.column(2).to_pylist()]
        own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "blob"]).filter(own)

    return map_arrow(docs, run, "node long, blob binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(edges: DataFrame, percent: int) -> DataFrame:
    """Links among ``(src, dst, a, b)``: the full sets as sorted hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        load = lambda v: np.frombuffer(v, dtype=np.uint64)
        keep = [_similar(load(x.as_py()), load(y.as_py()), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(edges.select("src", "dst", "a", "b"), run, "src long, dst long")


def block_links(side: np.ndarray, node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components among two blocks (``side`` 0 and 1, or 0 alone for
    a block with itself): at most one for each pair of components."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    own = not len(right)
    right = left if own else right
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    sizes = np.array([len(s) for s in sets])
    flat = lambda rows: (np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), sizes[rows]))
    lv, lr = flat(left)
    rv, rr = (lv, lr) if own else flat(right)
    common = np.unique(lv) if own else np.intersect1d(lv, rv)
    if own:
        values, counts = np.unique(lv, return_counts=True)
        common = values[counts > 1]
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        grid = []
        for values, rows, n in ((lv, lr, len(left)), (rv, rr, len(right))):
            pos = np.searchsorted(part, values)
            pos[pos == len(part)] = 0
            hit = part[pos] == values
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[rows[hit], pos[hit]] = 1
            grid.append(m)
        shared += grid[0] @ grid[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    ok = (100 * shared >= percent * union) & (comp[left][:, None] != comp[right][None, :])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = left[i], right[j]
        key = (min(comp[a], comp[b]), max(comp[a], comp[b]))
        found.setdefault(key, (int(node[a]), int(node[b])))
    return list(found.values())


def _sets_of(source: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, path: str) -> DataFrame:
    """``(node, blob)``, written: the sets of some classes, from the texts of their owners."""
    asked = classes.join(nodes.distinct(), "node").select(F.col("owner").alias("id"), "node", "digest")
    sets = materialise(_sets(source.join(asked, "id").select("node", "digest", "raw"), width), path)
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # a row that is repeated
        sets = materialise(sets.groupBy("node").agg(F.max("blob").alias("blob")), f"{path}_own")
    return sets


def _finish(members: DataFrame, comps: DataFrame, source: DataFrame, classes: DataFrame, width: int, percent: int, root: str) -> DataFrame:
    """Links that the groups with several components still hold."""
    held = members.join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    home = comps.select(F.col("id").alias("leader"), F.col("comp").alias("home"))
    held = held.join(home, "leader", "left").withColumn("home", F.coalesce("home", "leader"))
    held = materialise(held, f"{root}/held")
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rows = held.join(mixed, "key")
    # A place for each document: the smallest component among its leaders, so that a group of
    # copies shares few blocks; large components get blocks of their own, so that a pair of
    # blocks of one component is seen and skipped.
    # The tables of large ones are few rows and written, so that a join with them is broadcast, or
    # else can be split where one label has a great share of all documents.
    place = materialise(rows.groupBy("node", "comp").agg(F.min("home").alias("label")).join(classes.select("node", "size"), "node"), f"{root}/labels")
    many = place.groupBy("label", "comp").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("label", "comp", F.lit(True).alias("large"))
    place = place.join(materialise(many, f"{root}/large"), ["label", "comp"], "left").withColumn("part", F.when(F.col("large"), F.col("comp")).otherwise(F.lit(-1)))
    widths = place.groupBy("label", "part").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("nb")).where("nb > 1")
    number = F.pmod(F.xxhash64("node"), F.coalesce("nb", F.lit(1)))
    place = place.join(materialise(widths, f"{root}/widths"), ["label", "part"], "left").select("node", "comp", "size", F.xxhash64("label", "part", number).alias("block"))
    place = materialise(place, f"{root}/place")
    seen = rows.select("key", "node").join(place, "node").groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    a = seen.select("key", F.col("block").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh"))
    b = seen.select("key", F.col("block").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    pairs = a.join(b, "key").where("x <= y and least(xl, yl) <> greatest(xh, yh)").select("x", "y").distinct()
    pairs = materialise(pairs, f"{root}/pairs")
    # The larger block of a pair is host; all guests of a host come to it together, in buckets of
    # a block's size, so that a host meets many small blocks in few copies of itself.
    sizes = place.groupBy("block").agg(F.count("*").alias("n"))
    met = pairs.where("x <> y").join(sizes.select(F.col("block").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("block").alias("y"), F.col("n").alias("ny")), "y")
    larger = F.col("nx") >= F.col("ny")
    met = met.select(F.when(larger, F.col("x")).otherwise(F.col("y")).alias("host"), F.when(larger, F.col("y")).otherwise(F.col("x")).alias("guest"))
    guests = met.join(place.withColumnRenamed("block", "guest"), "guest").select("host", "node", "comp", "size")
    loads = guests.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("nb"))
    hosts = loads.join(pairs.where("x = y").select(F.col("x").alias("host"), F.lit(True).alias("own")), "host", "full_outer")
    hosts = materialise(hosts.select("host", F.coalesce("nb", F.lit(1)).alias("nb"), F.coalesce("own", F.lit(False)).alias("own")), f"{root}/hosts")
    copies = hosts.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).join(place.withColumnRenamed("block", "host"), "host")
    copies = copies.select("host", "bucket", F.lit(0).alias("side"), "node", "comp", (F.col("own") & (F.col("bucket") == 0)).alias("own"))
    guests = guests.join(hosts.select("host", "nb"), "host").select("host", F.pmod(F.xxhash64("node"), "nb").alias("bucket"), F.lit(1).alias("side"), "node", "comp", F.lit(False).alias("own"))
    sets = _sets_of(source, classes, place.select("node"), width, f"{root}/sets")
    full = copies.unionByName(guests).join(sets.select("node", "blob"), "node").select("host", "bucket", "side", "node", "comp", "own", "blob")

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(v, dtype=np.uint64) for v in table.column("blob").to_pylist()]
        side, node, comp, own = (table.column(c).to_numpy() for c in ("side", "node", "comp", "own"))
        found = block_links(side, node, comp, blobs, percent) if side.any() else []
        if own.any():
            at = np.flatnonzero(side == 0)
            found += block_links(side[at], node[at], comp[at], [blobs[i] for i in at], percent)
        return pa.table({"src": pa.array([f[0] for f in found], pa.int64()), "dst": pa.array([f[1] for f in found], pa.int64())})

    return full.groupBy("host", "bucket").applyInArrow(run, "src long, dst long")


def similar_documents(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``docs`` plus ``n_shingles``, ``component_id`` and ``kept``, one row per input row.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable over links.

    Defined cases: null or empty or word-free texts have no shingle and are linked with
    nothing; a text of fewer than ``width`` words is one shingle; rows with a null id are
    passed through, unlinked, with null component and ``kept`` true; repeated rows share
    their id's component (if their texts differ, they are one document, linked through any of
    the texts, and ``n_shingles`` is that of the largest set); other columns are carried along, and
    one whose name is a result column's, in any case, is replaced by it; an empty table
    gives an empty table.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    root = shared_dir(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    sigs = materialise(signatures(source, width, scheme.sign), f"{root}/sigs")
    # A class is a set; its number is given once, when the table is written, and tells classes apart
    # also where one id has several texts.
    classes = sigs.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("owner"), F.min("sig").alias("sig"), (8 * F.min("n_shingles")).alias("size"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), f"{root}/classes")
    # from here on signatures are asked of classes only
    sigs = materialise(sigs.drop("sig"), f"{root}/digests")
    remove_dirs(spark, root, "sigs")
    keys = _keys(classes, scheme)
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    members = materialise(keys.join(shared, "key").select("key", "node", "leader"), f"{root}/members")
    inside = members.select("node").distinct()
    ends = materialise(classes.select("node", "sig").join(inside, "node"), f"{root}/ends")
    stars = members.where("node <> leader").select(F.col("node").alias("src"), F.col("leader").alias("dst")).distinct()
    stars = stars.join(ends.select(F.col("node").alias("src"), F.col("sig").alias("s")), "src").join(ends.select(F.col("node").alias("dst"), F.col("sig").alias("t")), "dst")
    stars = materialise(_within(stars, scheme), f"{root}/stars")
    remove_dirs(spark, root, "ends")
    sets = _sets_of(source, classes, stars.select(F.col("src").alias("node")).unionByName(stars.select(F.col("dst").alias("node"))), width, f"{root}/star_sets")
    stars = stars.join(sets.select(F.col("node").alias("src"), F.col("blob").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("blob").alias("b")), "dst")
    links = materialise(_verify(stars, percent), f"{root}/links")
    comps = connected_components(links)
    comps = materialise(comps, f"{root}/comps")
    remove_dirs(spark, root, "star_sets", "stars")
    rest = _finish(members, comps, source, classes, width, percent, root)
    # What is left to join are components: links among them, and ids under which several
    # different texts stand. Both are few, so the second pass is short.
    named = sigs.where("id is not null").join(classes.select("digest", "node", "owner"), "digest", "left")
    held = named.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("node").alias("node"), F.max("node").alias("other"), F.min("owner").alias("owner"))
    held = materialise(held, f"{root}/ids")
    several = held.where("node <> other").select("id", F.col("node").alias("src"))
    more = rest
    if several.limit(1).count():
        more = more.unionByName(named.join(several, "id").where("src <> node").select("src", F.col("node").alias("dst")))
    for end in ("src", "dst"):
        more = more.join(comps.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left").withColumn(end, F.coalesce(f"{end}_comp", end)).drop(f"{end}_comp")
    last = connected_components(more)
    placed = held.where("node is not null").join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = placed.join(last.select(F.col("id").alias("comp"), F.col("comp").alias("final")), "comp", "left")
    placed = materialise(placed.select("id", "n_shingles", "owner", F.coalesce("final", "comp").alias("comp")), f"{root}/placed")
    # Written, one row a component: a join of two scans can be split where one has many documents.
    least = materialise(placed.groupBy("comp").agg(F.min("owner").alias("component_id")), f"{root}/least")
    # What follows reads placed, least and ids only.
    remove_dirs(spark, root, "digests", "classes", "members", "sets", "sets_own", "star_sets_own", "links", "comps", "held", "labels", "large", "widths", "place", "pairs", "hosts")
    found = placed.join(least, "comp").select("id", "n_shingles", "component_id")
    found = found.unionByName(held.where("node is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    out = ("n_shingles", "component_id", "kept")
    keep = [c for c in docs.columns if c.lower() not in out]
    key, own, size, comp = (fresh(docs, f"__{name}") for name in ("key", "id", "size", "comp"))
    found = found.select(F.col("id").alias(own), F.col("n_shingles").alias(size), F.col("component_id").alias(comp))
    joined = docs.select(*keep, F.col(id_col).cast("long").alias(key)).join(found, F.col(key) == F.col(own), "left")
    return joined.select(
        *keep,
        F.coalesce(size, F.lit(0).cast("long")).alias("n_shingles"),
        F.col(comp).alias("component_id"),
        F.coalesce(F.col(key) == F.col(comp), F.lit(True)).alias("kept"),
    )
