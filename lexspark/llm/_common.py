"""Helpers shared by the training-data operators.

Texts travel to Python as binary columns: ``bytes.split()`` splits on exactly
space and 0x09-0x0D, which is the word definition of every operator here
(``[^\\x20\\x09-\\x0D]+``), and a string that is not valid UTF-8 cannot break a task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; it goes when the
    session ends.

    Only on one machine (tests, a laptop) may the setting be missing: then a folder of our own is set.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexspark-shared-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    files, target = _file_system(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def remove_dirs(spark: SparkSession, root: str, *names: str) -> None:
    """Delete tables below ``root`` that nothing lazy reads any more."""
    for name in names:
        files, target = _file_system(spark, f"{root}/{name}")
        files.delete(target, True)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage so
    that a lost executor costs a reread, never a recomputation of the whole chain."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, also when the driver was
    started elsewhere; on a cluster the package is installed or shipped as usual."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        held["PYTHONPATH"] = ":".join([*paths, root])


#: Bytes of texts and lists that a function of one batch meets at once (one larger row alone).
SLICE_BYTES = 2 << 20


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's variable part."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            total += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts of about ``most`` bytes."""
    part = np.cumsum(_weights(batch)) // most
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, batch.num_rows]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        # taken, not sliced: functions read the buffers of lists from their beginning
        yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with a function of one batch. Spark counts rows of a batch, not bytes, so
    batches are cut to about ``most`` bytes first: memory is bounded however long the texts are."""

    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, most):
                    yield fn(part)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return df.mapInArrow(run, schema)


def text_bytes(col: str = "text") -> "F.Column":
    return F.col(col).cast("binary")


def decode(raw: bytes | None) -> str:
    """Code points of a text; null is the empty text, broken bytes become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""


def texts_of(raw: pa.Array) -> pa.StringArray:
    """Binary texts as strings; null is the empty text, broken bytes become U+FFFD."""
    try:
        return pc.fill_null(raw.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([decode(b) for b in raw.to_pylist()], pa.string())


def pieces_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct pieces of ``texts`` between single spaces, the number of each piece in order, and
    where among these each text begins (and the last one ends)."""
    lists = pc.split_pattern(texts, " ")
    edges = lists.offsets.to_numpy().astype(np.int64)
    held = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    return held.dictionary, held.indices.to_numpy().astype(np.int64), edges - edges[0]


def runs_of_ids(sizes: np.ndarray, ids: np.ndarray | pa.Buffer) -> pa.Array:
    """Runs of 32-bit ids as binary values, which Arrow gathers as they are."""
    ends = np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), ids if isinstance(ids, pa.Buffer) else pa.py_buffer(ids)])


def reach_of(runs: pa.Array) -> np.ndarray:
    """Ids before each run of a gathered array, and in all."""
    return np.frombuffer(runs.buffers()[1], dtype=np.int32)[: len(runs) + 1] // 4 if len(runs) else np.zeros(1, dtype=np.int32)


def lists_of_ids(runs: pa.Array, edges: np.ndarray) -> pa.ListArray:
    """Consecutive runs, from each of ``edges`` to the next, as one list of ids."""
    reach = reach_of(runs)
    values = pa.Array.from_buffers(pa.int32(), int(reach[-1]), [None, runs.buffers()[2]]) if reach[-1] else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(reach[edges]), values)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """SipHash-64 of each word."""
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes, in order of its start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(n, np.uint64(seed) * _M2 + np.uint64(width), dtype=np.uint64)
        for i in range(width):
            acc = acc * _ODD + h[i : i + n]
    return mix(acc)


def key_long(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return h.view(np.int64)


def mark_windows(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``width`` that begins at one of ``starts``."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with one of ``df``."""
    held, name = {c.lower() for c in df.columns}, stem
    while name.lower() in held:
        name = "_" + name
    return name


