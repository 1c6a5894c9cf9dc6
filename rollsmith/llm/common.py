"""What the operators of this subpackage share: reading, cutting lineage, text buffers."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none and runs on one machine a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _own_dir(spark.sparkContext.applicationId)
    return named.rstrip("/")


@functools.cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='rollsmith-')}"


#: Tables written so far by each call of a ``tidy`` function that is under way, innermost last.
_under_way = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The rows survive a lost executor, and later jobs neither recompute them nor
    carry their lineage. ``release`` deletes a table that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rollsmith-{uuid.uuid4().hex}"
    if calls := getattr(_under_way, "calls", None):
        calls[-1].append((spark, path))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rollsmith_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``materialize`` or a ``tidy`` function returned."""
    if path := getattr(df, "_rollsmith_path", None):
        _delete(df.sparkSession, path)


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``function`` with its result written, and whatever it has written on the way deleted, also if it fails."""

    @functools.wraps(function)
    def run(*arguments, **options) -> DataFrame:
        calls = _under_way.__dict__.setdefault("calls", [])
        calls.append([])
        try:
            found, mine = function(*arguments, **options), calls.pop()
            try:
                return materialize(found)
            finally:
                calls.append(mine)
        finally:
            for spark, path in calls.pop():
                _delete(spark, path)

    return run


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


class TextBuffer:
    """The UTF-8 bytes of a batch of texts end to end, without a Python object for each."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        column = pc.fill_null(column, b"")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are marked."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with what a task leaves free given back to the system: a worker serves many tasks and stages."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return trimmed


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch so that each piece holds about ``limit`` bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
