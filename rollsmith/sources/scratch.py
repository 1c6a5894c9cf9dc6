"""A folder that driver and executors share, for tables that an operation writes in between.

A result is lazy and reads such a table when it is computed, so the operation cannot delete it.
``scratch_scope`` deletes what has been written inside it when its block ends; what is written
outside of any goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Paths written so far: first those of no scope, then those of each scope under way.
_written: list[list[str]] = [[]]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir; a temporary folder only where none is set on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/rollsmith-{name}-{uuid.uuid4().hex[:12]}"
    _written[-1].append(path)
    return path


@functools.cache
def _own(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='rollsmith-')}"


def _delete(paths: list[str]) -> None:
    """Delete paths, of any file system, with what Spark's streams put beside them."""
    jvm = SparkContext._jvm
    for path in paths if jvm is not None else ():
        for target in (path, path + "-checkpoint"):
            place = jvm.org.apache.hadoop.fs.Path(target)
            place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that operations write within the block are deleted when it ends: compute the results inside it."""
    mine: list[str] = []
    _written.append(mine)
    try:
        yield
    finally:
        _written[:] = [paths for paths in _written if paths is not mine]
        _delete(mine)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already, and its files with its machine
        _delete(_written[0])
