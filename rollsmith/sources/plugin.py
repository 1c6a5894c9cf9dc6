"""Custom sources: a class of one's own that Spark reads like any format, in batches and as a stream.

A subclass of ``ShardSource`` names its shards and yields the records of one. Spark reads
shards in parallel, one a task; as a stream, shards are an ordered list that only grows, and an
offset is how many of them are read.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class ShardSource(DataSource):
    """What a custom source defines: ``name``, ``schema``, its shards in order, and one shard's records."""

    def shards(self) -> list[Any]:
        raise NotImplementedError

    def records(self, shard: Any, schema: StructType) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Shards(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ShardStream(self, schema)


class _Shards(DataSourceReader):
    def __init__(self, source: ShardSource, schema: StructType):
        self.source, self.kept = source, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.source.shards()]

    def read(self, partition: InputPartition | None) -> Iterator:
        # A source without shards is asked for None.
        return iter(()) if partition is None or partition.value is None else self.source.records(partition.value, self.kept)


class _ShardStream(DataSourceStreamReader):
    """A micro-batch takes all shards that are there; option ``startingShard`` leaves out what lies before.

    The reader keeps nothing: after a restart Spark's own checkpoint says where to go on.
    """

    def __init__(self, source: ShardSource, schema: StructType):
        self.source, self.kept = source, schema

    def initialOffset(self) -> dict:
        return {"shards": int(self.source.options.get("startingShard", 0))}

    def latestOffset(self) -> dict:
        return {"shards": max(len(self.source.shards()), self.initialOffset()["shards"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(s) for s in self.source.shards()[start["shards"] : end["shards"]]]

    def read(self, partition: InputPartition) -> Iterator:
        return self.source.records(partition.value, self.kept)

    def commit(self, end: dict) -> None:
        pass


class RowGroups(ShardSource):
    """Parquet files, a shard for each row group; option ``path`` is a file or folder of any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        path = self.options["path"]
        system, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        if system.get_file_info(at).type == pafs.FileType.File:
            return system, [at]
        return system, sorted(f.path for f in system.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))

    def schema(self) -> StructType:
        system, files = self._files()
        return from_arrow_schema(pq.read_schema(files[0], filesystem=system))

    def shards(self) -> list[tuple[str, int]]:
        system, files = self._files()
        return [(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=system).metadata.num_row_groups)]

    def records(self, shard: tuple[str, int], schema: StructType) -> Iterator[pa.RecordBatch]:
        system, _ = self._files()
        yield from pq.ParquetFile(shard[0], filesystem=system).iter_batches(row_groups=[shard[1]], columns=schema.names)


def register(spark: SparkSession, source: type[ShardSource]) -> str:
    """Make a source known to ``spark.read.format`` and ``spark.readStream.format``; its name."""
    if not (isinstance(source, type) and issubclass(source, ShardSource)):
        raise TypeError("a source is a class below ShardSource")
    spark.dataSource.register(source)
    return source.name()


def register_from(spark: SparkSession, path: str, name: str) -> str:
    """The same for a class in a Python file."""
    spec = importlib.util.spec_from_file_location(f"custom_{name}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return register(spark, getattr(module, name))
