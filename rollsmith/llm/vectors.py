"""Vector tables in shards: packed matrices, searched by blocks of queries on a grid of tasks.

Candidates are dealt by hash of their id to shards of about ``SHARD`` rows, each
packed as one row of a written table; queries are packed in blocks of ``BLOCK``. The
grid has a column for each group of blocks that a task can hold (``HELD`` bytes) and so
many rows, groups of shards, that there is work for every partition: a shard is sent to
each column and a block to each row, not every block to every shard. A task holds its
blocks, streams its shards, and merges what it finds to the best ``k`` of each query,
whose least is the floor for the shards after it; the merge over the rows of the grid
follows. Nothing is collected to the driver.

Rows take no part whose id is null or whose vector is null or holds a null or
non-finite component. Rows that repeat an id are candidates each, and each a query: the
best ``k`` of such a query id are those of all pairs of its rows and rows of other ids. A
vector shorter than others counts as followed by zeros. With fewer candidates than ``k``
all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.llm.common import frugal, materialize

#: Rows of a shard and of a block of queries; bytes of blocks, and of what is kept for them, that a task holds.
SHARD, BLOCK, HELD = 2048, 512, 32 << 20
_PACKED = "shard int, ids binary, vectors binary, width int"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    finite = ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list array as a matrix of doubles, short rows filled up with zeros."""
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    width = max(int(lengths.max(initial=0)), width or 0)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows = None, [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, rows), default=0)
            m = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["shard", "ids", "vectors", "width"])

        for batch in batches:
            numbers, keys = batch.column("shard").to_pylist(), batch.column("id").to_pylist()
            lists = batch.column("vector")
            offsets = np.asarray(lists.offsets)
            values = lists.values.to_numpy(zero_copy_only=False)
            for i, (now, key) in enumerate(zip(numbers, keys)):
                if now != shard or len(ids) >= limit:
                    if ids:
                        yield out()
                    shard, ids, rows = now, [], []
                ids.append(key)
                rows.append(values[offsets[i] : offsets[i + 1]])
        if ids:
            yield out()

    return run


def packed(rows: DataFrame, shards: int, limit: int) -> DataFrame:
    """Rows ``id, vector`` as packed shards of at most ``limit`` rows, written once."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "id", "vector")
    return materialize(dealt.mapInArrow(_pack(limit), _PACKED))


def unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(vectors, np.float64).reshape(len(numbers), width)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with zeros added to the narrower one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def sharded(vectors: DataFrame, id_col: str, vec_col: str, drop_zero: bool = False) -> tuple[DataFrame, int, DataFrame]:
    """The packed candidates, their number of shards, and the rows that take part."""
    rows = usable(vectors, id_col, vec_col)
    if drop_zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    shards = max(1, -(-rows.count() // SHARD))
    return packed(rows, shards, 2 * SHARD), shards, rows


def times(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each of ``asked`` is among sorted ids."""
    return np.searchsorted(ids, asked, "right") - np.searchsorted(ids, asked, "left")


def best_of(parts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query ids, vec ids, scores) the ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((parts[1], -parts[2] if parts[2].dtype.kind == "f" else ~parts[2], parts[0]))
    query = parts[0][order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return [x[order[place < k]] for x in parts]


class Held:
    """A block of queries in a task, and the best found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, kind: np.dtype):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)]
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score; what is below it cannot be among the first k
        self.state: dict = {}

    def add(self, found: tuple) -> None:
        self.best = best_of([np.concatenate((a, b)) for a, b in zip(self.best, found)], self.k)
        query = self.best[0]
        last = np.flatnonzero(np.concatenate((query[1:] != query[:-1], [True])))
        full = last[np.diff(np.concatenate(([-1], last))) == self.k]
        at = np.searchsorted(query[full], self.ids)
        known = np.flatnonzero(np.append(query[full], 0)[at] == self.ids) if len(full) else []
        self.floor[known] = self.best[2][full[at[known]]]


def search(index: DataFrame, shards: int, queries: DataFrame, run: Callable, k: int, score: str, state: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` over all shards, ties to the smaller id.

    ``run(shard_row, held)`` yields (query ids, vec ids, scores) of one shard for a block of queries;
    it keeps ``state`` bytes for each query.
    """
    spark = index.sparkSession
    blocks = packed(queries, max(1, -(-queries.count() // BLOCK)), BLOCK)
    n, width = blocks.agg(F.count("*"), F.max("width")).first()
    together = max(1, HELD // (BLOCK * (8 * max(width or 1, 64) + state)))
    columns = max(1, -(-n // together))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(shards, -(-partitions // columns)))
    send = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    part = F.xxhash64("ids") if columns > 1 else F.lit(0)
    held = blocks.select(F.lit(0).alias("kind"), "shard", "ids", "vectors", "width", F.pmod(part, F.lit(columns)).alias("column"))
    held = held.select("kind", "shard", "ids", "vectors", "width", send(rows, lambda r: F.col("column") * rows + r)).drop("column")
    streamed = index.withColumn("kind", F.lit(1)).select("*", send(columns, lambda c: c * rows + F.col("shard") % rows))
    met = streamed.withColumn("cell", F.col("cell").cast("int")).unionByName(held.withColumn("cell", F.col("cell").cast("int")), allowMissingColumns=True)
    met = met.repartitionById(columns * rows, F.col("cell")).sortWithinPartitions("kind", "shard")

    kind, dtype = (pa.int64(), np.int64) if score == "long" else (pa.float64(), np.float64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, mine = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for block in mine:
                if len(block.best[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(block.best, (pa.int64(), pa.int64(), kind))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {}
                for n in names:
                    value = batch.column(n)[i]
                    row[n] = (value.as_buffer() if value.is_valid else None) if pa.types.is_binary(value.type) else value.as_py()
                if row["cell"] != cell:
                    yield from out()
                    cell, mine = row["cell"], []
                if row["kind"] == 0:
                    mine.append(Held(*(x.copy() for x in unpack(row["ids"], row["vectors"], row["width"])), k, dtype))
                    continue
                for block in mine:
                    for found in run(row, block):
                        block.add(found)
        yield from out()

    found = met.mapInArrow(frugal(each), f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every(id_col: str, step: int) -> Column:
    """The stated query set: ids divisible by ``step``."""
    return F.col(id_col) % step == 0
