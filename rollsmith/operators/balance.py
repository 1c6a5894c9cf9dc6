"""Balanced partitioning of sequence lengths.

Differencing is sequential, so ``partition`` runs it for one batch at a time (``applyInPandas``
by batch id): batches are what a trainer takes in one step, so a group is small. ``partition_tree``
takes batches of any size: chunks are partitioned each for itself, and only the sums of their
parts meet, in a tree of tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.sources.scratch import scratch

#: Rows of a chunk that one task partitions; states of sums that one task merges.
CHUNK, FAN_IN = 4096, 64


def differencing(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Largest differencing: states of ``k`` sums are merged, widest spread first, largest set to smallest."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size and len(lengths) % k:
        raise ValueError("the number of lengths is not divisible by the number of parts")
    blocks = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    ranked = lambda sets: sorted(sets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)
    heap = []
    for serial, block in enumerate(blocks):
        sets = [(lengths[i], [(i, lengths[i])]) for i in block] + [(0, [])] * (k - len(block))
        sets = ranked(sets)
        heap.append((_Widest(sets), serial, sets))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sets = ranked([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
        heapq.heappush(heap, (_Widest(sets), serial, sets))
        serial += 1
    return [[i for i, _ in s[1]] for s in heap[0][2]] if heap else [[] for _ in range(k)]


class _Widest:
    """Heap order of states: the widest spread first, then the one with the largest set."""

    __slots__ = ("spread", "top")

    def __init__(self, sets: list[tuple[int, list]]):
        self.spread, self.top = sets[0][0] - sets[-1][0], (sets[0][0], len(sets[0][1]), sets[0][1])

    def __lt__(self, other: _Widest) -> bool:
        return self.spread > other.spread if self.spread != other.spread else self.top > other.top

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Widest) and (self.spread, self.top) == (other.spread, other.top)


def greedy(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Each length, in the order given, to the part with the least sum so far."""
    extra = sum(lengths) + 1 if equal_size else 0
    heap, parts = [(0, j) for j in range(k)], [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (total + n + extra, j))
    return parts


def partition(df: DataFrame, batch: str, position: str, length: str, k: int, *, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """Add ``part`` to the rows of every batch; parts are numbered by their smallest position's order."""
    solve = {"differencing": differencing, "greedy": greedy}[method]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position, kind="stable").reset_index(drop=True)
        parts = solve([int(x) for x in rows[length]], k, equal_size)
        rows["part"] = 0
        for number, members in enumerate(parts):
            rows.loc[members, "part"] = number
        return rows[[batch, position, length, "part"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(batch, position, length).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {position} {kinds[position]}, {length} {kinds[length]}, part int")


def merged_sums(states: list[np.ndarray]) -> list[np.ndarray]:
    """Largest differencing of whole partitions: for each state of ``k`` sums, into which merged part each of its parts goes.

    The two states of widest spread are merged, largest part to smallest, until one is left. Merged
    parts are numbered from the largest sum on.
    """
    heap, places = [], {}
    for i, sums in enumerate(states):
        order = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (-float(sums[order[0]] - sums[order[-1]]), i, sums[order], {i: order}))
    serial = len(states)
    while len(heap) > 1:
        (_, _, a, left), (_, _, b, right) = heapq.heappop(heap), heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        parts = {i: p[order] for i, p in left.items()} | {i: p[::-1][order] for i, p in right.items()}
        heapq.heappush(heap, (-float(sums[order[0]] - sums[order[-1]]), serial, sums[order], parts))
        serial += 1
    for i, parts in heap[0][3].items() if heap else ():
        places[i] = np.empty(len(parts), np.int64)
        places[i][parts] = np.arange(len(parts))
    return [places[i] for i in range(len(states))]


def _chunked(df: DataFrame, batch: str, position: str, size: int) -> DataFrame:
    """Add ``_chunk``: a batch's rows in chunks of exactly ``size``, but for its last; hash buckets number them, so no task sees a batch."""
    counts = df.groupBy(batch).agg(F.count("*").alias("_all"))
    tagged = df.join(counts, batch).withColumn("_bucket", F.pmod(F.xxhash64(position), F.ceil(F.col("_all") / size)))
    ahead = Window.partitionBy(batch).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy(batch, "_bucket").agg(F.count("*").alias("_here")).select(batch, "_bucket", F.coalesce(F.sum("_here").over(ahead), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(batch, "_bucket").orderBy(position)) - 1
    placed = tagged.withColumn("_within", within).join(starts, [batch, "_bucket"])
    return placed.withColumn("_chunk", F.floor((F.col("_start") + F.col("_within")) / size)).drop("_bucket", "_start", "_within")


def partition_tree(df: DataFrame, batch: str, position: str, length: str, k: int, *, equal_size: bool = False, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """Add ``part`` to the rows of batches of any size.

    Rows are dealt to chunks of about ``chunk``, a multiple of ``k``; differencing makes ``k`` parts of
    each. A state of ``k`` sums stands for a chunk from there on: ``fan_in`` states at a time are merged
    by the same rule until one is left, and joins of the states hand the final numbers down to the chunks.
    A batch of one chunk is partitioned as ``partition`` does. Parts of ``equal_size`` have as many rows each,
    and a batch whose rows ``k`` doesn't divide raises. Rows of null batch or position take no part.
    """
    spark, kinds = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    rows = _chunked(df.select(batch, position, length).where(F.col(batch).isNotNull() & F.col(position).isNotNull()), batch, position, -(-chunk // k) * k)

    def solved(chunk_rows: pd.DataFrame) -> pd.DataFrame:
        chunk_rows = chunk_rows.sort_values(position, kind="stable").reset_index(drop=True)
        if equal_size and chunk_rows["_all"].iloc[0] % k:
            raise ValueError("the number of lengths is not divisible by the number of parts")
        own = np.zeros(len(chunk_rows), np.int32)
        for number, members in enumerate(differencing([int(x) for x in chunk_rows[length]], k, equal_size)):
            own[members] = number
        return chunk_rows.assign(_own=own)[[batch, "_chunk", position, length, "_own"]]

    path = scratch(spark, "chunks")
    rows.groupBy(batch, "_chunk").applyInPandas(solved, f"{batch} {kinds[batch]}, _chunk long, {position} {kinds[position]}, {length} {kinds[length]}, _own int").write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.groupBy(batch, "_chunk", "_own").agg(F.sum(F.col(length).cast("long")).alias("s"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("_by", i), F.lit(0).cast("long")))
    states = sums.groupBy(batch, "_chunk").agg(F.map_from_entries(F.collect_list(F.struct("_own", "s"))).alias("_by")).select(batch, F.col("_chunk").alias("state"), slots.alias("sums"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("state", kind="stable")
        places = merged_sums([np.array(s, np.int64) for s in group["sums"]])
        return pd.DataFrame({batch: group[batch], "state": group["state"], "sums": group["sums"], "places": [p.tolist() for p in places]})

    levels = []
    while True:
        up = scratch(spark, "sums")
        met = states.withColumn("_up", F.floor(F.col("state") / fan_in)).groupBy(batch, "_up").applyInPandas(merge, f"{batch} {kinds[batch]}, state long, sums array<long>, places array<long>")
        met.withColumn("up", F.floor(F.col("state") / fan_in)).write.parquet(up)
        levels.append(spark.read.parquet(up))
        if not levels[-1].where("up > 0").take(1):
            break
        cells = levels[-1].select(batch, "up", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("sums").alias("s"))))
        together = cells.groupBy(batch, "up", "place").agg(F.sum("s").alias("s")).groupBy(batch, "up").agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("_c"))
        states = together.select(batch, F.col("up").alias("state"), F.transform("_c", lambda c: c["s"]).alias("sums"))
    final = levels[-1].select(batch, "state", "places")
    for level in reversed(levels[:-1]):
        above = final.select(batch, F.col("state").alias("up"), F.col("places").alias("_above"))
        final = level.join(above, [batch, "up"]).select(batch, "state", F.transform("places", lambda p: F.get("_above", p)).alias("places"))
    found = rows.join(final.withColumnRenamed("state", "_chunk"), [batch, "_chunk"])
    return found.select(batch, position, length, F.get("places", F.col("_own")).cast("int").alias("part"))


def imbalance(df: DataFrame, groups: list[str], part: str, length: str) -> DataFrame:
    """Least, largest and mean sum of the parts, and the gap between them."""
    sums = df.groupBy(*groups, part).agg(F.sum(length).alias("_s"))
    return sums.groupBy(*groups).agg(F.min("_s").alias("least"), F.max("_s").alias("largest"), F.avg("_s").alias("mean")).withColumn("gap", F.col("largest") - F.col("least"))


def micro_batch_count(df: DataFrame, groups: list[str], length: str, budget: int, *, least: int = 1, multiple: int = 1) -> DataFrame:
    """How many micro-batches of a token budget a batch needs."""
    found = df.groupBy(*groups).agg(F.sum(length).alias("tokens"), F.count("*").alias("rows"))
    n = F.greatest(F.least(F.col("rows"), F.ceil(F.col("tokens") / budget)), F.lit(least))
    return found.withColumn("micro_batches", (F.ceil(n / multiple) * multiple).cast("long"))


def serpentine(df: DataFrame, batch: str, position: str, length: str, k: int) -> DataFrame:
    """Parts dealt in turns by falling length: a native approximation for batches of any size."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(F.col(length).desc(), position)) - 1
    turn, place = F.floor(rank / k), rank % k
    return df.withColumn("part", F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int"))


def micro_batch_order(df: DataFrame, groups: list[str], part: str, length: str, position: str) -> DataFrame:
    """Parts by falling sum of squared lengths, then falling first position."""
    per = df.groupBy(*groups, part).agg(F.sum(F.col(length).cast("long") * F.col(length)).alias("work"), F.min(position).alias("first"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("work").desc(), F.col("first").desc())))
