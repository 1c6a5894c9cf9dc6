"""Work dealt to a number of workers and gathered again in order.

A mode is a pair: how rows are dealt to workers, and which results are kept. A worker is a
partition, addressed directly (``repartitionById``), or several of neighbours where its rows are too many
for one task to sort; rows carry their place, so results come back in
the order of what was dealt, without the rows that were added to make the shares equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators.ranking import indexed

Deal = Callable[[DataFrame, int, list], DataFrame]
Keep = Callable[[DataFrame], DataFrame]
MODES: dict[str, tuple[Deal, Keep]] = {}


#: Rows that one task sorts; a larger table has several tasks for each worker.
ROWS = 250_000


def mode(name: str, deal: Deal, keep: Keep) -> None:
    """Register a mode. ``deal`` adds ``_worker`` and ``_place``; ``keep`` takes the results of all workers."""
    if name in MODES:
        raise ValueError(f"mode {name} is registered twice")
    MODES[name] = (deal, keep)


def _to_all(df: DataFrame, workers: int, order: list) -> DataFrame:
    return indexed(df, order, "_place").withColumn("_worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def _in_shares(df: DataFrame, workers: int, order: list) -> DataFrame:
    """Equal shares of neighbours; the last is filled up with rows from the start, as often as it takes."""
    placed = indexed(df, order, "_place")
    n = placed.count()
    share = max(1, -(-n // workers))
    missing = share * workers - n
    rounds = F.sequence(F.lit(1), F.lit(-(-missing // n)) if n else F.lit(1))
    added = placed.where(F.col("_place") < missing).withColumn("_round", F.explode(rounds)).withColumn("_place", F.col("_round") * n + F.col("_place")).where(F.col("_place") < n + missing).drop("_round")
    filled = placed.withColumn("_added", F.lit(False)).unionByName(added.withColumn("_added", F.lit(True)))
    return filled.withColumn("_worker", F.floor(F.col("_place") / share).cast("int"))


def _by_column(df: DataFrame, workers: int, order: list) -> DataFrame:
    """Each row to the worker that its column ``worker`` names."""
    return indexed(df, order, "_place").withColumn("_worker", F.pmod(F.col("worker"), F.lit(workers)).cast("int"))


mode("one_to_all", _to_all, lambda results: results)
mode("one_to_all_keep_first", _to_all, lambda results: results.where("_worker = 0"))
mode("shares", _in_shares, lambda results: results.where("not _added"))
mode("by_worker", _by_column, lambda results: results)


def dispatch(df: DataFrame, how: str, workers: int, order: list, work: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``work`` of every worker gives for its rows, with ``worker`` and ``place``, the row's place in ``order``.

    ``work`` takes the worker's number and its rows in frames, in order of place, and returns as many rows, in
    the same order, of ``schema``. ``order`` has to tell rows apart if results are to be the same in each run. An empty
    table gives no rows. Every row is held by one task at a time; a worker's rows stream through its task, or through several, each with
    runs of ``ROWS`` neighbours.
    """
    if how not in MODES:
        raise ValueError(f"unknown mode {how}; known are {', '.join(sorted(MODES))}")
    deal, keep = MODES[how]
    dealt = deal(df, workers, order)
    marks = ["_worker", "_place", *(["_added"] if "_added" in dealt.columns else [])]
    runs = -(-df.count() // ROWS)
    if runs > 1:
        sent = dealt.repartition(workers * runs, "_worker", F.floor(F.col("_place") / ROWS))
    else:
        sent = dealt.repartitionById(workers, F.col("_worker").cast("int"))
    sent = sent.sortWithinPartitions("_worker", "_place")
    names = [c for c in dealt.columns if c not in marks]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for worker, rows in frame.groupby("_worker", sort=True):
                rows = rows.reset_index(drop=True)
                out = pd.concat(list(work(int(worker), iter([rows[names]]))), ignore_index=True)
                if len(out) != len(rows):
                    raise ValueError("work has to return a row for each of its rows")
                yield pd.concat([rows[marks], out], axis=1)

    kinds = dict(dealt.dtypes)
    found = keep(sent.mapInPandas(run, ", ".join(f"{m} {kinds[m]}" for m in marks) + f", {schema}"))
    return found.drop("_added").withColumnsRenamed({"_worker": "worker", "_place": "place"})
