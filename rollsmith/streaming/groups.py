"""Groups gathered from a stream, whose keys end: state is freed once a key is closed.

A key's rows, by event time, make lives: rows further apart than ``gap`` belong to different
ones. Within a life each ``size`` rows, in order of time and ``order``, are a group; what is left at
its end is a smaller one. Rows wait until the watermark has passed them, so which rows form a
group does not depend on how they arrive; a timer wakes a bucket of keys when the next group of one
is full or a life is over, and of a key that is over nothing stays in the state store. Keys share
states and timers by bucket, as each call to a state takes milliseconds, whatever it holds.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Buckets that keys are dealt to; one has a single state and a single timer, however many keys it holds.
BUCKETS = 512

_NAN = float("nan")


def _settle(held: list[tuple], life: tuple | None, watermark: int, size: int, gap: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
    """What a key's rows ``t, order, value``, in order, and its life so far come to: groups that are final, rows that wait, its life, and when to look again."""
    start, last, done = life or (None, None, 0)
    out, run, mark, at = [], [], last, 0
    while at < len(held) and held[at][0] <= watermark:
        t = held[at][0]
        if last is not None and t - last > gap:
            if run:
                out.append((start, done, [v for *_, v in run], False))
            start, run, done = None, [], 0
        start, last = t if start is None else start, t
        run.append(held[at])
        at += 1
        if len(run) == size:
            out.append((start, done, [v for *_, v in run], True))
            run, mark, done = [], t, done + 1
    if last is not None and last + gap <= watermark:
        if run:
            out.append((start, done, [v for *_, v in run], False))
        start, last, run, done = None, None, [], 0
    # The next time at which a group is full or the life is over.
    wake, n = None if last is None else last + gap, len(run)
    for t, *_ in held[at:]:
        if last is not None and t - last > gap:
            break
        wake, last, n = t + gap, t, n + 1
        if n == size:
            wake = t
            break
    return out, run + held[at:], (start, mark, done) if done else None, wake


class _Gather(StatefulProcessor):
    """State of a bucket: the rows of its keys in no group yet, what of their lives is in groups already, and its timer."""

    def __init__(self, uid: str, shape: str, size: int, gap: int):
        self.uid, self.shape, self.size, self.gap = uid, shape, size, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.shape)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for frame in rows for r in frame.iloc[:, -4:].itertuples(index=False, name=None)]
        yield self._bucket(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._bucket([], timerValues.getCurrentWatermarkInMs())

    def _bucket(self, fresh: list[tuple], watermark: int) -> pd.DataFrame:
        *columns, before = self.state.get() or (*[()] * 8, None)
        held, lives = defaultdict(list), {_one(u): life for u, *life in zip(*columns[4:])}
        for rows in (zip(*columns[:4]), fresh):
            for u, t, o, v in rows:
                held[_one(u)].append((int(t), o, v))
        out, waiting, going, wake = [], [], [], None
        for u in held.keys() | lives.keys():
            groups, rest, life, at = _settle(sorted(held[u], key=lambda r: r[:2]), lives.get(u), watermark, self.size, self.gap)
            out += [(u, *g) for g in groups]
            waiting += [(u, *r) for r in rest]
            if life:
                going.append((u, *life))
            if at is not None and (wake is None or at < wake):
                wake = at
        if waiting or going:
            self.state.update((*_columns(waiting), *_columns(going), wake))
        else:
            self.state.clear()
        if wake != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if wake is not None:
                self.handle.registerTimer(wake)
        return pd.DataFrame(out, columns=[self.uid, "start", "group", "values", "complete"])

    def close(self) -> None:
        pass


def _one(u):
    """Not-a-numbers are one key, as Spark has it."""
    return _NAN if u != u else u


def _columns(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows)] or [[] for _ in range(4)]


def gather_closing(stream: DataFrame, uid: str, value: str, order: str, time: str, *, size: int, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``uid, start, group, values, complete``: groups of ``size`` rows of each life of a key, and what is left of it when it is over.

    ``start`` is the life's first time, ``group`` counts from 0 in it. Rows later than ``late`` are dropped by the
    watermark, rows of null key or time take no part; times count in milliseconds. Run it within ``closing_state``.
    """
    kinds = dict(stream.dtypes)
    gap_ms = stream.sparkSession.sql(f"SELECT cast(extract(DAY FROM i) * 86400000 + extract(HOUR FROM i) * 3600000 + extract(MINUTE FROM i) * 60000 + extract(SECOND FROM i) * 1000 AS bigint) FROM (SELECT INTERVAL '0 0:0:0' DAY TO SECOND + INTERVAL {gap} AS i)").first()[0]
    rows = stream.where(F.col(uid).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    bucket = F.pmod(F.xxhash64(uid), F.lit(BUCKETS)).alias("_bucket")
    rows = rows.select(bucket, time, F.col(uid).alias("_u"), F.unix_millis(time).alias("_t"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    held = f"u array<{kinds[uid]}>, t array<long>, o array<{kinds[order]}>, v array<{kinds[value]}>, lived array<{kinds[uid]}>, start array<long>, last array<long>, done array<long>, wake long"
    found = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_Gather(uid, held, size, gap_ms), outputStructType=f"{uid} {kinds[uid]}, start long, group long, values array<{kinds[value]}>, complete boolean", outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("start", F.timestamp_millis("start"))


@contextlib.contextmanager
def closing_state(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB, as timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
