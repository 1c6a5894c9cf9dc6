"""Calls of a slow outside scorer for each row: a bounded number at a time, in order, with timeout and retry."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame


class _Slots:
    """A pool whose calls know when they have begun; a call that is late keeps its slot until it ends."""

    def __init__(self, most: int):
        self.pool = ThreadPoolExecutor(most)
        self.begun: dict[int, float] = {}
        self.lock = threading.Lock()

    def submit(self, number: int, call: Callable, *arguments) -> Future:
        def timed():
            with self.lock:
                self.begun[number] = time.monotonic()
            return call(*arguments)

        return self.pool.submit(timed)

    def result(self, number: int, future: Future, timeout: float):
        """The call's result; ``Late`` once it has run, or has waited for a slot, longer than the timeout."""
        since = time.monotonic()
        while True:
            with self.lock:
                since = self.begun.get(number, since)
            left = since + timeout - time.monotonic()
            try:
                return future.result(max(left, 0.0))
            except Late:
                if future.done():  # the call's own error of this kind
                    raise
                with self.lock:
                    waited = self.begun.get(number, since) + timeout <= time.monotonic()
                if waited:
                    future.cancel()
                    raise

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


def bounded_calls(df: DataFrame, column: str, call: Callable[[object, int], float], *, out: str = "score", most: int = 8, window: int = 32, timeout: float = 10.0, retries: int = 2, failed: float = 0.0) -> DataFrame:
    """Add ``out``: ``call(value, attempt)`` of each row's ``column``.

    In every task at most ``most`` calls are under way, and at most ``window`` rows are ahead of the one that is
    waited for, which bounds what is held. Rows keep their order. A call that raises is made again, ``retries`` times at
    most, with the number of the attempt; one that fails in the end, or takes longer than ``timeout`` seconds, scores
    ``failed``. A null value is passed on as None. An outside service sees a call again if its task is run again.
    """
    if most < 1 or window < most:
        raise ValueError("a window holds at least as many rows as there are calls")

    def attempts(value: object) -> float:
        for attempt in range(retries + 1):
            try:
                return float(call(value, attempt))
            except Exception:
                if attempt == retries:
                    raise
        return failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(most)
        serial = 0
        try:
            for batch in batches:
                values, ahead, scores = batch.column(batch.schema.get_field_index(column)), deque(), []

                def settle() -> None:
                    number, future = ahead.popleft()
                    try:
                        scores.append(slots.result(number, future, timeout))
                    except Exception:
                        scores.append(failed)

                for value in values:
                    if len(ahead) == window:
                        settle()
                    ahead.append((serial, slots.submit(serial, attempts, value.as_py())))
                    serial += 1
                while ahead:
                    settle()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])
        finally:
            slots.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` double")
