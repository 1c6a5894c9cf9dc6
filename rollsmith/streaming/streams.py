"""Structured streaming: arrival rates, sessions, groups gathered across batches.

``drain`` runs a stream over what is there and stops; sinks and checkpoints lie in the
shared folder. The rates and sessions below a watermark are extensions. Step logs and pipelined
steps are in ``commits``, groups of keys that end in ``groups``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollsmith.sources.scratch import scratch


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its present end into Parquet (append) and read the result."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream to its present end, handing each micro-batch and its number to a function."""
    path = scratch(stream.sparkSession, name)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def rates(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and rows a second in tumbling windows, once they are closed."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n", (F.col("n") / seconds).alias("per_second"))


def gather_groups(stream: DataFrame, uid: str, value: str, size: int) -> DataFrame:
    """Rows ``uid, group, values``: each time a key has gathered ``size`` rows, across micro-batches."""
    kind = dict(stream.dtypes)[uid]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for frame in frames:
            held += frame.sort_values(list(frame.columns))[value].tolist()
        out = []
        while len(held) >= size:
            out.append({uid: key[0], "group": done, "values": held[:size]})
            held, done = held[size:], done + 1
        state.update((held, done))
        yield pd.DataFrame(out, columns=[uid, "group", "values"])

    return stream.groupBy(uid).applyInPandasWithState(update, f"{uid} {kind}, group bigint, values array<double>", "held array<double>, done bigint", "append", "NoTimeout")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows closer in time than the gap."""
    found = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
