"""Steps of a stream that leave their rows once, whatever fails in between.

A micro-batch has a number, and Spark runs a batch that it has not committed again under the
same number. So a step's rows go to a folder of the number, which a second run replaces, and
only numbers that are committed are read. What lies between two runs of a stream is in its
folder: give the same one to go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollsmith.sources.scratch import scratch


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, of any file system; nothing in one that isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _mark(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


def last_committed(spark: SparkSession, folder: str) -> int:
    """The last batch that the stream of a folder has committed, -1 before the first. All before it are, too."""
    return max((int(n) for n in _names(spark, f"{folder}/checkpoint/commits") if n.isdigit()), default=-1)


def write_number(rows: DataFrame, path: str, number: int) -> None:
    """The rows of one number, in place of those that an earlier run of it has left."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_numbers(spark: SparkSession, path: str, schema: StructType, last: int) -> DataFrame:
    """The rows of all numbers up to ``last``, with their number as ``batch``."""
    if not any(n.startswith("batch=") for n in _names(spark, path)):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path).where(F.col("batch") <= last)


def _run(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def step_log(stream: DataFrame, name: str, summarize: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """A log of what each micro-batch summed up to, with the batch's number, each committed batch once.

    With a ``folder`` of an earlier run the stream goes on where that one has stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, f"{name}-log")
    shape: list[StructType] = []

    def each(batch: DataFrame, number: int) -> None:
        rows = summarize(batch)
        shape[:] = [rows.schema]
        write_number(rows, f"{folder}/rows", number)

    _run(stream, folder, each)
    schema = shape[0] if shape else summarize(spark.createDataFrame([], stream.schema)).schema
    return read_numbers(spark, f"{folder}/rows", schema, last_committed(spark, folder))


def one_ahead(stream: DataFrame, name: str, prepare: Callable[[DataFrame], DataFrame], consume: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Prepare each batch while the one before it is consumed; every batch is consumed, in order.

    What is prepared lies in the folder under its number until ``consume`` has returned for it. A run
    that stops in between consumes it in the next one. ``consume`` may be called again for a number whose
    call was cut off, so what it leaves should go by number (``write_number``).
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, name)

    def waiting(below: int) -> Iterator[int]:
        done = {int(n) for n in _names(spark, f"{folder}/consumed") if n.isdigit()}
        ready = (int(n.removeprefix("batch=")) for n in _names(spark, f"{folder}/prepared") if n.startswith("batch="))
        return iter(sorted(n for n in ready if n < below and n not in done))

    def consume_all(below: int) -> None:
        for number in waiting(below):
            consume(spark.read.parquet(f"{folder}/prepared/batch={number}"), number)
            _mark(spark, f"{folder}/consumed/{number}")

    def each(batch: DataFrame, number: int) -> None:
        failed: list[BaseException] = []

        def behind() -> None:
            try:
                consume_all(number)
            except BaseException as e:  # raised again below, in the stream's own thread
                failed.append(e)

        thread = InheritableThread(target=behind)
        thread.start()
        try:
            write_number(prepare(batch), f"{folder}/prepared", number)
        finally:
            thread.join()
        if failed:
            raise failed[0]

    _run(stream, folder, each)
    consume_all(last_committed(spark, folder) + 1)
