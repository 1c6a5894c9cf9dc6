"""Sinks: Parquet, JSON lines, files by threshold and split, statistics, side files, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollsmith.operators.filters import by_thresholds
from rollsmith.operators.splits import split_exact


def parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def generations(df: DataFrame, path: str, step: int, inputs: str = "input", outputs: str = "output", score: str = "score", extra: list[str] = ()) -> None:
    """Generations as JSON lines with their step."""
    df.select(F.col(inputs).alias("input"), F.col(outputs).alias("output"), F.col(score).alias("score"), F.lit(step).alias("step"), *extra).write.mode("overwrite").json(path)


def by_threshold(df: DataFrame, path: str, reward: str, thresholds: list[float], key: list[str], *, least: int = 10, seed: int = 42) -> None:
    """One folder for each threshold and split; thresholds that few rows reach are not split."""
    for t in thresholds:
        rows = by_thresholds(df, reward, [t])
        tagged = split_exact(rows, 0.9, key, seed) if rows.limit(least).count() == least else rows.withColumn("split", F.lit("all"))
        tagged.write.mode("overwrite").partitionBy("split").parquet(f"{path}/threshold={t:g}")


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def statistics(spark: SparkSession, path: str, values: dict[str, float]) -> None:
    """A few figures as lines of name and value."""
    _write(spark, path, "".join(f"{k}: {v}\n" for k, v in values.items()))


def side_file(spark: SparkSession, path: str, settings: dict) -> None:
    _write(spark, path, json.dumps(settings, sort_keys=True))


def done_with(spark: SparkSession, path: str, settings: dict) -> bool:
    """Whether a side file says that a step ran with these settings."""
    from rollsmith.sources.readers import exists

    return exists(spark, path) and json.loads(_read(spark, path)) == settings


def metrics(df: DataFrame, path: str) -> None:
    """Metrics in long form (step, metric, value), appended."""
    df.select("step", "metric", "value").write.mode("append").parquet(path)


def role_files(df: DataFrame, messages: str, path: str) -> None:
    """The agent's and the user's view of message lists, as JSON lines in two folders."""
    from rollsmith.operators.records import role_lines

    both = role_lines(df, messages)
    both.select("agent.messages").write.mode("overwrite").json(f"{path}/agent")
    both.select("user.messages").write.mode("overwrite").json(f"{path}/user")
