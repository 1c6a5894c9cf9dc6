"""Readers: Parquet and JSON lines with contracts, tagged file sets, splits, logs.

Paths go to Spark's readers as they are; nothing is opened on the driver but by Hadoop's
file system, which also tells which files exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollsmith import schemas


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Many files or folders as one table."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths)


def pretokenized(spark: SparkSession, *paths: str, group_size: int = 8) -> DataFrame:
    """Rollouts with their contract checked, and the group each game belongs to."""
    df = schemas.require(parquet(spark, *paths), ["input_ids", "attention_mask", "position_ids", "loss_mask", "sample_weight", "game_id"])
    return df.withColumn("group_index", F.floor(F.col("game_id") / group_size))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line raises when strict and is dropped otherwise. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def first_lines(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """The first ``n`` lines of one file, in file order."""
    text = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    return text.where(F.trim("value") != "").orderBy("at", "line").limit(n).select(F.from_json("value", schema).alias("x")).select("x.*")


def steps(spark: SparkSession, pattern: str, schema: str, items: str = "episodes") -> DataFrame:
    """Step files: their lists as rows, tagged with the step of the file name, in step order."""
    step = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long")
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).select(step.alias("step"), F.posexplode(items).alias("at", "item"))
    return rows.select("step", "at", "item.*").orderBy("step", "at")


def experiment_logs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Logs in folders below ``root``; the first folder names the experiment."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/+", "/")
    inside = F.regexp_extract(path, root.split("://")[-1].rstrip("/").lstrip("/") + r"/([^/]+)/", 1)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(root).select(inside.alias("experiment"), "*")


def rounds(spark: SparkSession, root: str, file: str = "train.parquet") -> DataFrame:
    """Tables of the folders ``round_<n>`` below ``root``, with the round of the folder name."""
    number = F.regexp_extract(F.col("_metadata.file_path"), r"round_(\d+)", 1).cast("int")
    return spark.read.parquet(f"{root}/round_*/{file}").select(number.alias("round"), "*")


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first path that exists: the trimmed file, else the raw one."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def split_slice(df: DataFrame, order: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The rows from one share to another of a table in an explicit order."""
    from rollsmith.operators.ranking import indexed

    n = df.count()
    return indexed(df, order, "_i").where((F.col("_i") >= int(n * low)) & (F.col("_i") < int(n * high))).drop("_i")


def losses_from_log(spark: SparkSession, path: str, key: str = "val/loss") -> DataFrame:
    """The first and the last value that a log names, by line."""
    value = F.regexp_extract("value", rf"'?{key}'?: ?([-+0-9.eE]+)", 1)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), value.try_cast("double").alias("v")).where("v is not null")
    return lines.agg(F.min_by("v", "line").alias("first"), F.max_by("v", "line").alias("last"), F.count("*").alias("n"))


def appended(base: DataFrame, batch: DataFrame, text: str, most: int) -> DataFrame:
    """A dataset with a generated batch added, without its over-long rows."""
    from rollsmith.operators.filters import within_length

    return base.unionByName(within_length(batch, text, most))
