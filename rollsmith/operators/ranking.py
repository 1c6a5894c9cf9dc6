"""Exact positions in a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.sources.scratch import scratch

#: Into how many buckets a hash order is cut; the driver sees one count for each.
BUCKETS = 1 << 14
#: Different values that one aggregation may hold for quantiles.
DISTINCT = 1 << 18


def _starts(tagged: DataFrame, bucket: str) -> tuple[DataFrame, int]:
    """Where each bucket's rows begin, as a table of as many rows as there are buckets, and the row count."""
    rows, total = [], 0
    for b, n in sorted((r[0], r[1]) for r in tagged.groupBy(bucket).count().collect()):
        rows.append((b, total))
        total += n
    return tagged.sparkSession.createDataFrame(rows, "_bucket bigint, _start bigint"), total


def indexed(df: DataFrame, order: list, out: str = "index") -> DataFrame:
    """Add each row's position (from 0) in an explicit order.

    Rows are dealt by ranges of the order and written once to the shared folder; a
    range's rows are numbered in it, and the ranges' counts are added up.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id().cast("long")).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    starts, _ = _starts(dealt, "_range")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    placed = dealt.withColumn("_within", within).join(F.broadcast(starts), F.col("_range") == F.col("_bucket"))
    return placed.withColumn(out, (F.col("_start") + F.col("_within")).cast("long")).drop("_range", "_bucket", "_start", "_within")


def running_total(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, in an explicit order.

    Ranges of the order are summed each for itself; their sums, one for each range, are added up on the driver.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    path = scratch(df.sparkSession, "totals")
    df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id().cast("long")).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    rows, total = [], 0
    for part, s in sorted((r[0], r[1]) for r in dealt.groupBy("_range").agg(F.sum(value)).collect()):
        rows.append((part, total))
        total += s or 0
    kind = dealt.agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    starts = df.sparkSession.createDataFrame(rows, f"_bucket bigint, _start {kind}")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_within", within).join(F.broadcast(starts), F.col("_range") == F.col("_bucket")).withColumn(out, F.col("_start") + F.col("_within")).drop("_range", "_bucket", "_start", "_within")


def hash_ranked(df: DataFrame, order: Column, key: list[str], out: str = "_rank") -> tuple[DataFrame, int]:
    """Add each row's position in the order of a hash, ties by key; also the row count.

    The hash's upper bits cut the order into buckets of like size, so nothing is sorted
    or written beforehand. A key that holds many equal rows stays within its bucket.
    """
    top = F.pmod(F.shiftright(order, 48), F.lit(1 << 16))
    tagged = df.withColumn("_hash", order).withColumn("_cut", F.floor(top * BUCKETS / (1 << 16)))
    starts, total = _starts(tagged, "_cut")
    within = F.row_number().over(Window.partitionBy("_cut").orderBy(F.pmod(F.shiftright("_hash", 48), F.lit(1 << 16)), "_hash", *key)) - 1
    placed = tagged.withColumn("_within", within).join(F.broadcast(starts), F.col("_cut") == F.col("_bucket"))
    return placed.withColumn(out, (F.col("_start") + F.col("_within")).cast("long")).drop("_hash", "_cut", "_bucket", "_start", "_within"), total


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles of a whole column, linearly interpolated; null where there is no value.

    The built-in exact percentile holds all distinct values of a group in one task, which
    suits lengths and counts but not a large column of doubles. Here values are dealt by
    ranges and written once; the ranges' counts tell which two rows each quantile needs.
    """
    path = scratch(df.sparkSession, "quantiles")
    value = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    value.repartitionByRange("v").withColumn("_range", F.spark_partition_id().cast("long")).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect())
    n = sum(c for _, c in counts)
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    wanted = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places})
    inside, at = [], 0
    for part, count in counts:
        inside += [(part, rank - at + 1, rank) for rank in wanted if at <= rank < at + count]
        at += count
    targets = df.sparkSession.createDataFrame(inside, "_part bigint, _row bigint, rank bigint")
    numbered = dealt.where(F.col("_range").isin([p for p, _, _ in inside])).withColumn("_row_of", F.row_number().over(Window.partitionBy("_range").orderBy("v")))
    found = numbered.join(F.broadcast(targets), (F.col("_range") == F.col("_part")) & (F.col("_row_of") == F.col("_row"))).select("rank", "v").collect()
    values = {r["rank"]: r["v"] for r in found}
    return [values[int(x)] + (values[min(int(x) + 1, n - 1)] - values[int(x)]) * (x - int(x)) for x in places]


def group_quantiles(df: DataFrame, by: list[str], column: str, probabilities: list[float], out: str = "quantiles") -> DataFrame:
    """``by`` and an array of exact quantiles of each group's values, linearly interpolated; a group may be a whole table.

    Equal values of a group are counted first, with a partial count where they are read. Up to
    ``DISTINCT`` different ones in all, one aggregation finishes; beyond, they are dealt by ranges of
    group and value, the counts of a group's ranges tell in which range each quantile lies, and
    only those rows meet again. Both ways give the same.
    """
    path = scratch(df.sparkSession, "group-quantiles")
    value = df.select(*by, F.col(column).cast("double").alias("v")).where("v is not null")
    value.groupBy(*by, "v").agg(F.count("*").alias("c")).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)
    if counted.count() <= DISTINCT:
        return counted.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, probabilities)), F.col("c")).alias(out))
    ranges = scratch(df.sparkSession, "group-ranges")
    counted.repartitionByRange(*by, "v").withColumn("_range", F.spark_partition_id().cast("long")).write.parquet(ranges)
    dealt = df.sparkSession.read.parquet(ranges)
    group = F.struct(F.lit(0).alias("_one"), *by).alias("g")
    counts = dealt.groupBy(group, "_range").agg(F.sum("c").alias("c"))
    ahead = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("start", F.coalesce(F.sum("c").over(ahead), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    places = F.transform(F.array(*map(F.lit, probabilities)), lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    targets = parts.withColumn("rank", F.explode(ranks)).where("rank >= start and rank < start + c").select("g", "_range", "n", "rank", (F.col("rank") - F.col("start")).alias("_at"))
    within = Window.partitionBy("_range", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = dealt.select(group, "_range", "v", "c").withColumn("_end", F.sum("c").over(within))
    met = numbered.join(targets, ["g", "_range"]).where("_at < _end and _at >= _end - c")
    found = met.groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    at = lambda k: F.element_at("at", k)
    q = F.transform(F.array(*map(F.lit, probabilities)), lambda p: at(F.floor(p * (F.col("n") - 1))) + (at(F.ceil(p * (F.col("n") - 1))) - at(F.floor(p * (F.col("n") - 1)))) * (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))))
    return found.select(*[F.col("g")[b].alias(b) for b in by], q.alias(out))
