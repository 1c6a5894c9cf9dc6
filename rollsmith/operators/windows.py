"""Window operators: rolling and hopping means, bins, first rows, triggers, validators, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.operators.ranking import indexed, quantiles


def rolling_mean(df: DataFrame, value: str, width: int, order: list, *, partition: list[str] = (), full_only: bool = True, out: str = "rolling") -> DataFrame:
    """Mean of the last ``width`` rows; with ``full_only`` rows without a full window are left out.

    One order over a whole table is one task's work; large tables take a partition.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(width - 1), 0)
    found = df.withColumn(out, F.avg(value).over(w)).withColumn("_n", F.count(value).over(w))
    return (found.where(F.col("_n") == width) if full_only else found).drop("_n")


def learning_curve(df: DataFrame, value: str, width: int, order: list, *, partition: list[str] = ()) -> DataFrame:
    """Windows of ``width`` rows that hop by half of it: the rows at their ends, with ``step`` and ``mean``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    found = df.withColumn("step", F.row_number().over(w)).withColumn("mean", F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    return found.where((F.col("step") >= width) & ((F.col("step") - width) % max(1, width // 2) == 0))


def regressions(df: DataFrame, mean: str, order: list, k: int, *, partition: list[str] = (), out: str = "regressed") -> DataFrame:
    """Whether a round's mean lies below all of exactly ``k`` rounds before it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-k, -1)
    return df.withColumn(out, (F.count(mean).over(w) == k) & (F.col(mean) < F.min(mean).over(w)))


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed bins at the quantiles, from 0; equal values share a bin and equal edges raise.

    The edges are exact quantiles of the whole column.
    """
    edges = quantiles(df, value, [k / bins for k in range(bins + 1)])
    if None in edges:
        return df.withColumn(out, F.lit(None).cast("int"))
    if len(set(edges)) < bins + 1:
        raise ValueError("bin edges are not unique")
    place = sum(((F.col(value) > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), place))


def fixed_bins(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Right-closed bins between given edges; null outside them."""
    labels = labels or [f"({a:g},{b:g}]" for a, b in zip(edges, edges[1:])]
    found = F.when(F.lit(False), F.lit(""))
    for a, b, name in zip(edges, edges[1:], labels):
        found = found.when((value > a) & (value <= b), name)
    return found


def first_rows(df: DataFrame, partition: list[str], order: list) -> DataFrame:
    """The first row of each partition in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where("_rn = 1").drop("_rn")


def common_prefix(tokens: DataFrame, group: str, member: str, order: str, value: str) -> DataFrame:
    """For each group, how many leading tokens all its members share."""
    size = tokens.groupBy(group).agg(F.count_distinct(member).alias("members"))
    per = tokens.groupBy(group, order).agg(F.count_distinct(value).alias("kinds"), F.count_distinct(member).alias("present"))
    same = per.join(size, group).withColumn("ok", (F.col("kinds") == 1) & (F.col("present") == F.col("members")))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = same.withColumn("run", F.min(F.col("ok").cast("int")).over(w))
    return run.groupBy(group).agg(F.max("members").alias("members"), F.sum("run").alias("prefix"))


def zero_sums(df: DataFrame, group: str, weight: str, tolerance: float = 1e-6) -> DataFrame:
    """For each group the sum of its weights, and whether it is zero within the tolerance."""
    return df.groupBy(group).agg(F.sum(weight).alias("total"), F.count("*").alias("n")).withColumn("valid", F.abs("total") <= tolerance)


def best_median_worst(df: DataFrame, score: str, tie: list[str], n: int) -> DataFrame:
    """The ``n`` worst, middle and best rows, tagged by ``place``; the middle is centred on half the count."""
    total = df.count()
    start = max(0, total // 2 - n // 2)
    ends = df.orderBy(F.col(score), *tie).limit(n).withColumn("place", F.lit("worst")).union(df.orderBy(F.col(score).desc(), *[F.col(c).desc() for c in tie]).limit(n).withColumn("place", F.lit("best")))
    middle = indexed(df, [score, *tie], "_i").where((F.col("_i") >= start) & (F.col("_i") < start + n)).drop("_i")
    return ends.unionByName(middle.withColumn("place", F.lit("median")))


def top_fraction(df: DataFrame, value: str, fraction: float, tie: list[str]) -> DataFrame:
    """The ``max(1, int(n * fraction))`` rows of the highest value."""
    wanted = max(1, int(df.count() * fraction))
    return indexed(df, [F.col(value).desc(), *tie], "_i").where(F.col("_i") < wanted).drop("_i")


def hashed_order(key: list[str], seed: int) -> Column:
    """A seeded shuffle: an order that only the keys and the seed decide."""
    return F.xxhash64(F.lit(seed), *key)


def sample_band(df: DataFrame, value: str, low: float, high: float, n: int, key: list[str], seed: int) -> DataFrame:
    """``n`` rows of those strictly inside a band, chosen by seeded hash."""
    return df.where((F.col(value) > low) & (F.col(value) < high)).orderBy(hashed_order(key, seed), *key).limit(n)


def last_n_summary(df: DataFrame, x: str, y: str, order: list, n: int = 100) -> DataFrame:
    """Means and correlation of the last ``n`` rows; the correlation is 0 where a column is constant."""
    last = df.orderBy(*order).limit(n)
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return last.agg(F.count("*").alias("n"), F.avg(x).alias(f"mean_{x}"), F.avg(y).alias(f"mean_{y}"), F.coalesce(corr, F.lit(0.0)).alias("correlation"))


def early_late(df: DataFrame, value: str, order: list, most: int = 100) -> DataFrame:
    """Means of the first and the last ``min(most, n // 4)`` rows, and the change in percent."""
    n = max(1, min(most, df.count() // 4))
    turned = [c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order]
    early = df.orderBy(*order).limit(n).agg(F.avg(value).alias("early"))
    late = df.orderBy(*turned).limit(n).agg(F.avg(value).alias("late"))
    return early.crossJoin(late).withColumn("change_pct", F.try_divide(F.col("late") - F.col("early"), F.abs("early")) * 100)
