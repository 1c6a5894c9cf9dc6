"""Row filters of dataset building and rollout processing.

Thresholds that depend on the data (percentiles) are one row, broadcast to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.functions.text import words
from rollsmith.operators.ranking import quantiles, running_total


#: The default tokenizer: runs without white space, none for a blank text.
tokens_of = words


def within_length(df: DataFrame, text: str, most: int, tokenizer=tokens_of) -> DataFrame:
    """Rows of at most ``most`` tokens."""
    return df.where(F.size(tokenizer(F.col(text))) <= most)


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.length(label) > 0)


def date_range(df: DataFrame, date: str, low: str, high: str) -> DataFrame:
    """ISO dates as text in the half-open range; the comparison reaches the scan."""
    return df.where((F.col(date) >= low) & (F.col(date) < high))


def at_threshold(reward: Column, threshold: Column | float) -> Column:
    """At least the threshold, but exactly it when it is 1."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(t == 1.0, reward == t).otherwise(reward >= t)


def by_thresholds(df: DataFrame, reward: str, thresholds: list[float]) -> DataFrame:
    """Rows once for each threshold they reach; the thresholds are part of the plan."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(at_threshold(F.col(reward), F.col("threshold")))


def skip_runs(df: DataFrame, run: str, round_: str, prefixes: list[str], last_round: dict[str, int]) -> DataFrame:
    """Without runs of given prefixes, and without late rounds of given runs; rounds that are no number stay."""
    number = F.try_to_number(F.col(round_), F.lit("999999")).cast("int") if dict(df.dtypes)[round_] == "string" else F.col(round_)
    keep = reduce(lambda a, p: a & ~F.col(run).startswith(p), prefixes, F.lit(True))
    for name, last in last_round.items():
        keep &= ~((F.col(run) == name) & F.coalesce(number > last, F.lit(False)))
    return df.where(keep)


def without_marker(df: DataFrame, text: str, marker: str) -> DataFrame:
    return df.where(~F.contains(F.col(text), F.lit(marker)))


def trim_lengths(df: DataFrame, length: str, percentile: float = 0.95, most: int = 5000) -> DataFrame:
    """Rows no longer than the percentile, cut to a whole number, and the limit."""
    cut = df.agg(F.least(F.floor(F.percentile(length, percentile)), F.lit(most)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(length) <= F.col("_cut")).drop("_cut")


def positive(df: DataFrame, weight: str) -> DataFrame:
    return df.where(F.col(weight) > 0)


def weight_percentile(df: DataFrame, weight: str, percentile: float) -> DataFrame:
    """Rows of at least the weight percentile of the rows given, to 12 decimals: beyond them the order of summation shows."""
    cut = quantiles(df, weight, [percentile])[0]
    return df.where(F.lit(False)) if cut is None else df.where(F.round(weight, 12) >= F.round(F.lit(cut), 12))


def varied_groups(df: DataFrame, score: str, uid: str) -> DataFrame:
    """Rows of groups whose scores differ, and of groups of one."""
    w = Window.partitionBy(uid)
    marked = df.withColumn("_keep", (F.max(score).over(w) != F.min(score).over(w)) | (F.count("*").over(w) == 1))
    return marked.where("_keep").drop("_keep")


def accuracy_band(df: DataFrame, score: str, length: str, uid: str, low: float, high: float, max_length: int, oversample: float) -> DataFrame:
    """Groups inside the band and not cut short come first; a fraction of the rows is kept.

    Groups are few compared with rows and carry one row each into the ordering.
    """
    groups = df.groupBy(uid).agg(F.avg(score).alias("_m"), F.max(length).alias("_l"), F.count("*").alias("_n"))
    ok = F.col("_m").between(low, high) & (F.col("_l") < max_length - 1)
    kept = int(df.count() // oversample)
    # One row a group: as many groups as fill the rows wanted, those that pass first.
    upto = running_total(groups.withColumn("passed", ok).select(uid, "passed", "_n"), [F.col("passed").desc(), F.col(uid)], "_n", "_upto")
    return df.join(upto.where(F.col("_upto") <= kept).select(uid, "passed"), uid)


def long_enough(df: DataFrame, text: str, least: int = 20, window: int = 150, needle: str | None = None) -> DataFrame:
    """Texts longer than ``least``; with a needle, those that hold it within the first characters."""
    found = df.where(F.length(text) > least)
    return found if needle is None else found.where(F.contains(F.substring(text, 1, window), F.lit(needle)))


def without_errors(turns: Column, player: str = "player", marker: str = "error") -> Column:
    """Turns of a conversation whose player is no error mark."""
    return F.filter(turns, lambda t: ~t[player].eqNullSafe(F.lit(marker)))


def fill_groups(df: DataFrame, uid: str, groups: int) -> DataFrame:
    """Rows of the first ``groups`` group keys; fewer groups than that raise."""
    keys = df.select(uid).distinct().orderBy(uid).limit(groups)
    found = keys.count()
    if found < groups:
        raise ValueError(f"{found} groups were generated, {groups} are needed")
    return df.join(keys, uid, "left_semi")


def require_positive(df: DataFrame, weight: str) -> DataFrame:
    """The table itself; it raises when no weight is positive."""
    if not df.where(F.col(weight) > 0).limit(1).count():
        raise ValueError("no weight is positive")
    return df
