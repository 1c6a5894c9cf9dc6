"""Group-relative normalisation and advantage estimators.

Every estimator is a window over the group key, so all of them share one exchange and
nothing is joined back. ``ESTIMATORS`` is the registry that dispatches by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.functions import tokens as T

EPSILON = 1e-6


def _group(uid: str):
    return Window.partitionBy(uid)


def centred(df: DataFrame, score: str, uid: str, out: str = "advantage") -> DataFrame:
    """Score less its group's mean, for groups of any size."""
    return df.withColumn(out, F.col(score) - F.avg(score).over(_group(uid)))


def _moments(score: str, uid: str) -> tuple[Column, Column, Column]:
    w = _group(uid)
    n = F.count(score).over(w)
    return n, F.when(n == 1, 0.0).otherwise(F.avg(score).over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp(score).over(w))


def grpo(df: DataFrame, score: str, uid: str, *, by_std: bool = True, epsilon: float = EPSILON, out: str = "advantage") -> DataFrame:
    _, mean, std = _moments(score, uid)
    gap = F.col(score) - mean
    return df.withColumn(out, gap / (std + epsilon) if by_std else gap)


def grpo_passk(df: DataFrame, score: str, uid: str, order: str, *, by_std: bool = True, epsilon: float = EPSILON, out: str = "advantage") -> DataFrame:
    """Only a group's best row gets an advantage: its lead over the second. Groups of one raise."""
    w = Window.partitionBy(uid).orderBy(F.col(score).desc(), order)
    lead = F.col(score) - F.lead(score).over(w)
    n = F.count(score).over(_group(uid))
    value = lead / (F.stddev_samp(score).over(_group(uid)) + epsilon) if by_std else lead
    checked = F.when(n < 2, F.raise_error(F.lit("a group has fewer than two rows"))).when(F.row_number().over(w) == 1, value).otherwise(0.0)
    return df.withColumn(out, checked)


def rloo(df: DataFrame, score: str, uid: str, *, out: str = "advantage") -> DataFrame:
    n, mean, _ = _moments(score, uid)
    return df.withColumn(out, F.when(n > 1, (F.col(score) - mean) * n / (n - 1)).otherwise(F.col(score)))


def opo(df: DataFrame, score: str, uid: str, length: str, *, out: str = "advantage") -> DataFrame:
    """Score less the length-weighted mean of the group."""
    w = _group(uid)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn(out, F.col(score) - F.when(F.count(score).over(w) == 1, 0.0).otherwise(base))


def gpg(df: DataFrame, score: str, uid: str, *, f_norm: float = 1.0, out: str = "advantage") -> DataFrame:
    """Centred score scaled by the share of non-zero scores in the whole batch."""
    _, mean, _ = _moments(score, uid)
    scale = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    return df.crossJoin(F.broadcast(scale)).withColumn(out, F.col("_alpha") * (F.col(score) - mean) / f_norm).drop("_alpha")


def soft_mean(df: DataFrame, score: str, beta: float, *, out: str = "advantage") -> DataFrame:
    """Score less the soft mean of the whole batch: log-mean-exp at ``beta``, the mean at 0."""
    if beta == 0:
        stats = df.agg(F.avg(score).alias("_mean"))
    else:
        top = df.agg(F.max(F.col(score) * beta).alias("_top"))
        stats = df.crossJoin(F.broadcast(top)).groupBy("_top").agg(F.sum(F.exp(F.col(score) * beta - F.col("_top"))).alias("_s"), F.count("*").alias("_n")).select(((F.col("_top") + F.log("_s") - F.log("_n")) / beta).alias("_mean"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.col(score) - F.col("_mean")).drop("_mean")


def rf_plus_plus_baseline(tokens: DataFrame, score: str, uid: str, *, mask: str = "mask", seq: str = "seq", out: str = "advantage") -> DataFrame:
    """Token rows: the sequence's score less its group's mean, whitened over all masked tokens."""
    per = tokens.groupBy(uid, seq).agg(F.first(score).alias("_score"))
    w = Window.partitionBy(uid)
    per = per.withColumn(out, F.col("_score") - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg("_score").over(w))).drop("_score")
    spread = T.whiten_rows(tokens.join(per, [uid, seq]), out, mask)
    return spread.withColumn(out, F.col(out) * F.col(mask))


def rf_plus_plus(arrays: DataFrame, *, gamma: float = 1.0, rewards: str = "reward", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """Token rows ``seq, t, mask, returns, advantage``: discounted sums that a masked-out token resets, whitened."""
    folded = arrays.withColumn("returns", T.reverse_scan(rewards, mask, gamma, True))
    spread = T.rows(folded, [mask, "returns"], [seq]).withColumn("advantage", F.col("returns"))
    spread = T.whiten_rows(spread, "advantage", mask)
    return spread.withColumn("advantage", F.col("advantage") * F.col(mask))


def remax(tokens: DataFrame, baseline: str, *, reward: str = "reward", mask: str = "mask", seq: str = "seq", order: str = "t") -> DataFrame:
    """Token rows with masked sums to the end (``returns``) and their lead over a baseline."""
    w = Window.partitionBy(seq).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum(F.col(reward) * F.col(mask)).over(w)
    return tokens.withColumn("returns", left).withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


def gae(arrays: DataFrame, *, gamma: float, lam: float, rewards: str = "reward", values: str = "value", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """Token rows ``seq, t, mask, returns, advantage``: estimates whitened over all masked tokens."""
    folded = arrays.withColumn("advantage", T.gae(rewards, values, mask, gamma, lam))
    folded = folded.withColumn("returns", F.zip_with("advantage", values, lambda a, v: a + v))
    return T.whiten_rows(T.rows(folded, [mask, "returns", "advantage"], [seq]), "advantage", mask)


def prime_rloo(tokens: DataFrame, uid: str, *, rm: str = "reward", acc: str = "acc", mask: str = "mask", seq: str = "seq", order: str = "t", rm_coef: float = 5.0, acc_coef: float = 5.0) -> DataFrame:
    """Leave-one-out over two reward sources, summed, accumulated to the end and whitened.

    The token source is centred by the sum of its sequences' means, the outcome sits on
    the last counted token; groups need two sequences at least.
    """
    last = Window.partitionBy(seq)
    at_end = F.col(order) == F.sum(mask).over(last)
    marked = tokens.withColumn("_end", at_end.cast("int"))
    per = marked.groupBy(uid, seq).agg(F.try_divide(F.sum(F.col(rm) * F.col(mask)), F.sum(mask)).alias("_m"), F.sum(F.col(acc) * F.col("_end")).alias("_a"))
    w = Window.partitionBy(uid)
    n = F.count("*").over(w)
    per = per.select(uid, seq, n.alias("_n"), (F.sum("_m").over(w) / (n - 1)).alias("_bm"), (F.sum("_a").over(w) / (n - 1)).alias("_ba"))
    scale = F.col("_n") / (F.col("_n") - 1)
    both = marked.join(per, [uid, seq])
    reward = rm_coef * F.when(F.col(mask) > 0, F.col(rm) * scale - F.col("_bm")).otherwise(0.0) + acc_coef * F.when(F.col("_end") > 0, F.col(acc) * scale - F.col("_ba")).otherwise(0.0)
    onward = Window.partitionBy(seq).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = both.withColumn("returns", F.sum(reward * F.col(mask)).over(onward)).withColumn("advantage", F.col("returns"))
    return T.whiten_rows(summed, "advantage", mask).drop("_n", "_bm", "_ba", "_end")


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "centred": centred, "grpo": grpo, "grpo_passk": grpo_passk, "rloo": rloo, "opo": opo, "gpg": gpg, "soft_mean": soft_mean,
    "reinforce_plus_plus": rf_plus_plus, "reinforce_plus_plus_baseline": rf_plus_plus_baseline, "remax": remax, "gae": gae, "prime_rloo": prime_rloo,
}


def estimate(name: str, df: DataFrame, *args, **options) -> DataFrame:
    """Run the estimator registered under ``name``."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](df, *args, **options)


def register(name: str) -> Callable:
    """Add an estimator to the registry; a taken name raises."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, function) is not function:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = function
        return function

    return add
