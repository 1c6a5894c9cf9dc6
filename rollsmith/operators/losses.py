"""Policy, value and preference losses over token rows: partial sums, one row out.

Token rows carry ``mask``; a loss mode differs from another only in its denominators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.functions.tokens import clip


def aggregate_loss(tokens: DataFrame, loss: str, mode: str = "token-mean", *, mask: str = "mask", seq: str = "seq", length: int | None = None) -> DataFrame:
    """One row ``loss``: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    kept = F.col(loss) * F.col(mask)
    if mode == "token-mean":
        return tokens.agg((F.sum(kept) / (F.sum(mask) + 1e-8)).alias("loss"))
    per = tokens.groupBy(seq).agg(F.sum(kept).alias("_s"), F.sum(mask).alias("_n"), F.count("*").alias("_all"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("_s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.col("_s") / F.col("_n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        width = F.lit(length).cast("double") if length else F.max("_all")
        return per.agg((F.sum("_s") / width).alias("loss"))
    raise ValueError(f"unknown mode {mode}")


def ppo_terms(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, *, old: str = "old_lp", new: str = "lp", advantage: str = "advantage") -> DataFrame:
    """Add the dual-clip loss of each token, and whether it was clipped from above and below."""
    gap = clip(F.col(new) - F.col(old), -20.0, 20.0)
    ratio = F.exp(gap)
    a = F.col(advantage)
    plain, clipped = -a * ratio, -a * clip(ratio, 1 - low, 1 + high)
    worse = F.greatest(plain, clipped)
    bounded = F.least(-a * dual, worse)
    return tokens.withColumns({
        "kl": -gap, "loss": F.when(a < 0, bounded).otherwise(worse), "clipped": (clipped > plain).cast("double"), "clipped_low": ((worse > -a * dual) & (a < 0)).cast("double"),
    })


def masked_means(tokens: DataFrame, columns: list[str], mask: str = "mask") -> DataFrame:
    return tokens.agg(*[(F.sum(F.col(c) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias(c) for c in columns])


def gpg_loss(tokens: DataFrame, *, new: str = "lp", advantage: str = "advantage", mode: str = "token-mean") -> DataFrame:
    return aggregate_loss(tokens.withColumn("_loss", -F.col(new) * F.col(advantage)), "_loss", mode)


def _covariance(tokens: DataFrame, new: str, advantage: str, mask: str) -> DataFrame:
    stats = tokens.agg(*[(F.sum(F.col(c) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias(f"_{c}") for c in (advantage, new)], F.sum(mask).alias("_count"))
    return tokens.crossJoin(F.broadcast(stats)).withColumn("cov", (F.col(advantage) - F.col(f"_{advantage}")) * (F.col(new) - F.col(f"_{new}"))).drop(f"_{advantage}", f"_{new}")


def clip_cov(tokens: DataFrame, key: list[str], *, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, seed: int = 0, old: str = "old_lp", new: str = "lp", advantage: str = "advantage", mask: str = "mask") -> DataFrame:
    """Tokens with ``loss``, of which a seeded few inside the covariance band are taken out of the gradient.

    How many is one number; which ones follow from the keys' hash by an ordered limit.
    """
    t = ppo_terms(_covariance(tokens, new, advantage, mask), old=old, new=new, advantage=advantage)
    wanted = max(1, int(ratio * (t.agg(F.sum(mask)).first()[0] or 0)))
    band = t.where((F.col("cov") > low) & (F.col("cov") < high) & (F.col(mask) > 0) & (F.col("clipped") == 0))
    chosen = band.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(wanted).select(*key, F.lit(0.0).alias("_corr"))
    a = F.col(advantage)
    ratio_ = F.exp(F.col(new) - F.col(old))
    return t.join(chosen, key, "left").withColumn("corr", F.coalesce("_corr", F.lit(1.0))).withColumn("loss", F.greatest(-a * ratio_, -a * clip(ratio_, 0.8, 1.2)) * F.col("corr")).drop("_corr", "_count")


def kl_cov(tokens: DataFrame, key: list[str], *, ratio: float = 0.0002, coefficient: float = 1.0, old: str = "old_lp", new: str = "lp", advantage: str = "advantage", mask: str = "mask") -> DataFrame:
    """Tokens with ``loss``; the tokens of highest covariance carry a divergence penalty."""
    t = _covariance(tokens, new, advantage, mask)
    wanted = max(1, int(ratio * (t.agg(F.sum(mask)).first()[0] or 0)))
    chosen = t.where(F.col(mask) > 0).orderBy(F.col("cov").desc(), *key).limit(wanted).select(*key, F.lit(True).alias("_top"))
    gap = F.col(new) - F.col(old)
    plain = -F.col(advantage) * F.exp(gap)
    return t.join(chosen, key, "left").withColumn("loss", F.when(F.col("_top"), plain + coefficient * F.abs(gap)).otherwise(plain)).drop("_top", "_count")


def value_loss(tokens: DataFrame, clip_range: float, *, predicted: str = "predicted", value: str = "value", returns: str = "returns", mask: str = "mask") -> DataFrame:
    """One row: half the larger of the plain and the clipped squared error, and the share clipped."""
    p, v, r = F.col(predicted), F.col(value), F.col(returns)
    plain, clipped = (p - r) * (p - r), F.pow(clip(p, v - clip_range, v + clip_range) - r, 2)
    both = tokens.withColumns({"loss": 0.5 * F.greatest(plain, clipped), "clipped": (clipped > plain).cast("double")})
    return masked_means(both, ["loss", "clipped"], mask)


def log_sigmoid(x: Column) -> Column:
    """Stable for either sign."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, *, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> Column:
    logits = chosen - rejected - (F.lit(0.0) if reference_free else ref_chosen - ref_rejected)
    if kind == "sigmoid":
        return -log_sigmoid(beta * logits) * (1 - smoothing) - log_sigmoid(-beta * logits) * smoothing
    if kind == "ipo":
        return F.pow(logits - 1 / (2 * beta), 2)
    raise ValueError(f"unknown loss {kind}")


def cross_entropy_preference(score: Column, acc: Column, beta: float) -> Column:
    """Binary cross-entropy of the scaled score against an outcome."""
    return -(acc * log_sigmoid(score * beta) + (1 - acc) * log_sigmoid(-score * beta))


def detached_preference(df: DataFrame, uid: str, acc: str, score: str, beta: float, mode: str = "none") -> DataFrame:
    """Add ``loss`` against the mean score of the group's opposite outcomes, weighted by rank if asked."""
    from rollsmith.operators.joins import opposite_peers

    peers = opposite_peers(df, uid, acc, score, "_other")
    sign = F.when(F.col(acc) > 0, 1.0).otherwise(-1.0)
    loss = -log_sigmoid((F.col(score) - F.col("_other")) * beta * sign)
    if mode != "none":
        by = {"bon_rm": score, "bon_acc": acc}[mode]
        n = F.count("*").over(Window.partitionBy(uid))
        below = F.count("*").over(Window.partitionBy(uid).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        loss = loss * n * F.pow(below / n, n - 1)
    return peers.withColumn("loss", loss).drop("_other")


def pair_accuracy(df: DataFrame, uid: str, order: str, acc: str, score: str) -> DataFrame:
    """Mean over groups of how far score order agrees with outcome order; groups without a gap count half."""
    from rollsmith.operators.joins import group_pairs

    pairs = group_pairs(df, uid, order, [acc, score])
    gap = F.col(f"{acc}_i") - F.col(f"{acc}_j")
    agrees = ((F.col(f"{score}_i") > F.col(f"{score}_j")) == (gap > 0)).cast("double")
    per = pairs.groupBy(uid).agg(F.coalesce(F.try_divide(F.sum(agrees * F.abs(gap)), F.sum(F.abs(gap))), F.lit(0.5)).alias("_a"))
    return per.agg(F.avg("_a").alias("accuracy"))


def sign_accuracy(df: DataFrame, acc: str, score: str) -> DataFrame:
    return df.agg(F.avg((F.signum(score) == F.signum(F.col(acc) * 2 - 1)).cast("double")).alias("accuracy"))


def sppo_loss(tokens: DataFrame, reward: str, eta: float = 1.0, *, old: str = "old_lp", new: str = "lp", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """Mean squared gap between a sequence's log-ratio and its scaled reward, over sequences with a counted token."""
    per = tokens.groupBy(seq).agg(F.sum((F.col(new) - F.col(old)) * F.col(mask)).alias("_r"), F.first(reward).alias("_w"), F.max(mask).cast("double").alias("_m"))
    return per.agg((F.sum(F.pow(F.col("_r") - eta * F.col("_w"), 2) * F.col("_m")) / (F.sum("_m") + 1e-8)).alias("loss"))


def kl_in_reward(tokens: DataFrame, beta: float, *, score: str = "reward", old: str = "old_lp", ref: str = "ref_lp", mask: str = "mask") -> DataFrame:
    """Add ``token_reward``: the score less the scaled divergence from the reference, on counted tokens."""
    return tokens.withColumn("kl", (F.col(old) - F.col(ref)) * F.col(mask)).withColumn("token_reward", F.col(score) - beta * F.col("kl"))


def sequence_kl(tokens: DataFrame, *, mask: str = "mask", seq: str = "seq") -> DataFrame:
    """One row: the mean over sequences of their masked mean divergence."""
    per = tokens.groupBy(seq).agg((F.sum("kl") / (F.sum(mask) + 1e-8)).alias("_k"))
    return per.agg(F.avg("_k").alias("kl"))


def offline_kl(rows: DataFrame, weight: str, policy: str, reference: str, coefficient: float) -> DataFrame:
    """Weights less the scaled sum of log-ratios; arrays that are empty or differ in length raise."""
    bad = (F.size(policy) != F.size(reference)) | (F.size(policy) == 0) | F.col(policy).isNull() | F.col(reference).isNull()
    kl = F.aggregate(F.zip_with(policy, reference, lambda a, b: a - b), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(weight, F.when(bad, F.raise_error(F.lit("log-probabilities are empty or differ in length"))).otherwise(F.col(weight) - coefficient * kl))


def adaptive_coefficient(steps: DataFrame, order: str, kl: str, n: str, *, start: float, target: float, horizon: float) -> DataFrame:
    """The coefficient after all steps: a fold over the (few) steps of a run in order."""
    ordered = steps.agg(F.sort_array(F.collect_list(F.struct(order, F.col(kl).cast("double").alias("_k"), F.col(n).cast("double").alias("_n")))).alias("_s"))
    return ordered.select(F.aggregate("_s", F.lit(float(start)), lambda b, x: b * (1 + clip(x["_k"] / target - 1, -0.2, 0.2) * x["_n"] / horizon)).alias("coefficient"))
