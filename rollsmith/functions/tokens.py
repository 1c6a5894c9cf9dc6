"""Maths on token arrays, as column expressions without a shuffle.

Arrays of one row are aligned by position; a mask holds 0 or 1. Sums are taken over
masked-in tokens only, so a NaN outside the mask does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Inside a lambda an outer expression is evaluated for every element; bound as a lambda's
    own argument it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Name) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, x: a + x)


def masked_sum(values: Name, mask: Name) -> Column:
    return total(F.zip_with(_c(values), _c(mask), lambda x, m: F.when(m > 0, x.cast("double")).otherwise(0.0)))


def mask_count(mask: Name) -> Column:
    return total(F.transform(_c(mask), lambda m: m.cast("double")))


def masked_mean(values: Name, mask: Name) -> Column:
    return masked_sum(values, mask) / (mask_count(mask) + 1e-8)


def masked_var(values: Name, mask: Name) -> Column:
    """Variance with Bessel's correction; null when fewer than two tokens count."""
    n = mask_count(mask)
    squares = lambda mean: masked_sum(F.transform(_c(values), lambda x: (x - mean) * (x - mean)), mask)
    return F.when(n > 1, let(masked_mean(values, mask), squares) / (n + 1e-8) * n / (n - 1))


def masked_whiten(values: Name, mask: Name, shift_mean: bool = True) -> Column:
    stats = F.struct(masked_mean(values, mask).alias("mean"), F.sqrt(masked_var(values, mask) + 1e-8).alias("std"))
    return let(stats, lambda s: F.transform(_c(values), lambda x: (x - s["mean"]) / s["std"] + (F.lit(0.0) if shift_mean else s["mean"])))


def whiten_rows(tokens: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """Token rows with ``value`` whitened over all masked tokens of the table.

    The three sums are one row, which every row sees through a broadcast join.
    """
    stats = tokens.agg(
        F.sum(F.col(value) * F.col(mask)).alias("_s"), F.sum(mask).cast("double").alias("_n"), F.sum(F.col(value) * F.col(value) * F.col(mask)).alias("_q")
    ).select((F.col("_s") / (F.col("_n") + 1e-8)).alias("_mean"), "_n", "_s", "_q")
    stats = stats.select("_mean", ((F.col("_q") - 2 * F.col("_mean") * F.col("_s") + F.col("_mean") * F.col("_mean") * F.col("_n")) / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)).alias("_var"))
    return tokens.crossJoin(F.broadcast(stats)).withColumn(value, (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_mean", "_var")


def kl_penalty(lp: Name, ref: Name, kind: str = "k1") -> Column:
    """Per-token estimate of the divergence: k1, abs, k2 or k3."""

    def one(a: Column, b: Column) -> Column:
        d = a - b
        if kind in ("k1", "kl"):
            return d
        if kind == "abs":
            return F.abs(d)
        if kind in ("k2", "mse"):
            return 0.5 * d * d
        if kind in ("k3", "low_var_kl"):
            back = clip(-d, -20.0, 20.0)
            return clip(F.exp(back) - back - 1, -10.0, 10.0)
        raise ValueError(f"unknown estimator {kind}")

    return F.zip_with(_c(lp), _c(ref), one)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def first_eos_mask(ids: Name, eos: list[int]) -> Column:
    """1 up to and including the first end token."""
    place = F.least(*[F.when(F.array_position(_c(ids), e) > 0, F.array_position(_c(ids), e)).otherwise(F.lit(1 << 40)) for e in eos]) if len(eos) > 1 else F.when(F.array_position(_c(ids), eos[0]) > 0, F.array_position(_c(ids), eos[0])).otherwise(F.lit(1 << 40))
    return let(place, lambda p: F.transform(_c(ids), lambda _, i: (i < p).cast("int")))


def tail_mask(mask: Name, n: int) -> Column:
    """The last ``n`` entries: the response part of an attention mask."""
    return F.when(F.size(_c(mask)) <= n, _c(mask)).otherwise(F.slice(_c(mask), -n, n))


def pad_left(x: Name, length: int, value) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(_c(x)), F.lit(0))), _c(x))


def pad_right(x: Name, length: int, value) -> Column:
    return F.concat(_c(x), F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(_c(x)), F.lit(0))))


def truncate(x: Name, length: int, side: str = "right") -> Column:
    """Cut an array to ``length``: keep its end (left), its start (right), or both ends (middle)."""
    x = _c(x)
    if side == "left":
        cut = F.slice(x, F.greatest(F.size(x) - length, F.lit(0)) + 1, F.lit(length))
    elif side == "right":
        cut = F.slice(x, 1, length)
    elif side == "middle":
        head = length // 2
        cut = F.concat(F.slice(x, 1, head), F.slice(x, F.greatest(F.size(x) - (length - head), F.lit(0)) + 1, F.lit(length - head)))
    elif side == "error":
        return F.when(F.size(x) > length, F.raise_error(F.lit(f"a sequence is longer than {length}"))).otherwise(x)
    else:
        raise ValueError(f"unknown side {side}")
    return F.when(F.size(x) > length, cut).otherwise(x)


def strip_left_pad(ids: Name, mask: Name) -> Column:
    n = F.aggregate(_c(mask), F.lit(0), lambda a, m: a + m.cast("int"))
    return F.slice(_c(ids), F.size(_c(ids)) - n + 1, n)


def position_ids(mask: Name) -> Column:
    return F.transform(_c(mask), lambda m, i: i * m.cast("int"))


def place_terminal(reward: Name, mask: Name) -> Column:
    """Zeros but for the reward at the last counted token (index of the mask's sum less one)."""
    n = F.aggregate(_c(mask), F.lit(0), lambda a, m: a + m.cast("int"))
    return let(n, lambda k: F.transform(_c(mask), lambda _, i: F.when(i == k - 1, _c(reward).cast("double")).otherwise(0.0)))


def affine_tails(cells: Column) -> Column:
    """For cells ``f, a`` of x[t] = a[t] + f[t] * x[t + 1], each cell joined with all behind it.

    Two cells join to (f * f', a + f * a'), which is associative, so the reach of every cell
    doubles in each pass: n log n steps for n cells, and no array grows by appending. Behind
    the end x is 0, so ``a`` of the result is x; ``f`` is what a value behind the end counts.
    """
    shifts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda d: d < F.size(cells))

    def doubled(reach: Column, d: Column) -> Column:
        joined = lambda c, o: F.struct((c["f"] * F.coalesce(o["f"], F.lit(1.0))).alias("f"), (c["a"] + c["f"] * F.coalesce(o["a"], F.lit(0.0))).alias("a"))
        return F.transform(reach, lambda c, i: joined(c, F.get(reach, i + d)))

    return F.aggregate(shifts, cells, doubled)


def _cells(factor: Column, addend: Column) -> Column:
    return F.struct(factor.cast("double").alias("f"), addend.cast("double").alias("a"))


def affine_scan(cells: Column) -> Column:
    """x[t] = a[t] + f[t] * x[t + 1] for cells ``f, a``, from the end of a sequence."""
    return F.transform(let(cells, affine_tails), lambda c: c["a"])


def affine_scan_segments(segments: DataFrame, cells: str, seq: str = "seq", segment: str = "segment", out: str = "x") -> DataFrame:
    """``affine_scan`` of sequences that lie in several rows, in order of ``segment``: a sequence may be longer than a row holds.

    Every segment is scanned for itself; only its joined cell, two numbers, meets those of the
    other segments of its sequence, whose scan gives what each segment's end goes on with.
    """
    scanned = segments.withColumn("_tails", let(F.col(cells), affine_tails))
    first = scanned.select(seq, F.struct(segment, F.coalesce(F.get("_tails", F.lit(0))["f"], F.lit(1.0)).alias("f"), F.coalesce(F.get("_tails", F.lit(0))["a"], F.lit(0.0)).alias("a")).alias("c"))
    whole = first.groupBy(seq).agg(F.sort_array(F.collect_list("c")).alias("_s"))
    starts = affine_scan(F.transform("_s", lambda c: _cells(c["f"], c["a"])))
    behind = whole.select(seq, "_s", starts.alias("_x")).select(seq, F.posexplode("_s").alias("_i", "_c"), "_x").select(seq, F.col("_c")[segment].alias(segment), F.coalesce(F.get("_x", F.col("_i") + 1), F.lit(0.0)).alias("_behind"))
    return scanned.join(behind, [seq, segment]).withColumn(out, F.transform("_tails", lambda c: c["a"] + c["f"] * F.col("_behind"))).drop("_tails", "_behind")


def reverse_scan(values: Name, mask: Name, gamma: float, reset: bool) -> Column:
    """Discounted sums from each token to the end; with ``reset`` a masked-out token ends what follows it."""
    kept = lambda i: F.lit(gamma) * F.coalesce(F.get(_c(mask), i + 1).cast("double"), F.lit(0.0)) if reset else F.lit(gamma)
    return affine_scan(F.transform(_c(values), lambda x, i: _cells(kept(i), x)))


def gae(rewards: Name, values: Name, mask: Name, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates; a masked-out token passes on what follows it unchanged.

    Two scans: the value of the next token that counts, and the estimates.
    """
    following = affine_scan(F.zip_with(_c(values), _c(mask), lambda v, m: F.when(m == 0, _cells(F.lit(1.0), F.lit(0.0))).otherwise(_cells(1 - m, v * m))))

    def estimates(known: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            m = c["m"].cast("double")
            delta = c["r"] + gamma * F.coalesce(F.get(known, i + 1), F.lit(0.0)) - c["v"]
            return F.when(m == 0, _cells(F.lit(1.0), F.lit(0.0))).otherwise(_cells(m * gamma * lam + 1 - m, m * delta))

        return affine_scan(F.transform(F.arrays_zip(_c(rewards).alias("r"), _c(values).alias("v"), _c(mask).alias("m")), cell))

    return let(following, estimates)


def logsumexp(logits: Name) -> Column:
    return let(F.array_max(_c(logits)).cast("double"), lambda top: top + F.log(F.aggregate(_c(logits), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))))


def entropy(logits: Name) -> Column:
    """Entropy of the softmax of a row of logits."""
    return let(logsumexp(logits), lambda z: z - F.aggregate(_c(logits), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - z) * x.cast("double")))


def log_prob(logits: Name, index: Name) -> Column:
    """Log-probability of the entry at ``index`` (from 0)."""
    return F.get(_c(logits), _c(index)).cast("double") - logsumexp(logits)


def role_mask(roles: Name, lengths: Name, trained: str = "assistant") -> Column:
    """Loss mask of a conversation: 1 for each token of the trained role's turns."""
    return F.flatten(F.zip_with(_c(roles), _c(lengths), lambda r, n: F.array_repeat((r == trained).cast("int"), n)))


def sequences(tokens: DataFrame, columns: list[str], key: str = "seq", order: str = "t") -> DataFrame:
    """Token rows as one row of aligned arrays for each sequence."""
    cell = F.struct(order, *columns)
    gathered = tokens.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    part = lambda n: F.transform("_cells", lambda c: c[n])
    return gathered.select(key, *[part(n).alias(n) for n in columns])


def rows(arrays: DataFrame, columns: list[str], keep: list[str], order: str = "t") -> DataFrame:
    """Aligned arrays as token rows, positions from 1."""
    return arrays.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_cell")).select(*keep, (F.col("_i") + 1).cast("long").alias(order), *[F.col("_cell")[n].alias(n) for n in columns])


def number_tokens(rows_: DataFrame, key: str, order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))
