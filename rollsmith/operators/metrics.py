"""Metrics: summaries, grouping sets, correlations, histograms, validation and text statistics."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from rollsmith.functions.tokens import let
from rollsmith.operators.ranking import group_quantiles
from rollsmith.operators.votes import majority_expected


def reward_summary(df: DataFrame, reward: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, population deviation, ends, deciles of interest, and the zeros and perfect ones."""
    r = F.col(reward)
    names = ["p10", "p25", "p50", "p75", "p90"]
    found = df.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("least"), F.max(r).alias("most"),
        F.count_if(r == 0).alias("zeros"), F.avg((r == 0).cast("double")).alias("zero_ratio"), F.avg((r == 1).cast("double")).alias("perfect_ratio"),
    )
    q = group_quantiles(df, list(by), reward, [0.1, 0.25, 0.5, 0.75, 0.9], "_q")
    q = q.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_q")
    same = F.lit(True)
    for b in by:
        same = same & found[b].eqNullSafe(q[f"_by_{b}"])
    both = found.join(q, same, "left")
    return both.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(names)}).drop("_q", *[f"_by_{b}" for b in by])


def round_record(df: DataFrame, reward: str, weight: str, length: str, kept: str, by: list[str]) -> DataFrame:
    """The record of a round: reward and weight statistics, and what the trim left."""
    w = F.col(weight)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col(kept)).alias("rows_kept"), F.avg(reward).alias("mean_reward"), F.avg((w > 0).cast("double")).alias("positive_ratio"),
        F.avg((w < 0).cast("double")).alias("negative_ratio"), F.max(length).alias("longest"), F.max(F.when(F.col(kept), F.col(length))).alias("longest_kept"),
        F.avg(F.when(F.col(kept), (F.col(reward) == 1).cast("double"))).alias("perfect_ratio_after_trim"),
    )


def turn_statistics(df: DataFrame, turns: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(turns).alias("n"), F.median(turns).alias("median"), F.percentile(turns, 0.95).alias("p95"), F.max(turns).alias("most"), F.avg(turns).alias("mean"))


def threshold_rollup(df: DataFrame, value: str, thresholds: list[float], levels: list[str]) -> DataFrame:
    """How many rows reach each threshold, with subtotals for every level and in all."""
    counts = [F.count_if(F.col(value) >= t).alias(f"at_{i}") for i, t in enumerate(thresholds)]
    found = df.rollup(*levels).agg(F.count("*").alias("n"), *counts)
    return found.withColumns({f"pct_{i}": F.col(f"at_{i}") * 100.0 / F.col("n") for i in range(len(thresholds))})


def grouped_statistics(df: DataFrame, by: list[str], columns: list[str], digits: int = 3) -> DataFrame:
    """Mean, sample deviation and ends of columns for each group; names are joined, halves round to even."""
    aggregates = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    found = df.groupBy(*by).agg(F.count("*").alias("count"), *aggregates)
    return found.withColumns({f"{c}_{n}": F.bround(f"{c}_{n}", digits) for c in columns for n in ("mean", "std")})


def phases(df: DataFrame, round_: str, out: str = "phase") -> DataFrame:
    """Early, middle or late: thirds of the largest round."""
    top = df.agg(F.max(round_).alias("_top"))
    r = F.col(round_)
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(r <= F.col("_top") / 3, "early").when(r <= 2 * F.col("_top") / 3, "middle").otherwise("late")).drop("_top")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def dense_histogram(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Counts of every whole number in a range, zeros included, in percent of all rows."""
    counts = df.groupBy(F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    grid = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "bucket")
    joined = grid.join(counts, F.col("bucket") == F.col("_v"), "left").crossJoin(F.broadcast(total))
    return joined.select("bucket", F.coalesce("_n", F.lit(0)).alias("n"), (F.coalesce("_n", F.lit(0)) * 100.0 / F.col("_total")).alias("pct"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null where a column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upper triangle of the correlation matrix, one row a pair, in one aggregation over complete pairs."""
    one = lambda a, b: correlation(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    pairs = list(combinations(columns, 2))
    found = df.agg(*[one(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def strongest_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most positive and the ``n`` most negative pairs."""
    top = pairs.where("r > 0").orderBy(F.col("r").desc(), "a", "b").limit(n).withColumn("sign", F.lit("positive"))
    return top.unionByName(pairs.where("r < 0").orderBy("r", "a", "b").limit(n).withColumn("sign", F.lit("negative")))


def timing_split(df: DataFrame, turns: str, length: str) -> DataFrame:
    """How many marked turns lie in a conversation's first and second half, on average."""
    half = F.col(length) / 2
    early = F.size(F.filter(turns, lambda t: t < half))
    return df.where(F.col(length) > 0).select(early.alias("early"), (F.size(turns) - early).alias("late")).agg(F.avg("early").alias("early"), F.avg("late").alias("late"))


def costs(df: DataFrame, experiment: str, model: str, cost: str) -> DataFrame:
    """Costs and calls for each experiment and model, experiment, model, and in all."""
    spark = df.sparkSession
    sets = df.select(F.col(experiment).alias("experiment"), F.col(model).alias("model"), F.col(cost).alias("cost"))
    return spark.sql("SELECT experiment, model, grouping_id(experiment, model) AS level, count(*) AS calls, sum(cost) AS cost FROM {rows} GROUP BY GROUPING SETS ((experiment, model), (experiment), (model), ())", rows=sets)


def mean_of_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """For each source the mean over its rows of each row's mean score."""
    return df.groupBy(source, row).agg(F.avg(score).alias("_m")).groupBy(source).agg(F.avg("_m").alias("score"), F.count("*").alias("rows"))


def sample_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    out = []
    k = 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The table dealt by keys, about ``rows`` rows a task, so that what a task holds does not grow with the table; up to 200 tasks, which Spark deals without sorting."""
    tasks = -(-df.count() // rows)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(tasks, 200)), *keys)


def _placed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add each group's size, and of each value how many are below it and up to it: one window, so one sort."""
    w = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"_n": F.count("*").over(whole), "_upto": F.count("*").over(upto), "_below": F.rank().over(w) - 1})


def _best_worst(placed: DataFrame, group: list[str], value: str, k: Column) -> DataFrame:
    n, same, v = F.col("_n"), F.col("_upto") - F.col("_below"), F.col(value)
    upto, below = F.col("_upto") / n, F.col("_below") / n
    best = (F.pow(upto, k) - F.pow(below, k)) / same
    worst = (F.pow(1 - below, k) - F.pow(1 - upto, k)) / same
    found = placed.withColumn("_b", best).withColumn("_w", worst).groupBy(*group).agg(
        F.sum(v * F.col("_b")).alias("best_mean"), F.sum(v * v * F.col("_b")).alias("_b2"), F.sum(v * F.col("_w")).alias("worst_mean"), F.sum(v * v * F.col("_w")).alias("_w2")
    )
    std = lambda m, s: F.sqrt(F.greatest(F.col(s) - F.col(m) * F.col(m), F.lit(0.0)))
    return found.withColumn("best_std", std("best_mean", "_b2")).withColumn("worst_std", std("worst_mean", "_w2")).drop("_b2", "_w2")


def best_worst(df: DataFrame, group: list[str], value: str, n: Column | str) -> DataFrame:
    """Expected best and worst of ``n`` draws with replacement from each group's values, and their deviations.

    The distribution of the best of n draws is known from the empirical distribution
    function, so nothing is drawn; a thousand draws converge to these figures.
    """
    return _best_worst(_placed(df, group, value), group, value, F.col(n) if isinstance(n, str) else n)


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str, *, vote: str | None = None, order: str | None = None, draws: int | None = None, seed: int = 42) -> DataFrame:
    """``source, metric, score``: mean@N, std@N, best@n and worst@n of each prompt, averaged over prompts.

    With a column ``vote``, the majority's value in n draws as well (maj@n), exactly from the
    counts of votes; or drawn ``draws`` times, seeded, where ``order`` tells answers apart.
    """
    group = [source, prompt]
    rows = dealt(df.select(*group, value), group, 500_000)
    base = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    sizes = F.concat(F.expr("filter(transform(sequence(1, 20), k -> cast(pow(2, k) as bigint)), k -> k < _n)"), F.array("_n"))
    drawn = _best_worst(_placed(rows, group, value).where("_n > 1").withColumn("k", F.explode(sizes)), [*group, "k"], value, F.col("k"))
    name = lambda kind, k, stat: F.concat(F.lit(kind + "@"), k.cast("string"), F.lit(stat))
    simple = base.select(*group, F.explode(F.array(F.struct(name("mean", F.col("n"), "").alias("metric"), F.col("mean").alias("score")), F.struct(name("std", F.col("n"), "").alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("score")))).alias("m"))
    of = lambda rows, kinds: rows.select(*group, F.explode(F.array(*[F.struct(name(a, F.col("k"), f"/{b}").alias("metric"), F.col(f"{a}_{b}").alias("score")) for a in kinds for b in ("mean", "std")])).alias("m"))
    found = simple.union(of(drawn, ("best", "worst")))
    if vote:
        majority = majority_draws(df, group, value, vote, order or value, draws=draws, seed=seed) if draws else majority_expected(df, group, value, vote)
        found = found.union(of(majority, ("maj",)))
    return found.select(source, "m.*").where("score is not null").groupBy(source, "metric").agg(F.avg("score").alias("score"))


#: Positions drawn at once; draws of up to a sixteenth of it are kept, as groups of a size share them.
BLOCK = 1 << 20


@functools.lru_cache(64)
def _kept(size: int, n: int, draws: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, size, (draws, n))


def _positions(size: int, n: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """Positions of each draw of ``n`` of ``size`` answers, some draws at a time: the sequence of ``numpy.random.choice``."""
    if draws * n <= BLOCK // 16:
        yield _kept(size, n, draws, seed)
        return
    state, most = np.random.RandomState(seed), max(1, BLOCK // n)
    for done in range(0, draws, most):
        yield state.randint(0, size, (min(most, draws - done), n))


def _resampled(values: np.ndarray, votes: np.ndarray | None, n: int, draws: int, seed: int) -> np.ndarray:
    """Best, worst and majority's value of each draw of ``n`` answers, in numpy's own sequence; a tied vote (numbered from 0) goes to the one drawn first."""
    out, done = np.full((draws, 3), np.nan), 0
    for at in _positions(len(values), n, draws, seed):
        drawn, rows = values[at], out[done : done + len(at)]
        done += len(at)
        rows[:, 0], rows[:, 1] = drawn.max(axis=1), drawn.min(axis=1)
        if votes is not None:
            kinds = int(votes.max()) + 1
            cells = votes[at] + kinds * np.arange(len(at))[:, None]
            counts = np.bincount(cells.ravel(), minlength=len(at) * kinds).reshape(-1, kinds)
            first = np.full(counts.size, n)
            first[cells[:, ::-1].ravel()] = np.tile(np.arange(n)[::-1], len(at))
            won = np.where(counts == counts.max(axis=1, keepdims=True), first.reshape(counts.shape), n).min(axis=1)
            rows[:, 2] = drawn[np.arange(len(at)), won]
    return out


def _groups_resampled(df: DataFrame, group: list[str], value: str, vote: str | None, order: str, one: Callable[[np.ndarray, np.ndarray | None], list[tuple]], names: list[str]) -> DataFrame:
    """What ``one`` gives for each group's values, in order, and their votes' numbers. Drawing is what costs, so rows are dealt by group to all tasks."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"), (F.col(vote) if vote else F.lit(None)).cast("string").alias("vote"))
    columns = list(dict.fromkeys([*group, value, *([vote] if vote else []), order]))
    cells = dealt(df.select(*columns), group, 20_000).groupBy(*group).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_cells")
            ends, flat = lists.offsets.to_numpy(), lists.values
            values = flat.field("value").to_numpy(zero_copy_only=False)
            votes = flat.field("vote").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if vote else None
            of, rows = [], []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                found = one(values[a:b], np.unique(votes[a:b], return_inverse=True)[1] if vote else None)
                of += [i] * len(found)
                rows += found
            keys = [batch.column(g).take(pa.array(of, pa.int64())) for g in group]
            stats = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64() if name == "k" else pa.float64()) for name, c in zip(names, stats))], [*group, *names])

    shape = StructType([StructField(g, kinds[g]) for g in group] + [StructField(n, LongType() if n == "k" else DoubleType()) for n in names])
    return cells.mapInArrow(run, shape)


def majority_draws(df: DataFrame, group: list[str], value: str, vote: str, order: str, *, draws: int = 1000, seed: int = 42) -> DataFrame:
    """``group, k, maj_mean, maj_std`` for k = 2, 4, 8, ... below each group's number of answers, and that number.

    A group is the answers to one prompt and is resampled whole.
    """

    def one(x: np.ndarray, votes: np.ndarray) -> list[tuple]:
        sizes = [2**e for e in range(1, 21) if 2**e < len(x)] + [len(x)] * (len(x) > 1)
        return [(k, d.mean(), d.std()) for k in sizes for d in [_resampled(x, votes, k, draws, seed)[:, 2]]]

    return _groups_resampled(df, group, value, vote, order, one, ["k", "maj_mean", "maj_std"])


def bootstrap(df: DataFrame, group: str, value: str, n: int, *, draws: int = 1000, seed: int = 42, vote: str | None = None, order: str | None = None) -> DataFrame:
    """Mean and deviation over seeded draws of the best, the worst and the majority's value of each group.

    A group is the answers to one prompt; it is resampled whole, in numpy's own sequence.
    """

    def one(x: np.ndarray, votes: np.ndarray | None) -> list[tuple]:
        found = _resampled(x, votes, n, draws, seed)
        return [tuple(f(found[:, i]) if vote or i < 2 else None for i in range(3) for f in (np.mean, np.std))]

    return _groups_resampled(df, [group], value, vote, order or value, one, [f"{a}_{b}" for a in ("best", "worst", "maj") for b in ("mean", "std")])


def majority_value(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """The first value of the most frequent vote; ties go to the vote seen first."""
    per = df.groupBy(*group, vote).agg(F.count("*").alias("_n"), F.min(F.struct(order, value)).alias("_first"))
    w = Window.partitionBy(*group).orderBy(F.col("_n").desc(), F.col("_first"))
    return per.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*group, F.col(vote).alias("vote"), F.col("_first")[value].alias("value"), F.col("_n").alias("votes"))


def reduce_by_name(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Maximum, minimum or mean, as the metric's name says; max goes before min."""
    by = F.when(F.contains(F.col(metric), F.lit("max")), F.max(value)).when(F.contains(F.col(metric), F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(metric).agg(by.alias("value"))


def batch_metrics(sequences: DataFrame, tokens: DataFrame, max_length: int) -> DataFrame:
    """Sequence scores, masked token advantages, returns and values, explained variance, and lengths, as one row."""
    m = F.col("mask") > 0
    kept = lambda c: F.when(m, F.col(c))
    stats = [f(kept(c)).alias(f"{c}_{n}") for c in ("advantage", "returns", "value") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    gap = F.when(m, F.col("returns") - F.col("value"))
    token = tokens.agg(*stats, (1 - F.var_samp(gap) / (F.var_samp(kept("returns")) + 1e-5)).alias("explained_variance"))
    sequence = sequences.agg(
        *[f("score").alias(f"score_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))], *[f("length").alias(f"length_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))],
        F.avg((F.col("length") == max_length).cast("double")).alias("clip_ratio"),
    )
    return sequence.crossJoin(token)


def timing_per_token(timings: DataFrame, response_tokens: int | Column, all_tokens: int | Column) -> DataFrame:
    """Milliseconds a token for each stage: generation by response tokens, all else by all tokens."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    n = F.when(F.col("stage") == "gen", lit(response_tokens)).otherwise(lit(all_tokens))
    return timings.withColumn("ms_per_token", F.col("seconds") * 1000 / n)


def throughput(df: DataFrame, tokens: str, seconds: str, devices: int) -> DataFrame:
    return df.withColumn("throughput", F.try_divide(F.col(tokens), F.col(seconds) * devices))


def slowest(df: DataFrame, parts: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row whose times add up to most (the first of several), with its columns."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("total", total).orderBy(F.col("total").desc(), order).limit(1).select(order, "total", *parts, *columns)


def masked_statistics(df: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """Mean, ends and sample deviation, and the masked mean, by partial sums."""
    if mask:
        return df.agg(F.try_divide(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("mean"))
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"), F.stddev_samp(value).alias("std"))


def probability_gap(tokens: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Largest, mean and deviation of the gap between two probabilities, over counted tokens."""
    gap = F.abs(F.exp(a) - F.exp(b))
    return tokens.where(F.col(mask) > 0).agg(F.max(gap).alias("most"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"))


def ngrams(words: Column, n: int) -> Column:
    """The runs of ``n`` words of an array, joined by blanks: the array against itself, shifted."""

    def shifted(w: Column) -> Column:
        tails = [F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - n + 1, F.lit(0))) for k in range(n)]
        out = tails[0]
        for tail in tails[1:]:
            out = F.zip_with(out, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return let(words, lambda w: F.when(F.size(w) >= n, shifted(w)).otherwise(F.expr("cast(array() as array<string>)")))


#: Words that a task takes up at once, and parts that runs of words are dealt to.
WORDS, PARTS = 1 << 21, 1 << 10

_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f\x0b", dtype=np.uint8))
_BYTES = np.random.default_rng(0).integers(0, 1 << 63, 256, dtype=np.uint64)


def _packs(batches: Iterator[pa.RecordBatch], words: str, keys: list[str] = (), limit: int = 0) -> Iterator[pa.Table]:
    """The rows in tables of about ``WORDS`` words, or ``limit``; where ``keys`` are given, neighbours alike in them stay together."""
    held, size, limit = [], 0, limit or WORDS
    for batch in batches:
        ends = np.cumsum(_size(batch.column(words)))
        start, before = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size < limit:
                continue
            table, cut = pa.Table.from_batches(held).combine_chunks(), None
            if keys:
                last = np.flatnonzero(np.diff(_numbered(table, keys)[0]))
                cut = int(last[-1]) + 1 if len(last) else 0
            if cut != 0:
                yield table.slice(0, cut)
            held = [] if cut is None else table.slice(cut).to_batches()
            size = sum(int(_size(b.column(words)).sum()) for b in held) if cut else 0  # one key alone: as much again, then look once more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _size(column: pa.Array) -> np.ndarray:
    """Words of each list; of texts or packed lengths, about as many."""
    lists = pa.types.is_list(column.type)
    return np.asarray(pc.fill_null(pc.list_value_length(column) if lists else pc.binary_length(column), 0), dtype=np.int64) // (1 if lists else 4)


def _lists(column: pa.ChunkedArray) -> pa.Array:
    """Lists of words; texts are cut at white space, as ``functions.text.words`` has it."""
    lists = _whole(column)
    if pa.types.is_list(lists.type):
        return lists
    texts = lists.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kept = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a word, or a blank after one, begins
    edge[1:-1] = kept[1:] != kept[:-1]
    edge[ends] = True  # no word goes on from one text to the next
    edge = np.flatnonzero(edge)
    begins = edge[:-1][kept[edge[:-1]]]
    at = np.append(0, np.cumsum(np.diff(edge)[kept[edge[:-1]]])).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(begins), pa.py_buffer(at), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, ends).astype(np.int32)), flat)


def _numbered(table: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's values of ``by``, and a row of each number."""
    number = np.zeros(len(table), dtype=np.int64)
    for b in by:
        coded = _whole(table[b]).dictionary_encode(null_encoding="encode")
        number = np.unique(number, return_inverse=True)[1] * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, first


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Runs:
    """The runs of ``n`` words of lists: the ``row`` and the ``number`` of each, equal for equal words; numbers times ``most`` fit a long."""

    def __init__(self, lists: pa.Array, n: int, most: int):
        sizes = _size(lists)
        counts = np.maximum(sizes - n + 1, 0)
        self.row = np.repeat(np.arange(len(sizes)), counts)
        self.at = np.arange(len(self.row)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
        coded = pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
        self.n, self.words, self.ids, self.base = n, coded.dictionary, coded.indices.to_numpy(), max(len(coded.dictionary), 1)
        self.plain = self.base**n * most < 1 << 62
        self.number = self.ids[self.at].astype(np.int64)
        for k in range(1, n):
            self.number = self.number * self.base + self.ids[self.at + k]
            if not self.plain:
                _, self.first, self.number = np.unique(self.number, return_index=True, return_inverse=True)

    def spelled(self, number: np.ndarray) -> list[np.ndarray]:
        """The numbers of the words of runs."""
        if self.plain:
            return [number // self.base ** (self.n - 1 - k) % self.base for k in range(self.n)]
        return [self.ids[self.at[self.first[number]] + k] for k in range(self.n)]

    def joined(self, spelled: list[np.ndarray]) -> pa.Array:
        """Runs as strings; null if a word is."""
        return pc.binary_join_element_wise(*[self.words.take(pa.array(k)) for k in spelled], " ", null_handling="emit_null")

    def part(self, spelled: list[np.ndarray]) -> np.ndarray:
        """The part of each run, by the bytes of its string: the same in all tasks, however they are cut into words."""
        words = pc.fill_null(self.words, "").cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)], dtype=np.uint64))
        word = sums[ends[1:]] - sums[ends[:-1]]
        part = (sum(word[k] for k in spelled) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PARTS
        if self.words.null_count:  # null runs are one
            missing = np.asarray(self.words.is_null())
            part[np.logical_or.reduce([missing[k] for k in spelled])] = 0
        return part


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each different number of an ordered array begins."""
    return np.flatnonzero(np.append(len(ordered) > 0, ordered[1:] != ordered[:-1])[: len(ordered)])


def _dealt(table: pa.Table, by: list[str], group: np.ndarray, first: np.ndarray, part: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns of one row for each group and part; the order that brings what belongs there together, and where each row begins in it."""
    number = part * max(len(first), 1) + group
    order = np.argsort(number)
    starts = _starts(number[order])
    lead = order[starts]
    return {b: table[b].take(pa.array(first[group[lead]])) for b in by} | {"_part": pa.array(part[lead].astype(np.int32))}, order, np.append(starts, len(order))


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Numbers as one binary for each of the stretches that begin at ``starts``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(strings: pa.Array, starts: np.ndarray) -> dict[str, pa.Array]:
    """Strings as two binaries for each stretch: their bytes, and their lengths (-1: null)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(strings), -1), dtype=np.int32)
    ends = np.append(0, np.cumsum(np.maximum(lengths, 0), dtype=np.int64))
    whole = pc.fill_null(strings, "")
    data = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends[starts].astype(np.int32)), whole.buffers()[2] or pa.py_buffer(b"")])
    return {"_bytes": data, "_lengths": _blobs(lengths, starts)}


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _unpacked(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The strings of ``_packed`` in one array, and how many each row had."""
    lengths = _numbers(table["_lengths"], np.int32)
    ends = np.append(0, np.cumsum(np.maximum(lengths, 0), dtype=np.int64))
    missing = pa.py_buffer(np.packbits(lengths >= 0, bitorder="little")) if (lengths < 0).any() else None
    strings = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(b"".join(table["_bytes"].to_pylist())), missing)
    return strings, np.asarray(pc.binary_length(table["_lengths"]), dtype=np.int64) // 4


_PACKED = [StructField("_part", IntegerType()), StructField("_bytes", BinaryType()), StructField("_lengths", BinaryType())]


def _kinds(df: DataFrame, names: list[str]) -> list[StructField]:
    return [StructField(b, df.schema[b].dataType) for b in names]


def _batches(columns: dict, rows: int = 256) -> list[pa.RecordBatch]:
    return pa.table(columns).combine_chunks().to_batches(max_chunksize=rows)


def distinct_n(df: DataFrame, by: list[str], words: str, n: int) -> DataFrame:
    """Distinct runs of ``n`` words over all runs; ``words`` are arrays, or texts to be cut at white space.

    A task numbers the words it meets and so finds the different runs among ``WORDS`` at a time; it passes
    each of these on once, to one of ``PARTS``, with others in one row, and the strings of a part are counted together.
    """
    by = list(by)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _packs(batches, words):
            group, first = _numbered(table, by)
            runs = _Runs(_lists(table[words]), n, len(first))
            number = np.sort(runs.number * len(first) + group[runs.row])
            starts = _starts(number)
            uses, (number, group) = np.diff(np.append(starts, len(number))), np.divmod(number[starts], len(first))
            spelled = runs.spelled(number)
            columns, order, starts = _dealt(table, by, group, first, runs.part(spelled))
            totals = np.diff(np.append(0, np.cumsum(uses[order]))[starts])
            yield from _batches(columns | _packed(runs.joined([k[order] for k in spelled]), starts) | {"_total": pa.array(totals)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _packs(batches, "_lengths", ["_part"], WORDS >> 2):
            group, first = _numbered(table, by)
            strings, many = _unpacked(table)
            number = np.sort(strings.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) * len(first) + np.repeat(group, many))
            unique = np.bincount(number[_starts(number)] % len(first), minlength=len(first))
            totals = np.bincount(group, table["_total"].to_numpy(), len(first)).astype(np.int64)
            yield from _batches({b: table[b].take(pa.array(first)) for b in by} | {"_unique": pa.array(unique), "_total": pa.array(totals)})

    kinds = _kinds(df, by)
    parts = df.select(*by, words).mapInArrow(find, StructType([*kinds, *_PACKED, StructField("_total", LongType())]))
    counts = parts.repartition("_part").sortWithinPartitions("_part").mapInArrow(count, StructType([*kinds, StructField("_unique", LongType()), StructField("_total", LongType())]))
    return counts.groupBy(*by).agg(F.coalesce(F.sum("_unique"), F.lit(0)).alias("unique"), F.sum("_total").alias("total")).withColumn("distinct_n", F.col("unique") / F.col("total"))


def self_bleu(df: DataFrame, by: list[str], key: str, words: str, n: int = 2) -> DataFrame:
    """Mean over texts of their n-gram precision, each gram clipped by its most frequent use in another text.

    ``words`` are arrays, or texts to be cut at white space; rows of one ``key`` are one text. Only the text that
    uses a gram most is clipped, to the second most frequent use. So a task, which has texts whole, passes on the two
    most frequent uses of each gram among ``WORDS``, however many texts hold it, packed as in ``distinct_n``; what
    is cut is taken off the texts' numbers of grams.
    """
    by = list(by)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _packs(batches, words, [*by, key]):
            group, first = _numbered(table, by)
            text, lead = _numbered(table, [*by, key])
            runs = _Runs(_lists(table[words]), n, len(lead))
            text_of = text[runs.row]
            group_of = group[lead]
            totals = np.bincount(text_of, minlength=len(lead))
            order = np.argsort(group_of, kind="stable")
            starts = np.append(_starts(group_of[order]), len(order))
            row = {b: table[b].take(pa.array(first)) for b in by} | {"_part": pa.array(np.arange(len(first), dtype=np.int32)), "_bytes": pa.nulls(len(first), pa.binary()), "_lengths": pa.nulls(len(first), pa.binary())}
            yield from _batches(row | {"_keys": _lists_of(table[key], lead[order], starts), "_most": _blobs(totals[order], starts), "_second": pa.nulls(len(first), pa.binary())})
            number = np.sort(runs.number * len(lead) + text_of)
            starts = _starts(number)
            uses, (number, text) = np.diff(np.append(starts, len(number))), np.divmod(number[starts], len(lead))
            top, second = _two(number, group_of[text], uses)
            spelled = runs.spelled(number[top])
            columns, order, starts = _dealt(table, by, group_of[text[top]], first, runs.part(spelled))
            packed = _packed(runs.joined([k[order] for k in spelled]), starts)
            top, second = top[order], second[order]
            yield from _batches(columns | packed | {"_keys": _lists_of(table[key], lead[text[top]], starts), "_most": _blobs(uses[top], starts), "_second": _blobs(second, starts)})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _packs(batches, "_lengths", ["_part"], WORDS >> 2):
            whole = table.filter(pc.is_null(table["_second"]))
            keys = pc.list_flatten(_whole(whole["_keys"]))
            at = pc.list_parent_indices(_whole(whole["_keys"]))
            runs = _numbers(whole["_most"], np.int64)
            yield from _batches({b: whole[b].take(at) for b in by} | {key: keys, "_runs": pa.array(runs), "_cut": pa.array(np.zeros_like(runs))}, 1 << 16)
            table = table.filter(pc.is_valid(table["_second"]))
            strings, many = _unpacked(table)
            most, seconds = _numbers(table["_most"], np.int64), _numbers(table["_second"], np.int64)
            row = np.repeat(np.arange(len(table)), many)
            top, second = _two(strings.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64), _numbered(table, by)[0][row], most)
            cut = most[top] - np.maximum(second, seconds[top])
            top, cut = top[cut > 0], cut[cut > 0]
            keys = pc.list_flatten(_whole(table["_keys"])).take(pa.array(top))
            yield from _batches({b: table[b].take(pa.array(row[top])) for b in by} | {key: keys, "_runs": pa.array(np.zeros_like(cut)), "_cut": pa.array(cut)}, 1 << 16)

    kinds, own = _kinds(df, by), df.schema[key].dataType
    parts = df.select(*by, key, words).repartition(*by, key).sortWithinPartitions(*by, key).mapInArrow(find, StructType([*kinds, *_PACKED, StructField("_keys", ArrayType(own)), StructField("_most", BinaryType()), StructField("_second", BinaryType())]))
    cuts = parts.repartition("_part").sortWithinPartitions("_part").mapInArrow(rank, StructType([*kinds, StructField(key, own), StructField("_runs", LongType()), StructField("_cut", LongType())]))
    per = cuts.groupBy(*by, key).agg(F.sum("_runs").alias("_total"), F.sum("_cut").alias("_cut")).where("_total > 0")
    per = per.withColumn("_p", (F.col("_total") - F.col("_cut")) / F.col("_total"))
    return per.groupBy(*by).agg(F.avg("_p").alias("self_bleu"), F.count("*").alias("texts"))


def _two(number: np.ndarray, group: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each number in each group, where its most uses are, and its second most (0 if there are none)."""
    groups, most = int(group.max(initial=0)) + 1, int(uses.max(initial=0)) + 1
    if int(number.max(initial=0)) * groups * most < 1 << 61:
        key = (number * groups + group) * most + (most - 1 - uses)
        order = np.argsort(key)
        starts = _starts(key[order] // most)
    else:
        order = np.lexsort((-uses, group, number))
        a, b = number[order], group[order]
        starts = np.flatnonzero(np.append(len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    more = np.diff(np.append(starts, len(order))) > 1
    second = np.zeros(len(starts), dtype=np.int64)
    second[more] = uses[order[starts[more] + 1]]
    return order[starts], second


def _lists_of(column: pa.ChunkedArray, rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _whole(column).take(pa.array(rows)))


def vocabulary(df: DataFrame, by: list[str], words: str) -> DataFrame:
    """Type-token ratio and vocabulary size, and mean and population deviation of lengths."""
    lengths = df.groupBy(*by).agg(F.avg(F.size(words)).alias("length_mean"), F.stddev_pop(F.size(words)).alias("length_std"))
    types = df.select(*by, F.explode(words).alias("_word")).groupBy(*by, "_word").agg(F.count("*").alias("_uses")).groupBy(*by).agg(F.count("*").alias("vocabulary"), F.sum("_uses").alias("tokens"))
    return lengths.join(types, by).withColumn("type_token_ratio", F.col("vocabulary") / F.col("tokens"))


def histogram_entropy(df: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """Entropy of an equal-width histogram whose last bin is closed; one value makes one bin."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    place = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / ((F.col("_high") - F.col("_low")) / bins)), F.lit(bins - 1)))
    counts = df.join(ends, by).groupBy(*by, place.alias("_bin")).agg((F.count("*") / F.first("_n")).alias("p"))
    return counts.groupBy(*by).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("entropy"))


def action_counts(df: DataFrame, text: str, by: list[str], actions: tuple[str, ...] = ("propose", "accept", "reject", "message")) -> DataFrame:
    """How often each action is the first named one, in order of precedence."""
    kind = F.when(F.lit(False), F.lit(""))
    for a in actions:
        kind = kind.when(F.contains(F.col(text), F.lit(f"[{a}]")), a)
    tagged = df.withColumn("_kind", kind)
    return tagged.groupBy(*by).agg(*[F.count_if(F.col("_kind") == a).alias(a) for a in actions])


def change_first_last(df: DataFrame, round_: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """Change in percent of values from the first to the last round (rounds are unique)."""
    change = lambda v: F.try_divide(F.max_by(v, round_) - F.min_by(v, round_), F.min_by(v, round_)) * 100
    return df.groupBy(*by).agg(*[change(v).alias(f"{v}_change_pct") for v in values])


def best_checkpoint(df: DataFrame, score: str, order: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), order).limit(1)


def first_known(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each group: every column's first known value in an explicit order."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"]
    return df.groupBy(*by).agg(*[first(c).alias(c) for c in columns])


def chunks(df: DataFrame, key: str, tokens: str, size: int, ranks: int, least: int = 2) -> DataFrame:
    """Token arrays cut into chunks of ``size``; chunks under ``least`` are dropped, and every rank takes each k-th."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(tokens, k * size + 1, F.lit(size)))
    cut = df.select(key, F.posexplode(F.filter(pieces, lambda p: F.size(p) >= least)).alias("chunk", "tokens"))
    return cut.withColumn("rank", F.col("chunk") % ranks)


def flops(df: DataFrame, length: str, parameters: float, layers: int, heads: int, head_size: int, by: list[str] = ()) -> DataFrame:
    """Training work by lengths: dense work by their sum, attention by the sum of their squares."""
    n = F.col(length).cast("double")
    return df.groupBy(*by).agg((6 * parameters * F.sum(n) + 12.0 * layers * heads * head_size * F.sum(n * n)).alias("flops"), F.sum(n).alias("tokens"))


def core_metrics(df: DataFrame, source: str, variable: str, metric: str, core: list[str]) -> DataFrame:
    """Names of validation metrics: those of the core variable at the largest n come first."""
    n = F.regexp_extract(metric, r"@(\d+)", 1).cast("int")
    largest = F.max(n).over(Window.partitionBy(source, variable))
    named = df.withColumn("_n", n).withColumn("_top", largest)
    is_core = F.col(variable).isin(core) & (F.col("_n") == F.col("_top")) & F.col(metric).rlike("^(mean|maj|best)@")
    return named.withColumn("name", F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), F.col(source), F.col(variable), F.col(metric))).drop("_n", "_top")
