"""Queries of the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators import metrics as M
from rollsmith.operators.filters import tokens_of
from rollsmith.operators.votes import majority_expected
from rollsmith.plans.advantage import token_rows
from rollsmith.plans.registry import TOKENS_SQL, Tables, query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


SUMMARY_SQL = """count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, min(r) AS least, max(r) AS most, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.25), 6) AS p25,
round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75, round(quantile_cont(r, 0.9), 6) AS p90, count(*) FILTER (r = 0) AS zeros, round(avg((r = 0)::INT), 6) AS zero_ratio, round(avg((r = 1)::INT), 6) AS perfect_ratio"""


@query("a1_reward_summary", f"SELECT {SUMMARY_SQL} FROM (SELECT l_tax / 0.08 AS r FROM lineitem)")
def a1(t: Tables) -> DataFrame:
    return rounded(M.reward_summary(t.lineitem.select((F.col("l_tax") / 0.08).alias("r")), "r"))


@query("a1_reward_summary_by_flag", f"SELECT l_returnflag, {SUMMARY_SQL} FROM (SELECT l_returnflag, l_tax / 0.08 AS r FROM lineitem) GROUP BY l_returnflag")
def a1b(t: Tables) -> DataFrame:
    return rounded(M.reward_summary(t.lineitem.select("l_returnflag", (F.col("l_tax") / 0.08).alias("r")), "r", ["l_returnflag"]))


@query("a2_round_record", """SELECT l_linestatus, count(*) AS rows, count(*) FILTER (k) AS rows_kept, round(avg(r), 6) AS mean_reward, round(avg((w > 0)::INT), 6) AS positive_ratio, round(avg((w < 0)::INT), 6) AS negative_ratio,
max(q) AS longest, max(q) FILTER (k) AS longest_kept, round(avg((r = 1)::INT) FILTER (k), 6) AS perfect_ratio_after_trim
FROM (SELECT l_linestatus, l_tax / 0.08 AS r, l_tax - 0.04 AS w, l_quantity AS q, l_quantity <= 45 AS k FROM lineitem) GROUP BY l_linestatus""")  # fmt: skip
def a2(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linestatus", (F.col("l_tax") / 0.08).alias("r"), (F.col("l_tax") - 0.04).alias("w"), F.col("l_quantity").alias("q"), (F.col("l_quantity") <= 45).alias("k"))
    return rounded(M.round_record(rows, "r", "w", "q", "k", ["l_linestatus"]))


@query("a3_turn_statistics", "SELECT count(n) AS n, round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def a3(t: Tables) -> DataFrame:
    return rounded(M.turn_statistics(t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "n"))


@query("a4_threshold_rollup", """SELECT event_type, day, count(*) AS n, count(*) FILTER (value >= 50) AS at_0, count(*) FILTER (value >= 90) AS at_1,
round(count(*) FILTER (value >= 50) * 100.0 / count(*), 6) AS pct_0, round(count(*) FILTER (value >= 90) * 100.0 / count(*), 6) AS pct_1 FROM (SELECT event_type, day(ts)::VARCHAR AS day, value FROM events) GROUP BY ROLLUP (event_type, day)""")  # fmt: skip
def a4(t: Tables) -> DataFrame:
    return rounded(M.threshold_rollup(t.events.select("event_type", F.dayofmonth("ts").cast("string").alias("day"), "value"), "value", [50, 90], ["event_type", "day"]))


@query("a5_grouped_statistics", """SELECT source, count(*) AS count, round_even(avg(n_chars), 3) AS n_chars_mean, round_even(stddev_samp(n_chars), 3) AS n_chars_std, min(n_chars) AS n_chars_min, max(n_chars) AS n_chars_max FROM documents GROUP BY source""")
def a5(t: Tables) -> DataFrame:
    return M.grouped_statistics(t.documents, ["source"], ["n_chars"])


@query("a6_phases", "SELECT phase, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, CASE WHEN d <= m / 3 THEN 'early' WHEN d <= 2 * m / 3 THEN 'middle' ELSE 'late' END AS phase FROM (SELECT value, day(ts) AS d, (SELECT max(day(ts)) FROM events) AS m FROM events)) GROUP BY phase")
def a6(t: Tables) -> DataFrame:
    return rounded(M.phases(t.events.select("value", F.dayofmonth("ts").alias("d")), "d").groupBy("phase").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("a7_crosstab", "SELECT turn, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY turn")
def a7(t: Tables) -> DataFrame:
    return M.crosstab(t.conversations, "turn", "role", ["user", "assistant"])


@query("a8_dense_histogram", "SELECT b AS bucket, count(conv_id) AS n, round(count(conv_id) * 100.0 / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS pct FROM (SELECT unnest(range(1, 17)) AS b) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON n = b GROUP BY b")
def a8(t: Tables) -> DataFrame:
    return rounded(M.dense_histogram(t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "n", 1, 16))


CORR_SQL = """(SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)"""
CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a9_correlations", f"SELECT a, b, round(r, 6) AS r FROM {CORR_SQL}")
def a9(t: Tables) -> DataFrame:
    return rounded(M.correlation_pairs(t.lineitem, CORR))


@query("a10_strongest_pairs", f"SELECT a, b, round(r, 6) AS r, sign FROM (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM {CORR_SQL} WHERE r <> 0) QUALIFY row_number() OVER (PARTITION BY sign ORDER BY abs(r) DESC, a, b) <= 2")
def a10(t: Tables) -> DataFrame:
    return rounded(M.strongest_pairs(M.correlation_pairs(t.lineitem, CORR), 2))


@query("a11_question_timing", """SELECT round(avg(e), 6) AS early, round(avg(n - e), 6) AS late FROM (SELECT count(*) FILTER (role = 'user' AND turn < len / 2) AS e, count(*) FILTER (role = 'user') AS n FROM (
SELECT *, count(*) OVER (PARTITION BY conv_id) AS len FROM conversations) GROUP BY conv_id)""")  # fmt: skip
def a11(t: Tables) -> DataFrame:
    per = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("turns"), F.count("*").alias("len"))
    return rounded(M.timing_split(per, "turns", "len"))


@query("a12_costs", """SELECT event_type AS experiment, (user_id % 7)::VARCHAR AS model, grouping_id(event_type, (user_id % 7)::VARCHAR) AS level, count(*) AS calls, round(sum(value), 6) AS cost
FROM events GROUP BY GROUPING SETS ((event_type, (user_id % 7)::VARCHAR), (event_type), ((user_id % 7)::VARCHAR), ())""")  # fmt: skip
def a12(t: Tables) -> DataFrame:
    return rounded(M.costs(t.events.select("event_type", (F.col("user_id") % 7).cast("string").alias("m"), "value"), "event_type", "m", "value"))


@query("a13_mean_of_means", "SELECT l_returnflag, round(avg(m), 6) AS score, count(*) AS rows FROM (SELECT l_returnflag, l_orderkey, avg(l_tax) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def a13(t: Tables) -> DataFrame:
    return rounded(M.mean_of_means(t.lineitem, "l_returnflag", "l_orderkey", "l_tax"))


#: The expected best and worst of k draws from the values of a group, from its distribution function.
BEST_SQL = """d AS (SELECT source, prompt, n, k, v, count(*) OVER (PARTITION BY source, prompt, k ORDER BY v RANGE UNBOUNDED PRECEDING) * 1.0 / n AS f, count(*) OVER (PARTITION BY source, prompt, k, v) AS s
  FROM (SELECT *, count(*) OVER (PARTITION BY source, prompt) AS n FROM x), LATERAL (SELECT unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32], lambda z: z < n), n))) AS k) WHERE n > 1),
e AS (SELECT source, prompt, k, sum(v * b) AS best, sum(v * v * b) AS best2, sum(v * w) AS worst, sum(v * v * w) AS worst2 FROM (
  SELECT *, (f ** k - (f - s * 1.0 / n) ** k) / s AS b, ((1 - f + s * 1.0 / n) ** k - (1 - f) ** k) / s AS w FROM d) GROUP BY ALL)"""


@query("a14_validation_metrics", f"""WITH x AS (SELECT l_returnflag AS source, l_orderkey AS prompt, l_quantity AS v FROM lineitem), {BEST_SQL},
g AS (SELECT source, prompt, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY ALL)
SELECT source, metric, round(avg(score), 5) AS score FROM (SELECT source, 'mean@' || n AS metric, m AS score FROM g UNION ALL SELECT source, 'std@' || n, s FROM g WHERE n > 1
UNION ALL SELECT source, 'best@' || k || '/mean', best FROM e UNION ALL SELECT source, 'best@' || k || '/std', sqrt(greatest(best2 - best * best, 0)) FROM e
UNION ALL SELECT source, 'worst@' || k || '/mean', worst FROM e UNION ALL SELECT source, 'worst@' || k || '/std', sqrt(greatest(worst2 - worst * worst, 0)) FROM e) GROUP BY ALL""")  # fmt: skip
def a14(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("prompt"), F.col("l_quantity").alias("v"))
    return rounded(M.validation_metrics(rows, "source", "prompt", "v"), 5)


@query("a14_majority_metrics")
def a14_majority(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("double").alias("v"), (F.col("conv_id") % 3).alias("source"))
    return rounded(M.validation_metrics(rows, "source", "conv_id", "v", vote="role", order="turn", draws=100), 5)


@query("a14_majority_exact", """WITH x AS (SELECT l_orderkey AS prompt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_returnflag AS vote, l_quantity AS v FROM lineitem),
three AS (SELECT a.prompt, 3 AS k, CASE WHEN b.vote = c.vote AND b.vote <> a.vote THEN b.v ELSE a.v END AS won FROM x a JOIN x b USING (prompt) JOIN x c USING (prompt)),
four AS (SELECT a.prompt, 4 AS k, CASE greatest((b.vote = a.vote)::INT + (c.vote = a.vote)::INT + (d.vote = a.vote)::INT, (c.vote = b.vote)::INT + (d.vote = b.vote)::INT, (d.vote = c.vote)::INT)
  WHEN (b.vote = a.vote)::INT + (c.vote = a.vote)::INT + (d.vote = a.vote)::INT THEN a.v WHEN (c.vote = b.vote)::INT + (d.vote = b.vote)::INT THEN b.v ELSE c.v END AS won
  FROM x a JOIN x b USING (prompt) JOIN x c USING (prompt) JOIN x d USING (prompt))
SELECT prompt, k::BIGINT AS k, round(avg(won), 9) AS maj_mean, round(stddev_pop(won), 4) AS maj_std FROM (SELECT * FROM three UNION ALL SELECT * FROM four) GROUP BY ALL""")  # fmt: skip
def a14_exact(t: Tables) -> DataFrame:
    """Every sequence of three and four draws from an order's lines is enumerated on the other side."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("prompt"), "l_returnflag", "l_quantity")
    return majority_expected(rows, ["prompt"], "l_quantity", "l_returnflag", [3, 4]).select("prompt", "k", F.round("maj_mean", 9).alias("maj_mean"), F.round("maj_std", 4).alias("maj_std"))


@query("a15_bootstrap")
def a15(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("double").alias("v"))
    return M.bootstrap(rows, "conv_id", "v", 4, draws=200, vote="role", order="turn")


@query("a16_majority_value", """SELECT conv_id, role AS vote, v AS value, n AS votes FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS f, arg_min(length(text), turn) AS v FROM conversations GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1""")  # fmt: skip
def a16(t: Tables) -> DataFrame:
    return M.majority_value(t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("v")), ["conv_id"], "role", "v", "turn")


@query("a17_reduce_by_name", "SELECT metric, round(CASE WHEN metric LIKE '%max%' THEN max(v) WHEN metric LIKE '%min%' THEN min(v) ELSE avg(v) END, 6) AS value FROM (SELECT ['max_', 'min_', 'mean_'][1 + event_id % 3] || event_type AS metric, value AS v FROM events) GROUP BY metric")
def a17(t: Tables) -> DataFrame:
    name = F.concat(F.element_at(F.array(F.lit("max_"), F.lit("min_"), F.lit("mean_")), (F.col("event_id") % 3 + 1).cast("int")), "event_type")
    return rounded(M.reduce_by_name(t.events.select(name.alias("metric"), "value"), "metric", "value"))


@query("a18_batch_metrics", f"""WITH {TOKENS_SQL}, k AS (SELECT seq, t, mask, value, reward - value AS advantage, reward AS returns FROM tok), s AS (SELECT seq, sum(reward * mask) AS score, sum(mask)::BIGINT AS length FROM tok GROUP BY seq)
SELECT * FROM (SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min, round(avg((length = 4)::INT), 6) AS clip_ratio FROM s),
(SELECT round(avg(advantage), 6) AS advantage_mean, round(max(advantage), 6) AS advantage_max, round(min(advantage), 6) AS advantage_min, round(avg(returns), 6) AS returns_mean, round(max(returns), 6) AS returns_max, round(min(returns), 6) AS returns_min,
round(avg(value), 6) AS value_mean, round(max(value), 6) AS value_max, round(min(value), 6) AS value_min, round(1 - var_samp(returns - value) / (var_samp(returns) + 1e-5), 6) AS explained_variance FROM k WHERE mask > 0)""")  # fmt: skip
def a18(t: Tables) -> DataFrame:
    tok = token_rows(t)
    tokens = tok.select("mask", "value", (F.col("reward") - F.col("value")).alias("advantage"), F.col("reward").alias("returns"))
    sequences = tok.groupBy("seq").agg(F.sum(F.col("reward") * F.col("mask")).alias("score"), F.sum("mask").alias("length"))
    return rounded(M.batch_metrics(sequences, tokens, 4))


@query("a19_timing_per_token", "SELECT stage, round(s * 1000 / CASE WHEN stage = 'gen' THEN r ELSE a END, 9) AS ms_per_token FROM (VALUES ('gen', 12.5), ('update', 30.0), ('ref', 4.25)) v(stage, s), (SELECT sum(n_chars) AS a, sum(n_chars) FILTER (lang = 'en') AS r FROM documents)")
def a19(t: Tables) -> DataFrame:
    timings = t.spark.createDataFrame([("gen", 12.5), ("update", 30.0), ("ref", 4.25)], "stage string, seconds double")
    sums = t.documents.agg(F.sum("n_chars").alias("a"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))).alias("r"))
    return rounded(M.timing_per_token(timings.crossJoin(F.broadcast(sums)), F.col("r"), F.col("a")).select("stage", "ms_per_token"), 9)


@query("a20_throughput", "SELECT source, round(sum(n_chars) / (count(*) * 0.01 * 8), 6) AS throughput FROM documents GROUP BY source")
def a20(t: Tables) -> DataFrame:
    per = t.documents.groupBy("source").agg(F.sum("n_chars").alias("tokens"), (F.count("*") * 0.01).cast("double").alias("seconds"))
    return rounded(M.throughput(per, "tokens", "seconds", 8).select("source", "throughput"))


@query("a21_slowest_sample", "SELECT event_id, round(value + user_id, 9) AS total, value, user_id, event_type FROM events ORDER BY value + user_id DESC, event_id LIMIT 1")
def a21(t: Tables) -> DataFrame:
    return rounded(M.slowest(t.events, ["value", "user_id"], "event_id", ["event_type"]), 9)


@query("a22_distributed_statistics", "SELECT round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most, min(l_extendedprice) AS least, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem")
def a22(t: Tables) -> DataFrame:
    return rounded(M.masked_statistics(t.lineitem, "l_extendedprice"), 4)


@query("a23_masked_mean", "SELECT round(sum(l_tax * (l_returnflag <> 'R')::INT) / sum((l_returnflag <> 'R')::INT), 9) AS mean FROM lineitem")
def a23(t: Tables) -> DataFrame:
    return rounded(M.masked_statistics(token_rows(t).select("value", "mask"), "value", "mask"), 9)


@query("a24_probability_gap", f"WITH {TOKENS_SQL} SELECT round(max(g), 9) AS most, round(avg(g), 9) AS mean, round(stddev_samp(g), 9) AS std FROM (SELECT abs(exp(old_lp) - exp(lp)) AS g FROM tok WHERE mask > 0)")
def a24(t: Tables) -> DataFrame:
    return rounded(M.probability_gap(token_rows(t), "old_lp", "lp", "mask"), 9)


#: Words of the documents, and their pairs.
WORDS_SQL = r"w AS (SELECT doc_id, lang, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS words FROM documents)"
GRAMS_SQL = WORDS_SQL + ", g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM w)"


def _words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", tokens_of(F.col("text")).alias("words"))


@query("a25_distinct_n", f"WITH {GRAMS_SQL} SELECT lang, count(DISTINCT g) AS \"unique\", count(*) AS total, round(count(DISTINCT g) / count(*), 9) AS distinct_n FROM g GROUP BY lang")
def a25(t: Tables) -> DataFrame:
    return rounded(M.distinct_n(t.documents, ["lang"], "text", 2), 9)


@query("a26_self_bleu", f"""WITH {GRAMS_SQL}, c AS (SELECT lang, doc_id, g, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT *, coalesce(max(c) OVER (PARTITION BY lang, g ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(max(c) OVER (PARTITION BY lang, g ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS b FROM c)
SELECT lang, round(avg(p), 6) AS self_bleu, count(*) AS texts FROM (SELECT lang, doc_id, sum(least(c, greatest(a, b))) / sum(c) AS p FROM m GROUP BY ALL) GROUP BY lang""")  # fmt: skip
def a26(t: Tables) -> DataFrame:
    return rounded(M.self_bleu(t.documents, ["lang"], "doc_id", "text"))


@query("a27_vocabulary", f"WITH {WORDS_SQL} SELECT lang, round(length_mean, 6) AS length_mean, round(length_std, 6) AS length_std, vocabulary, tokens, round(vocabulary / tokens, 9) AS type_token_ratio FROM (SELECT lang, avg(len(words)) AS length_mean, stddev_pop(len(words)) AS length_std FROM w GROUP BY lang) JOIN (SELECT lang, count(DISTINCT x) AS vocabulary, count(*) AS tokens FROM (SELECT lang, unnest(words) AS x FROM w) GROUP BY lang) USING (lang)")
def a27(t: Tables) -> DataFrame:
    found = M.vocabulary(_words(t), ["lang"], "words")
    return found.withColumns({"length_mean": F.round("length_mean", 6), "length_std": F.round("length_std", 6), "type_token_ratio": F.round("type_token_ratio", 9)})


@query("a28_histogram_entropy", """SELECT lang, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM (SELECT lang, b, count(*) / max(n) AS p FROM (SELECT lang, n, CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / 20)), 19) END AS b FROM (
SELECT lang, n_chars, min(n_chars) OVER w AS lo, max(n_chars) OVER w AS hi, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY lang))) GROUP BY lang, b) GROUP BY lang""")  # fmt: skip
def a28(t: Tables) -> DataFrame:
    return rounded(M.histogram_entropy(t.documents, ["lang"], "n_chars"))


@query("a29_action_counts", """SELECT role, count(*) FILTER (k = 'propose') AS propose, count(*) FILTER (k = 'accept') AS accept, count(*) FILTER (k = 'reject') AS reject, count(*) FILTER (k = 'message') AS message FROM (
SELECT role, CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'propose' WHEN 2 THEN 'accept' ELSE 'reject' END AS k FROM conversations) GROUP BY role""")  # fmt: skip
def a29(t: Tables) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, ("[message] ", "[propose] [accept] ", "[message] [accept] ", "[reject] "))), (F.col("turn") % 4 + 1).cast("int"))
    return M.action_counts(t.conversations.select("role", F.concat(tag, "text").alias("said")), "said", ["role"])


@query("a32_change_first_last", """SELECT event_type, round((arg_max(s, d) - arg_min(s, d)) / arg_min(s, d) * 100, 6) AS s_change_pct, round((arg_max(n, d) - arg_min(n, d)) / arg_min(n, d) * 100, 6) AS n_change_pct
FROM (SELECT event_type, day(ts) AS d, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")  # fmt: skip
def a32(t: Tables) -> DataFrame:
    rounds = t.events.groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.stddev_samp("value").alias("s"), F.count("*").cast("double").alias("n"))
    return rounded(M.change_first_last(rounds, "d", ["s", "n"], ["event_type"]))


@query("a34_best_checkpoint", "SELECT source, wins FROM (SELECT source, count(*) AS wins FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source) ORDER BY wins DESC, source LIMIT 1")
def a34(t: Tables) -> DataFrame:
    wins = t.documents.join(t.labels.where("quality = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("wins"))
    return M.best_checkpoint(wins, "wins", "source")


@query("a35_first_known", "SELECT l_orderkey, arg_min(l_tax, l_linenumber * 1000000 + l_partkey) FILTER (l_tax > 0.01) AS tax, arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey) AS flag FROM lineitem GROUP BY l_orderkey")
def a35(t: Tables) -> DataFrame:
    """The order is the SQL's own number; of rows alike in it, the one that comes first in the table's files."""
    at = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")
    rows = t.lineitem.select("l_orderkey", at.alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.when(at.isNotNull() & (F.col("l_tax") > 0.01), F.col("l_tax")).alias("tax"), F.when(at.isNotNull(), F.col("l_returnflag")).alias("flag"))
    return M.first_known(rows, ["l_orderkey"], ["at", "file", "row"], ["tax", "flag"])


@query("a36_eval_chunks", f"""WITH {WORDS_SQL}, c AS (SELECT doc_id, k, len(words[k * 128 + 1 : k * 128 + 128]) AS n FROM w, LATERAL (SELECT unnest(range((len(words) + 127) // 128)) AS k))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk, n::INT AS n, ((row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) % 4)::INT AS rank FROM c WHERE n >= 2""")  # fmt: skip
def a36(t: Tables) -> DataFrame:
    return M.chunks(_words(t), "doc_id", "words", 128, 4).select("doc_id", "chunk", F.size("tokens").alias("n"), "rank")


@query("a37_flops", "SELECT source, round(6 * 7e3 * sum(n_chars) + 12.0 * 28 * 16 * 8 * sum(n_chars::DOUBLE * n_chars), 0) AS flops, sum(n_chars)::DOUBLE AS tokens FROM documents GROUP BY source")
def a37(t: Tables) -> DataFrame:
    return M.flops(t.documents, "n_chars", 7e3, 28, 16, 8, ["source"]).withColumn("flops", F.round("flops", 0))


@query("a38_core_metrics", """SELECT CASE WHEN variable = 'acc' AND n = 8 AND metric LIKE 'mean@%' THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || variable || '/' || metric AS name FROM (
SELECT DISTINCT source FROM documents), (VALUES ('acc'), ('score')) v(variable), (VALUES ('mean@8', 8), ('std@8', 8), ('mean@4', 4)) m(metric, n)""")  # fmt: skip
def a38(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(v, m) for v in ("acc", "score") for m in ("mean@8", "std@8", "mean@4")], "variable string, metric string")
    rows = t.documents.select("source").distinct().crossJoin(F.broadcast(names))
    return M.core_metrics(rows, "source", "variable", "metric", ["acc"]).select("name")
