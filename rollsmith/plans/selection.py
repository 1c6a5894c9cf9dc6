"""Queries of the filters (F1-F16) and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators import filters as P
from rollsmith.operators import joins as J
from rollsmith.plans.registry import Tables, query

WORDS_SQL = "len(list_filter(string_split_regex(trim({0}), '\\s+'), lambda x: x <> ''))"


@query("f1_over_long", f"SELECT doc_id FROM documents WHERE {WORDS_SQL.format('text')} <= 200")
def f1(t: Tables) -> DataFrame:
    return P.within_length(t.documents.select("doc_id", "text"), "text", 200).select("doc_id")


@query("f2_label_present", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def f2(t: Tables) -> DataFrame:
    return P.labelled(t.conversations, "text").select("conv_id", "turn")


@query("f3_date_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01'")
def f3(t: Tables) -> DataFrame:
    return P.date_range(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day", "1995-01-01", "1996-01-01")


@query("f4_thresholds", """SELECT t AS threshold, count(*) AS n FROM (SELECT l_tax / 0.08 AS r FROM lineitem), (SELECT unnest([0.5, 0.95, 1.0]) AS t)
WHERE CASE WHEN t = 1.0 THEN r = 1.0 ELSE r >= t END GROUP BY t""")  # fmt: skip
def f4(t: Tables) -> DataFrame:
    return P.by_thresholds(t.lineitem.select((F.col("l_tax") / 0.08).alias("reward")), "reward", [0.5, 0.95, 1.0]).groupBy("threshold").agg(F.count("*").alias("n"))


@query("f5_perfect", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount / 0.1 = 1.0")
def f5(t: Tables) -> DataFrame:
    return t.lineitem.where(P.at_threshold(F.col("l_discount") / 0.1, 1.0)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f6_skip_runs", "SELECT event_type, day, count(*) AS n FROM (SELECT event_type, day(ts)::INT AS day FROM events) WHERE NOT starts_with(event_type, 'er') AND NOT (event_type = 'click' AND day > 6) GROUP BY ALL")
def f6(t: Tables) -> DataFrame:
    rounds = t.events.select("event_type", F.dayofmonth("ts").alias("day"))
    return P.skip_runs(rounds, "event_type", "day", ["er"], {"click": 6}).groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query("f7_failure_marker", "SELECT doc_id FROM documents WHERE NOT contains(text, '!!')")
def f7(t: Tables) -> DataFrame:
    return P.without_marker(t.documents, "text", "!!").select("doc_id")


@query("f8_length_trim", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= (SELECT least(floor(quantile_cont(n_chars, 0.95)), 5000) FROM documents)")
def f8(t: Tables) -> DataFrame:
    return P.trim_lengths(t.documents.select("doc_id", "n_chars"), "n_chars")


@query("f9_positive", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def f9(t: Tables) -> DataFrame:
    return P.positive(t.customer, "c_acctbal").select("c_custkey")


@query("f10_weight_percentile", """WITH a AS (SELECT doc_id, n_chars - 1000 AS w, n_chars FROM documents WHERE n_chars <= (SELECT least(floor(quantile_cont(n_chars, 0.95)), 5000) FROM documents)),
b AS (SELECT * FROM a WHERE w > 0) SELECT doc_id, w FROM b WHERE w >= (SELECT quantile_cont(w, 0.6) FROM b)""")  # fmt: skip
def f10(t: Tables) -> DataFrame:
    kept = P.trim_lengths(t.documents.select("doc_id", "n_chars", (F.col("n_chars") - 1000).alias("w")), "n_chars")
    return P.weight_percentile(P.positive(kept, "w"), "w", 0.6).select("doc_id", "w")


@query("f11_varied_groups", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY max(l_returnflag) OVER (PARTITION BY l_orderkey) <> min(l_returnflag) OVER (PARTITION BY l_orderkey) OR count(*) OVER (PARTITION BY l_orderkey) = 1")
def f11(t: Tables) -> DataFrame:
    return P.varied_groups(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_returnflag", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("f12_accuracy_band", """WITH r AS (SELECT event_id // 8 AS uid, event_id, (value > 50)::INT AS acc, length(props) AS len FROM events),
g AS (SELECT uid, avg(acc) BETWEEN 0.2 AND 0.8 AND max(len) < 12 - 1 AS passed, count(*) AS n FROM r GROUP BY uid),
o AS (SELECT *, sum(n) OVER (ORDER BY passed DESC, uid) AS upto FROM g)
SELECT event_id, passed FROM r JOIN o USING (uid) WHERE upto <= (SELECT floor(count(*) / 2) FROM r)""")  # fmt: skip
def f12(t: Tables) -> DataFrame:
    rows = t.events.select(F.expr("event_id div 8").alias("uid"), "event_id", (F.col("value") > 50).cast("int").alias("acc"), F.length("props").alias("len"))
    return P.accuracy_band(rows, "acc", "len", "uid", 0.2, 0.8, 12, 2.0).select("event_id", "passed")


@query("f13_text_guards", "SELECT conv_id, turn FROM conversations WHERE length(text) > 20 AND contains(substr(text, 1, 150), 'the')")
def f13(t: Tables) -> DataFrame:
    return P.long_enough(t.conversations, "text", needle="the").select("conv_id", "turn")


@query("f14_skip_error_turns", "SELECT conv_id, count(*) FILTER (role <> 'system') AS n FROM conversations GROUP BY conv_id")
def f14(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("player"))).alias("turns"))
    return turns.select("conv_id", F.size(P.without_errors(F.col("turns"), marker="system")).cast("long").alias("n"))


@query("f15_fill_groups", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 5)")
def f15(t: Tables) -> DataFrame:
    return P.fill_groups(t.events.select("event_id", "user_id"), "user_id", 5)


@query("f16_require_positive", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")
def f16(t: Tables) -> DataFrame:
    return P.positive(P.require_positive(t.customer, "c_acctbal"), "c_acctbal").agg(F.count("*").alias("n"))


@query("j1_suffixed_join", "SELECT a.doc_id, a.source, b.quality, b.source AS source_prop FROM documents a JOIN (SELECT doc_id, quality, 'labels' AS source FROM labels) b USING (doc_id)")
def j1(t: Tables) -> DataFrame:
    right = t.labels.select("doc_id", "quality", F.lit("labels").alias("source"))
    return J.suffixed_join(t.documents.select("doc_id", "source"), right, ["doc_id"])


@query("j4_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j4(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j5_group_pairs", """SELECT uid, count(*) AS pairs, round(sum(abs(a.acc - b.acc) * ((a.score > b.score) = (a.acc > b.acc))::INT), 6) AS agreed FROM
(SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t, l_tax AS acc, l_quantity AS score FROM lineitem) a
JOIN (SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t, l_tax AS acc, l_quantity AS score FROM lineitem) b USING (uid) WHERE a.t < b.t GROUP BY uid""")  # fmt: skip
def j5(t: Tables) -> DataFrame:
    from rollsmith.plans.advantage import token_rows

    rows = token_rows(t).select(F.col("seq").alias("uid"), "t", F.col("value").alias("acc"), (F.col("reward") * 50).alias("score"))
    pairs = J.group_pairs(rows, "uid", "t", ["acc", "score"])
    agreed = F.abs(F.col("acc_i") - F.col("acc_j")) * ((F.col("score_i") > F.col("score_j")) == (F.col("acc_i") > F.col("acc_j"))).cast("int")
    return pairs.groupBy("uid").agg(F.count("*").alias("pairs"), F.round(F.sum(agreed), 6).alias("agreed"))


@query("j6_opposite_peers", """WITH r AS (SELECT event_id, user_id, floor(value / 25) AS acc, value AS score FROM events)
SELECT a.event_id, round(coalesce(avg(b.score), 0), 9) AS peer_mean FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND CASE WHEN a.acc > 0 THEN b.acc < a.acc ELSE b.acc > a.acc END GROUP BY a.event_id""")  # fmt: skip
def j6(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.floor(F.col("value") / 25).alias("acc"), F.col("value").alias("score"))
    return J.opposite_peers(rows, "user_id", "acc", "score").select("event_id", F.round("peer_mean", 9).alias("peer_mean"))


@query("j7_preference_pairs", "SELECT event_id, event_id // 2 AS pair, row_number() OVER (PARTITION BY event_id // 2 ORDER BY value DESC, event_id) = 1 AS chosen FROM events")
def j7(t: Tables) -> DataFrame:
    return J.preference_pairs(t.events.select("event_id", "value"), "event_id", "value").select("event_id", "pair", "chosen")


@query("j8_proximity", """WITH names AS (SELECT unnest(['the', 'and', 'ing']) AS a), others AS (SELECT unnest(['was', 'with', 'est']) AS b),
pos AS (SELECT doc_id, a AS name, unnest(list_transform(range(len(string_split(lower(text), a)) - 1), lambda k: list_sum(list_transform(string_split(lower(text), a)[1:k + 1], lambda p: length(p))) + k * length(a))) AS at FROM documents, names
  UNION ALL SELECT doc_id, b, unnest(list_transform(range(len(string_split(lower(text), b)) - 1), lambda k: list_sum(list_transform(string_split(lower(text), b)[1:k + 1], lambda p: length(p))) + k * length(b))) FROM documents, others)
SELECT DISTINCT x.doc_id, x.name AS first, y.name AS second FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.name IN ('the', 'and', 'ing') AND y.name IN ('was', 'with', 'est') AND abs(x.at - y.at) < 100""")  # fmt: skip
def j8(t: Tables) -> DataFrame:
    return J.proximity_pairs(t.documents.select("doc_id", "text"), "doc_id", "text", ["the", "and", "ing"], ["was", "with", "est"])


FUZZY_SQL = """WITH o AS (SELECT 0 AS i, 'the and of' AS o UNION ALL SELECT 1, 'in to the' UNION ALL SELECT 2, 'de la que'),
s AS (SELECT conv_id, turn, o, i, len(list_intersect(list_distinct(string_split_regex(lower(trim(text)), '\\s+')), string_split(o, ' '))) AS n FROM conversations, o)
SELECT conv_id, turn, CASE WHEN n > 0 THEN o END AS match FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) = 1"""


@query("j9_fuzzy_option", FUZZY_SQL)
def j9(t: Tables) -> DataFrame:
    return J.best_option(t.conversations.select("conv_id", "turn", "text"), "text", ["the and of", "in to the", "de la que"]).select("conv_id", "turn", "match")


@query("j10_prices", "SELECT event_type, count(*) AS calls, round(sum(coalesce((user_id * p_in + event_id * p_out) / 1e6, 0)), 9) AS cost FROM events LEFT JOIN (VALUES ('click', 2.5, 10.0), ('view', 0.15, 0.6)) p(event_type, p_in, p_out) USING (event_type) GROUP BY event_type")
def j10(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("click", 2.5, 10.0), ("view", 0.15, 0.6)], "event_type string, price_in double, price_out double")
    return J.priced(t.events, prices, "event_type", "user_id", "event_id").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 9).alias("cost"))


@query("j11_group_key", "SELECT conv_id // 8 AS grp, count(DISTINCT conv_id) AS games FROM conversations GROUP BY 1")
def j11(t: Tables) -> DataFrame:
    return t.conversations.groupBy(J.seeded_group(F.col("conv_id"), 8).alias("grp")).agg(F.count_distinct("conv_id").alias("games"))


@query("j3_group_statistic", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 9) AS mean, round(stddev_samp(value) OVER (PARTITION BY user_id), 9) AS std FROM events")
def j3(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return t.events.select("event_id", F.round(F.avg("value").over(w), 9).alias("mean"), F.round(F.stddev_samp("value").over(w), 9).alias("std"))
