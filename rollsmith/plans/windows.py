"""Queries of the window operators (W14-W21), top lists (T1-T8) and sliding summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators import windows as W
from rollsmith.plans.registry import TOKENS_SQL, Tables, query

R9 = lambda name: F.round(name, 9).alias(name)


@query("w14_rolling_mean", """SELECT event_id, round(m, 9) AS rolling FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10""")  # fmt: skip
def w14(t: Tables) -> DataFrame:
    return W.rolling_mean(t.events.select("event_id", "user_id", "value"), "value", 10, ["event_id"], partition=["user_id"]).select("event_id", R9("rolling"))


@query("w14_expanding_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def w14b(t: Tables) -> DataFrame:
    return W.rolling_mean(t.events.select("event_id", "user_id", "value"), "value", 10, ["event_id"], partition=["user_id"], full_only=False).select("event_id", R9("rolling"))


@query("w15_learning_curve", """SELECT user_id, step, round(mean, 9) AS mean FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS step,
avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM events) WHERE step >= 20 AND (step - 20) % 10 = 0""")  # fmt: skip
def w15(t: Tables) -> DataFrame:
    return W.learning_curve(t.events.select("event_id", "user_id", "value"), "value", 20, ["event_id"], partition=["user_id"]).select("user_id", "step", R9("mean"))


@query("w16_regression_trigger", """SELECT event_type, day, round(m, 6) AS mean, n = 3 AND m < low AS regressed FROM (
SELECT *, min(m) OVER w AS low, count(m) OVER w AS n FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS m FROM events GROUP BY ALL)
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""")  # fmt: skip
def w16(t: Tables) -> DataFrame:
    rounds = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("mean"))
    return W.regressions(rounds, "mean", ["day"], 3, partition=["event_type"]).select("event_type", "day", F.round("mean", 6).alias("mean"), "regressed")


@query("w17_quantile_bins", """SELECT event_id, least((value > e[2])::INT + (value > e[3])::INT + (value > e[4])::INT + (value > e[5])::INT, 3)::INT AS bin
FROM events, (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM events)""")  # fmt: skip
def w17(t: Tables) -> DataFrame:
    return W.quantile_bins(t.events.select("event_id", "value"), "value", 4).select("event_id", "bin")


@query("w18_fixed_bins", """SELECT band, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 4 THEN '(0,4]' WHEN l_quantity > 4 AND l_quantity <= 6 THEN '(4,6]'
WHEN l_quantity > 6 AND l_quantity <= 8 THEN '(6,8]' WHEN l_quantity > 8 AND l_quantity <= 10 THEN '(8,10]' WHEN l_quantity > 10 AND l_quantity <= 20 THEN '(10,20]' END AS band FROM lineitem) GROUP BY band""")  # fmt: skip
def w18(t: Tables) -> DataFrame:
    return t.lineitem.select(W.fixed_bins(F.col("l_quantity"), [0, 4, 6, 8, 10, 20]).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("w19_first_turns", "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def w19(t: Tables) -> DataFrame:
    return W.first_rows(t.conversations.select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"])


@query("w20_common_prefix", f"""WITH {TOKENS_SQL}, m AS (SELECT uid, count(DISTINCT seq) AS members FROM tok GROUP BY uid),
p AS (SELECT uid, t, count(DISTINCT mask) AS kinds, count(DISTINCT seq) AS present FROM tok GROUP BY uid, t),
r AS (SELECT uid, members, min((kinds = 1 AND present = members)::INT) OVER (PARTITION BY uid ORDER BY t) AS run FROM p JOIN m USING (uid))
SELECT uid, max(members) AS members, sum(run)::BIGINT AS prefix FROM r GROUP BY uid""")  # fmt: skip
def w20(t: Tables) -> DataFrame:
    from rollsmith.plans.advantage import token_rows

    return W.common_prefix(token_rows(t).select("uid", "seq", "t", "mask"), "uid", "seq", "t", "mask")


@query("w21_zero_sum", """SELECT user_id, n, abs(total) <= 1e-6 AS valid FROM (SELECT user_id, count(*) AS n, sum(c) AS total FROM (
SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY user_id)""")  # fmt: skip
def w21(t: Tables) -> DataFrame:
    from rollsmith.operators.advantage import centred

    return W.zero_sums(centred(t.events.select("user_id", "value"), "value", "user_id"), "user_id", "advantage").select("user_id", "n", "valid")


@query("t1_best_median_worst", """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice, 'worst' AS place FROM o WHERE rn <= 5 UNION ALL SELECT o_orderkey, o_totalprice, 'best' FROM o WHERE rn > n - 5
UNION ALL SELECT o_orderkey, o_totalprice, 'median' FROM o WHERE rn > n // 2 - 2 AND rn <= n // 2 + 3""")  # fmt: skip
def t1(t: Tables) -> DataFrame:
    return W.best_median_worst(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 5)


@query("t4_top_fraction", "SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= greatest(1, (SELECT floor(count(*) * 0.01) FROM events))")
def t4(t: Tables) -> DataFrame:
    return W.top_fraction(t.events.select("event_id", "value"), "value", 0.01, ["event_id"])


@query("t5_random_in_band")
def t5(t: Tables) -> DataFrame:
    return W.sample_band(t.events.select("event_id", "value"), "value", 20.0, 80.0, 50, ["event_id"], 7)


@query("t8_seeded_shuffle")
def t8(t: Tables) -> DataFrame:
    return t.region.withColumn("place", W.hashed_order(["r_regionkey"], 42)).orderBy("place", "r_regionkey")


@query("a30_last_episodes", """SELECT count(*) AS n, round(avg(l_quantity), 9) AS mean_l_quantity, round(avg(l_discount), 9) AS mean_l_discount,
round(CASE WHEN stddev_pop(l_quantity) * stddev_pop(l_discount) = 0 THEN 0 ELSE covar_pop(l_quantity, l_discount) / (stddev_pop(l_quantity) * stddev_pop(l_discount)) END, 6) AS correlation
FROM (SELECT * FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 100)""")  # fmt: skip
def a30(t: Tables) -> DataFrame:
    order = [F.col(c).desc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return W.last_n_summary(t.lineitem, "l_quantity", "l_discount", order).select("n", R9("mean_l_quantity"), R9("mean_l_discount"), F.round("correlation", 6).alias("correlation"))


@query("a31_early_late", """WITH o AS (SELECT value, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events)
SELECT round(e, 9) AS early, round(l, 9) AS late, round((l - e) / abs(e) * 100, 6) AS change_pct FROM (
SELECT avg(value) FILTER (rn <= least(100, n // 4)) AS e, avg(value) FILTER (rn > n - least(100, n // 4)) AS l FROM o)""")  # fmt: skip
def a31(t: Tables) -> DataFrame:
    return W.early_late(t.events.select("event_id", "value"), "value", ["event_id"]).select(R9("early"), R9("late"), F.round("change_pct", 6).alias("change_pct"))
