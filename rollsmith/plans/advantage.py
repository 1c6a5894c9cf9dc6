"""Queries of the advantage estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import tokens as T
from rollsmith.operators import advantage as A
from rollsmith.plans.registry import TOKENS_SQL, Tables, query

R9 = lambda name: F.round(name, 9).alias(name)
R6 = lambda name: F.round(name, 6).alias(name)


def token_rows(t: Tables) -> DataFrame:
    """Order lines as token rows, in the binding that ``TOKENS_SQL`` states."""
    line = t.lineitem
    return line.select(
        F.col("l_orderkey").alias("seq"), (F.col("l_orderkey") % 500).alias("uid"), T.number_tokens(line, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).alias("t"),
        (F.col("l_quantity") / 50.0).alias("reward"), F.col("l_tax").alias("value"), (F.col("l_returnflag") != "R").cast("int").alias("mask"),
        (-F.col("l_discount")).alias("old_lp"), (-F.col("l_tax")).alias("lp"), (-(F.col("l_discount") + F.col("l_tax")) / 2).alias("ref_lp"),
    )


def token_arrays(t: Tables, *columns: str) -> DataFrame:
    return T.sequences(token_rows(t), list(columns) or ["reward", "value", "mask", "old_lp", "lp", "ref_lp"])


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "value")


@query("w1_group_centring", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_id // 8), 9) AS advantage FROM events")
def w1(t: Tables) -> DataFrame:
    return A.centred(t.events.select("event_id", "value", F.expr("event_id div 8").alias("g")), "value", "g").select("event_id", R9("advantage"))


GRPO_SQL = """SELECT {key}, round(({score} - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 6) AS advantage
FROM (SELECT *, count(*) OVER w AS n, avg({score}) OVER w AS m, stddev_samp({score}) OVER w AS s FROM {table} WINDOW w AS (PARTITION BY {uid}))"""


@query("w2_grpo_advantage", GRPO_SQL.format(key="event_id", score="value", table="events", uid="user_id"))
def w2(t: Tables) -> DataFrame:
    return A.grpo(_events(t), "value", "user_id").select("event_id", R6("advantage"))


@query("w2_grpo_small_groups", GRPO_SQL.format(key="o_orderkey", score="o_totalprice", table="orders", uid="o_custkey"))
def w2_small(t: Tables) -> DataFrame:
    return A.grpo(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey").select("o_orderkey", R6("advantage"))


@query("w2_grpo_without_std", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS advantage FROM events")
def w2_plain(t: Tables) -> DataFrame:
    return A.grpo(_events(t), "value", "user_id", by_std=False).select("event_id", R9("advantage"))


@query("w3_grpo_passk", """SELECT event_id, round(CASE WHEN rn = 1 THEN (value - nxt) / (s + 1e-6) ELSE 0 END, 6) AS advantage FROM (
  SELECT event_id, value, row_number() OVER o AS rn, lead(value) OVER o AS nxt, stddev_samp(value) OVER (PARTITION BY user_id) AS s
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id))""")  # fmt: skip
def w3(t: Tables) -> DataFrame:
    return A.grpo_passk(_events(t), "value", "user_id", "event_id").select("event_id", R6("advantage"))


WHITEN_SQL = "(x - m) / sqrt(v + 1e-8)"
#: Statistics of whitening over masked tokens, as one row.
STATS_SQL = "stats AS (SELECT m, (q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) AS v FROM (SELECT s / (n + 1e-8) AS m, s, q, n FROM (SELECT sum(x * mask) AS s, sum(x * x * mask) AS q, sum(mask)::DOUBLE AS n FROM pre)))"


@query("w4_rf_plus_plus_baseline", f"""WITH {TOKENS_SQL}, per AS (SELECT uid, seq, sum(reward) AS score FROM tok GROUP BY ALL),
adv AS (SELECT uid, seq, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS x FROM per WINDOW w AS (PARTITION BY uid)),
pre AS (SELECT tok.seq, tok.t, tok.mask, adv.x FROM tok JOIN adv USING (uid, seq)), {STATS_SQL}
SELECT seq, t, round({WHITEN_SQL} * mask, 6) AS advantage FROM pre, stats""")  # fmt: skip
def w4(t: Tables) -> DataFrame:
    tok = token_rows(t)
    score = tok.groupBy("seq").agg(F.sum("reward").alias("score"))
    return A.rf_plus_plus_baseline(tok.join(score, "seq"), "score", "uid").select("seq", "t", R6("advantage"))


@query("w5_rloo", """SELECT o_orderkey, round(CASE WHEN n > 1 THEN o_totalprice * n / (n - 1) - m * n / (n - 1) ELSE o_totalprice END, 7) AS advantage
FROM (SELECT *, count(*) OVER w AS n, avg(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey))""")  # fmt: skip
def w5(t: Tables) -> DataFrame:
    return A.rloo(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey").select("o_orderkey", F.round("advantage", 7).alias("advantage"))


@query("w6_opo", """SELECT event_id, round(value - sum(value * len) OVER w / sum(len) OVER w, 6) AS advantage
FROM (SELECT *, length(props) AS len FROM events) WINDOW w AS (PARTITION BY user_id)""")  # fmt: skip
def w6(t: Tables) -> DataFrame:
    return A.opo(t.events.select("event_id", "user_id", "value", F.length("props").alias("len")), "value", "user_id", "len").select("event_id", R6("advantage"))


@query("w7_rf_plus_plus", f"""WITH RECURSIVE {TOKENS_SQL}, last AS (SELECT seq, max(t) AS n FROM tok GROUP BY seq),
run AS (SELECT tok.seq, tok.t, tok.mask, reward AS x FROM tok JOIN last ON tok.seq = last.seq AND tok.t = last.n
  UNION ALL SELECT tok.seq, tok.t, tok.mask, tok.reward + 0.9 * run.x * run.mask FROM run JOIN tok ON tok.seq = run.seq AND tok.t = run.t - 1),
pre AS (SELECT * FROM run), {STATS_SQL}
SELECT seq, t, round(x, 6) AS returns, round({WHITEN_SQL} * mask, 6) AS advantage FROM pre, stats""")  # fmt: skip
def w7(t: Tables) -> DataFrame:
    return A.rf_plus_plus(token_arrays(t, "reward", "mask"), gamma=0.9).select("seq", "t", R6("returns"), R6("advantage"))


@query("w8_remax", f"""WITH {TOKENS_SQL} SELECT seq, t, round(returns, 6) AS returns, round(returns - 0.5 * mask, 6) AS advantage FROM (
  SELECT seq, t, mask, sum(reward * mask) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS returns FROM tok)""")  # fmt: skip
def w8(t: Tables) -> DataFrame:
    return A.remax(token_rows(t).withColumn("base", F.lit(0.5)), "base").select("seq", "t", R6("returns"), R6("advantage"))


@query("w9_gpg", """SELECT event_id, round(a * (value - avg(value) OVER (PARTITION BY user_id)), 9) AS advantage
FROM events, (SELECT count(*) / greatest(count(*) FILTER (value <> 0), 1) AS a FROM events)""")  # fmt: skip
def w9(t: Tables) -> DataFrame:
    return A.gpg(_events(t), "value", "user_id").select("event_id", R9("advantage"))


@query("w10_gae", f"""WITH RECURSIVE {TOKENS_SQL}, last AS (SELECT seq, max(t) AS n FROM tok GROUP BY seq),
run AS (SELECT tok.seq, tok.t, tok.mask, value, (reward - value) * mask AS adv, value * mask AS nxt FROM tok JOIN last ON tok.seq = last.seq AND tok.t = last.n
  UNION ALL SELECT tok.seq, tok.t, tok.mask, tok.value, (tok.reward + 0.99 * run.nxt - tok.value + 0.99 * 0.95 * run.adv) * tok.mask + (1 - tok.mask) * run.adv, tok.value * tok.mask + (1 - tok.mask) * run.nxt
  FROM run JOIN tok ON tok.seq = run.seq AND tok.t = run.t - 1),
pre AS (SELECT *, adv AS x FROM run), {STATS_SQL}
SELECT seq, t, round(x + value, 6) AS returns, round({WHITEN_SQL}, 6) AS advantage FROM pre, stats""")  # fmt: skip
def w10(t: Tables) -> DataFrame:
    return A.gae(token_arrays(t, "reward", "value", "mask"), gamma=0.99, lam=0.95).select("seq", "t", R6("returns"), R6("advantage"))


@query("w11_prime_rloo", f"""WITH {TOKENS_SQL}, marked AS (SELECT *, value * 10 AS acc, (t = sum(mask) OVER (PARTITION BY seq))::INT AS is_end FROM tok),
per AS (SELECT uid, seq, CASE WHEN sum(mask) > 0 THEN sum(reward * mask) / sum(mask) END AS m, sum(acc * is_end) AS a FROM marked GROUP BY ALL),
base AS (SELECT uid, seq, count(*) OVER w AS n, sum(m) OVER w / (count(*) OVER w - 1) AS bm, sum(a) OVER w / (count(*) OVER w - 1) AS ba FROM per WINDOW w AS (PARTITION BY uid)),
pre AS (SELECT seq, t, mask, sum(r * mask) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM (
  SELECT marked.*, 5 * CASE WHEN mask > 0 THEN reward * n / (n - 1) - bm ELSE 0 END + 5 * CASE WHEN is_end > 0 THEN acc * n / (n - 1) - ba ELSE 0 END AS r FROM marked JOIN base USING (uid, seq))), {STATS_SQL}
SELECT seq, t, round(x, 8) AS returns, round({WHITEN_SQL}, 7) AS advantage FROM pre, stats""")  # fmt: skip
def w11(t: Tables) -> DataFrame:
    found = A.prime_rloo(token_rows(t).withColumn("acc", F.col("value") * 10), "uid")
    return found.select("seq", "t", F.round("returns", 8).alias("returns"), F.round("advantage", 7).alias("advantage"))


@query("w12_soft_mean", "SELECT event_id, round(value - b, 6) AS advantage FROM events, (SELECT (m + ln(sum(exp(value * 0.1 - m))) - ln(count(*))) / 0.1 AS b FROM events, (SELECT max(value * 0.1) AS m FROM events) GROUP BY m)")
def w12(t: Tables) -> DataFrame:
    return A.soft_mean(t.events.select("event_id", "value"), "value", 0.1).select("event_id", R6("advantage"))


@query("w13_estimator_registry", """SELECT 'grpo' AS estimator, count(*) AS n, round(sum(a), 4) AS total FROM (SELECT (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) AS a FROM events WINDOW w AS (PARTITION BY user_id))
UNION ALL SELECT 'rloo', count(*), round(sum(abs(a)), 4) FROM (SELECT (value - avg(value) OVER w) * count(*) OVER w / (count(*) OVER w - 1) AS a FROM events WINDOW w AS (PARTITION BY user_id))""")  # fmt: skip
def w13(t: Tables) -> DataFrame:
    first = A.estimate("grpo", _events(t), "value", "user_id").agg(F.lit("grpo").alias("estimator"), F.count("*").alias("n"), (F.round(F.sum("advantage"), 4) + 0.0).alias("total"))
    return first.union(A.estimate("rloo", _events(t), "value", "user_id").agg(F.lit("rloo"), F.count("*"), F.round(F.sum(F.abs("advantage")), 4)))
