"""Queries of token maths and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import tokens as T
from rollsmith.operators import losses as L
from rollsmith.plans.advantage import token_arrays, token_rows
from rollsmith.plans.metrics import rounded
from rollsmith.plans.registry import TOKENS_SQL, Tables, query

ADV_SQL = f"{TOKENS_SQL}, a AS (SELECT *, reward - 0.5 AS advantage FROM tok)"


def _adv(t: Tables) -> DataFrame:
    return token_rows(t).withColumn("advantage", F.col("reward") - 0.5)


@query("m1_masked_moments", f"""WITH {TOKENS_SQL}, s AS (SELECT seq, sum(reward * mask) AS s, sum(mask)::DOUBLE AS n FROM tok GROUP BY seq)
SELECT seq, round(s, 6) AS total, round(s / (n + 1e-8), 6) AS mean, round(CASE WHEN n > 1 THEN (SELECT sum(pow(reward - s / (n + 1e-8), 2) * mask) FROM tok WHERE tok.seq = s.seq) / (n + 1e-8) * n / (n - 1) END, 6) AS var FROM s""")  # fmt: skip
def m1(t: Tables) -> DataFrame:
    found = token_arrays(t, "reward", "mask").select("seq", T.masked_sum("reward", "mask").alias("total"), T.masked_mean("reward", "mask").alias("mean"), T.masked_var("reward", "mask").alias("var"))
    return rounded(found)


@query("m1_whitened", f"""WITH {TOKENS_SQL}, pre AS (SELECT seq, t, mask, reward AS x FROM tok), stats AS (SELECT m, (q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) AS v FROM (SELECT s / (n + 1e-8) AS m, s, q, n FROM (
SELECT sum(x * mask) AS s, sum(x * x * mask) AS q, sum(mask)::DOUBLE AS n FROM pre))) SELECT seq, t, round((x - m) / sqrt(v + 1e-8), 6) AS reward FROM pre, stats""")  # fmt: skip
def m1b(t: Tables) -> DataFrame:
    return rounded(T.whiten_rows(token_rows(t).select("seq", "t", "mask", "reward"), "reward").select("seq", "t", "reward"))


@query("m2_kl_estimators", f"""WITH {TOKENS_SQL} SELECT seq, round(sum(lp - ref_lp), 9) AS k1, round(sum(abs(lp - ref_lp)), 9) AS abs, round(sum(0.5 * pow(lp - ref_lp, 2)), 9) AS k2,
round(sum(least(greatest(exp(ref_lp - lp) - (ref_lp - lp) - 1, -10), 10)), 9) AS k3 FROM tok GROUP BY seq""")  # fmt: skip
def m2(t: Tables) -> DataFrame:
    return rounded(token_arrays(t, "lp", "ref_lp").select("seq", *[T.total(T.kl_penalty("lp", "ref_lp", k)).alias(k) for k in ("k1", "abs", "k2", "k3")]), 9)


@query("m3_kl_in_reward", f"WITH {TOKENS_SQL} SELECT seq, t, round(reward - 0.1 * (old_lp - ref_lp) * mask, 9) AS token_reward FROM tok")
def m3(t: Tables) -> DataFrame:
    return rounded(L.kl_in_reward(token_rows(t), 0.1).select("seq", "t", "token_reward"), 9)


@query("m3_sequence_kl", f"WITH {TOKENS_SQL} SELECT round(avg(k), 9) AS kl FROM (SELECT sum((old_lp - ref_lp) * mask) / (sum(mask) + 1e-8) AS k FROM tok GROUP BY seq)")
def m3b(t: Tables) -> DataFrame:
    return rounded(L.sequence_kl(L.kl_in_reward(token_rows(t), 0.1)), 9)


@query("m4_offline_kl", f"WITH {TOKENS_SQL} SELECT seq, round(1 - 0.05 * sum(lp - ref_lp), 9) AS w FROM tok GROUP BY seq")
def m4(t: Tables) -> DataFrame:
    return rounded(L.offline_kl(token_arrays(t, "lp", "ref_lp").withColumn("w", F.lit(1.0)), "w", "lp", "ref_lp", 0.05).select("seq", "w"), 9)


@query("m5_adaptive_coefficient", """SELECT round(list_reduce(list_prepend(0.2::DOUBLE, list(1 + least(greatest(m / 50 - 1, -0.2), 0.2) * n / 10000 ORDER BY d)), lambda a, b: a * b), 9) AS coefficient
FROM (SELECT ts::DATE AS d, avg(value) AS m, count(*)::DOUBLE AS n FROM events GROUP BY ALL)""")  # fmt: skip
def m5(t: Tables) -> DataFrame:
    steps = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return rounded(L.adaptive_coefficient(steps, "d", "m", "n", start=0.2, target=50.0, horizon=10000.0), 9)


@query("m6_loss_modes", f"""WITH {TOKENS_SQL}, s AS (SELECT seq, sum(reward * mask) AS s, sum(mask) AS n, count(*) AS width FROM tok GROUP BY seq HAVING sum(mask) > 0)
SELECT 'token-mean' AS mode, round(sum(s) / (sum(n) + 1e-8), 6) AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM s
UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / n), 6) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(width), 6) FROM s""")  # fmt: skip
def m6(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    tok = token_rows(t).withColumn("_k", F.sum("mask").over(Window.partitionBy("seq"))).where("_k > 0").drop("_k")
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = rounded(L.aggregate_loss(tok, "reward", mode)).select(F.lit(mode).alias("mode"), "loss")
        out = one if out is None else out.union(one)
    return out


PPO_SQL = """SELECT *, greatest(-advantage * r, -advantage * least(greatest(r, 0.98), 1.02)) AS worse, -advantage * r AS plain, -advantage * least(greatest(r, 0.98), 1.02) AS cut FROM (SELECT *, exp(lp - old_lp) AS r FROM a)"""


@query("m7_ppo_dual_clip", f"""WITH {ADV_SQL} SELECT round(sum(mask * CASE WHEN advantage < 0 THEN least(-advantage * 1.01, worse) ELSE worse END) / (sum(mask) + 1e-8), 9) AS loss, round(sum(mask * (cut > plain)::INT) / (sum(mask) + 1e-8), 9) AS clipped,
round(sum(mask * (worse > -advantage * 1.01 AND advantage < 0)::INT) / (sum(mask) + 1e-8), 9) AS clipped_low, round(sum(mask * (old_lp - lp)) / (sum(mask) + 1e-8), 9) AS kl FROM ({PPO_SQL})""")  # fmt: skip
def m7(t: Tables) -> DataFrame:
    return rounded(L.masked_means(L.ppo_terms(_adv(t), 0.02, 0.02, 1.01), ["loss", "clipped", "clipped_low", "kl"]), 9)


@query("m8_gpg_loss", f"WITH {ADV_SQL} SELECT round(sum(-lp * advantage * mask) / (sum(mask) + 1e-8), 9) AS loss FROM a")
def m8(t: Tables) -> DataFrame:
    return rounded(L.gpg_loss(_adv(t)), 9)


@query("m8_kl_cov", f"""WITH {ADV_SQL}, c AS (SELECT *, (advantage - ma) * (lp - ml) AS cov FROM a, (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) AS ma, sum(lp * mask) / (sum(mask) + 1e-8) AS ml FROM a)),
k AS (SELECT seq, t FROM c WHERE mask > 0 ORDER BY round(cov, 12) DESC, seq, t LIMIT (SELECT greatest(1, floor(0.002 * sum(mask)))::BIGINT FROM a))
SELECT round(sum(mask * (-advantage * exp(lp - old_lp) + CASE WHEN k.seq IS NOT NULL THEN abs(lp - old_lp) ELSE 0 END)) / (sum(mask) + 1e-8), 9) AS loss FROM c LEFT JOIN k USING (seq, t)""")  # fmt: skip
def m8b(t: Tables) -> DataFrame:
    return rounded(L.aggregate_loss(L.kl_cov(_adv(t), ["seq", "t"], ratio=0.002), "loss"), 9)


@query("m8_clip_cov")
def m8c(t: Tables) -> DataFrame:
    return rounded(L.clip_cov(_adv(t), ["seq", "t"], ratio=0.002, low=0.005, high=0.02).agg(F.count_if(F.col("corr") == 0).alias("taken_out"), F.avg("loss").alias("loss")), 9)


@query("m9_value_loss", f"""WITH {TOKENS_SQL} SELECT round(sum(mask * 0.5 * greatest(p, c)) / (sum(mask) + 1e-8), 9) AS loss, round(sum(mask * (c > p)::INT) / (sum(mask) + 1e-8), 9) AS clipped
FROM (SELECT mask, pow(lp - reward, 2) AS p, pow(least(greatest(lp, value - 0.05), value + 0.05) - reward, 2) AS c FROM tok)""")  # fmt: skip
def m9(t: Tables) -> DataFrame:
    return rounded(L.value_loss(token_rows(t).withColumn("predicted", F.col("lp")).withColumn("returns", F.col("reward")), 0.05), 9)


@query("m10_entropy", """SELECT vec_id, round(z - s, 6) AS entropy, round(x3 - z, 6) AS log_prob FROM (SELECT vec_id, z, list_sum(list_transform(e, lambda x: exp(x - z) * x)) AS s, e[4] AS x3 FROM (
SELECT vec_id, e, list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))""")  # fmt: skip
def m10(t: Tables) -> DataFrame:
    logits = F.col("embedding").cast("array<double>")
    return rounded(t.embeddings.select("vec_id", T.entropy(logits).alias("entropy"), T.log_prob(logits, F.lit(3)).alias("log_prob")))


@query("m11_preference_loss", f"""WITH {TOKENS_SQL}, s AS (SELECT seq // 2 AS pair, seq % 2 AS side, sum(lp) AS lp, sum(ref_lp) AS ref FROM tok GROUP BY seq),
p AS (SELECT pair, (sum(lp) FILTER (side = 0) - sum(lp) FILTER (side = 1)) - (sum(ref) FILTER (side = 0) - sum(ref) FILTER (side = 1)) AS x FROM s GROUP BY pair HAVING count(*) = 2)
SELECT round(avg(ln(1 + exp(-0.1 * x)) * 0.9 + ln(1 + exp(0.1 * x)) * 0.1), 9) AS sigmoid, round(avg(pow(x - 5, 2)), 6) AS ipo FROM p""")  # fmt: skip
def m11(t: Tables) -> DataFrame:
    s = token_rows(t).groupBy("seq").agg(F.sum("lp").alias("lp"), F.sum("ref_lp").alias("ref"))
    side = lambda c, k: F.sum(F.when(F.col("seq") % 2 == k, F.col(c)))
    p = s.groupBy(F.floor(F.col("seq") / 2).alias("pair")).agg(side("lp", 0).alias("a"), side("lp", 1).alias("b"), side("ref", 0).alias("c"), side("ref", 1).alias("d"), F.count("*").alias("n")).where("n = 2")
    loss = lambda **o: L.preference_loss(*[F.col(x) for x in "abcd"], 0.1, **o)
    return p.agg(F.round(F.avg(loss(smoothing=0.1)), 9).alias("sigmoid"), F.round(F.avg(loss(kind="ipo")), 6).alias("ipo"))


@query("m12_outcome_losses", """SELECT round(avg(ln(1 + exp(-0.05 * value)) * acc + ln(1 + exp(0.05 * value)) * (1 - acc)), 9) AS cross_entropy, round(avg((sign(value - 50) = sign(acc * 2 - 1))::INT), 9) AS accuracy FROM (SELECT value, (event_id % 3 = 0)::INT AS acc FROM events)""")
def m12(t: Tables) -> DataFrame:
    rows = t.events.select("value", (F.col("event_id") % 3 == 0).cast("int").alias("acc"))
    ce = rows.agg(F.avg(L.cross_entropy_preference(F.col("value"), F.col("acc"), 0.05)).alias("cross_entropy"))
    return rounded(ce.crossJoin(L.sign_accuracy(rows.withColumn("value", F.col("value") - 50), "acc", "value")), 9)


@query("m12_detached_loss", """WITH r AS (SELECT event_id, user_id, (value > 50)::INT AS acc, event_id % 17 * 0.1 AS score FROM events), o AS (SELECT user_id, acc, avg(score) AS m FROM r GROUP BY ALL)
SELECT event_id, round(ln(1 + exp(-(score - coalesce(m, 0)) * 0.5 * (r.acc * 2 - 1))), 9) AS loss FROM r LEFT JOIN o ON r.user_id = o.user_id AND o.acc = 1 - r.acc""")  # fmt: skip
def m12b(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", (F.col("value") > 50).cast("int").alias("acc"), (F.col("event_id") % 17 * 0.1).alias("score"))
    return rounded(L.detached_preference(rows, "user_id", "acc", "score", 0.5).select("event_id", "loss"), 9)


@query("m12_pair_accuracy", """WITH r AS (SELECT event_id, event_id // 8 AS uid, event_id % 3 AS acc, value AS score FROM events), p AS (SELECT a.uid, a.acc - b.acc AS g, ((a.score > b.score) = (a.acc > b.acc))::INT AS ok FROM r a JOIN r b ON a.uid = b.uid AND a.event_id < b.event_id)
SELECT round(avg(CASE WHEN d > 0 THEN n / d ELSE 0.5 END), 9) AS accuracy FROM (SELECT uid, sum(ok * abs(g)) AS n, sum(abs(g)) AS d FROM p GROUP BY uid)""")  # fmt: skip
def m12c(t: Tables) -> DataFrame:
    rows = t.events.select(F.expr("event_id div 8").alias("uid"), "event_id", (F.col("event_id") % 3).alias("acc"), F.col("value").alias("score"))
    return rounded(L.pair_accuracy(rows, "uid", "event_id", "acc", "score"), 9)


@query("m13_sppo_loss", f"WITH {TOKENS_SQL} SELECT round(sum(pow(r - 0.5 * w, 2) * m) / (sum(m) + 1e-8), 9) AS loss FROM (SELECT sum((lp - old_lp) * mask) AS r, seq % 7 AS w, max(mask) AS m FROM tok GROUP BY seq)")
def m13(t: Tables) -> DataFrame:
    return rounded(L.sppo_loss(token_rows(t).withColumn("w", F.col("seq") % 7), "w", 0.5), 9)


@query("m14_eos_mask", "SELECT seq, CASE WHEN p > 0 THEN p ELSE n END AS kept FROM (SELECT l_orderkey AS seq, list_position(list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey), 3) AS p, count(*) AS n FROM lineitem GROUP BY 1)".replace("THEN p ELSE", "THEN p::BIGINT ELSE").replace("p > 0", "coalesce(p, 0) > 0"))
def m14(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return ids.select("seq", F.aggregate(T.first_eos_mask("ids", [3]), F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


@query("m15_response_mask", f"WITH {TOKENS_SQL} SELECT seq, sum(mask)::BIGINT AS kept FROM (SELECT *, max(t) OVER (PARTITION BY seq) AS n FROM tok) WHERE t > n - 3 GROUP BY seq")
def m15(t: Tables) -> DataFrame:
    return token_arrays(t, "mask").select("seq", F.aggregate(T.tail_mask("mask", 3), F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


@query("m16_pad_truncate", """SELECT vec_id, round(e[1], 6) AS left_first, round(e[64], 6) AS left_last, round(e[4], 6) AS middle_head, round(e[61], 6) AS middle_tail FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def m16(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    padded, middle = T.pad_left(e, 70, 0.0), T.truncate(e, 8, "middle")
    return rounded(t.embeddings.select("vec_id", F.get(padded, F.lit(6)).alias("left_first"), F.element_at(T.truncate(padded, 64, "left"), -1).alias("left_last"), F.get(middle, F.lit(3)).alias("middle_head"), F.get(middle, F.lit(4)).alias("middle_tail")))


@query("m17_strip_pad", "SELECT vec_id, 64 AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def m17(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    stripped = T.strip_left_pad(T.pad_left(e, 80, 0.0), T.pad_left(F.transform(e, lambda x: F.lit(1)), 80, 0))
    return rounded(t.embeddings.select("vec_id", F.size(stripped).alias("n"), F.get(stripped, F.lit(0)).alias("first")))


@query("m18_position_ids", f"WITH {TOKENS_SQL} SELECT seq, sum((t - 1) * mask)::BIGINT AS total FROM tok GROUP BY seq")
def m18(t: Tables) -> DataFrame:
    return token_arrays(t, "mask").select("seq", F.aggregate(T.position_ids("mask"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("m19_terminal_reward", f"WITH {TOKENS_SQL} SELECT seq, t, CASE WHEN t = sum(mask) OVER (PARTITION BY seq) THEN 2.5 ELSE 0 END::DOUBLE AS reward FROM tok")
def m19(t: Tables) -> DataFrame:
    placed = token_arrays(t, "mask").withColumn("reward", T.place_terminal(F.lit(2.5), "mask"))
    return T.rows(placed, ["reward"], ["seq"]).select("seq", F.col("t").cast("int").alias("t"), "reward")


@query("m20_tensorise", f"WITH {TOKENS_SQL} SELECT seq, least(count(*), 3)::INT AS n, sum(mask) FILTER (t <= 3)::BIGINT AS kept FROM tok GROUP BY seq")
def m20(t: Tables) -> DataFrame:
    a = token_arrays(t, "mask").withColumn("ids", T.truncate("mask", 3))
    aligned = T.pad_right(T.truncate(F.slice("mask", 1, 3), 3), 0, 0)
    return a.select("seq", F.size("ids").alias("n"), F.aggregate(aligned, F.lit(0).cast("long"), lambda s, x: s + x).alias("kept"))


@query("m21_role_masks", "SELECT conv_id, sum(length(text))::BIGINT AS tokens, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS trained FROM conversations GROUP BY conv_id")
def m21(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("x"))
    mask = T.role_mask(F.transform("x", lambda x: x["role"]), F.transform("x", lambda x: x["n"]))
    return turns.select("conv_id", F.size(mask).cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("trained"))


@query("m22_clip_by_value", "SELECT event_id, least(greatest(value, user_id * 0.1), 90.0) AS clipped FROM events")
def m22(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.clip(F.col("value"), F.col("user_id") * 0.1, 90.0).alias("clipped"))
