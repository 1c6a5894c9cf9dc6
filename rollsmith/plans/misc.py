"""Queries of the small operators (O1-O18), extension points (E1-E6), and the remaining sorts and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import registry as G
from rollsmith.functions import scorers as R
from rollsmith.functions import text as X
from rollsmith.functions import tokens as T
from rollsmith.operators import advantage as A
from rollsmith.operators import managers
from rollsmith.operators import misc as M
from rollsmith.operators import windows as W
from rollsmith.operators.losses import gpg_loss
from rollsmith.operators.ranking import indexed
from rollsmith.plans.advantage import token_arrays, token_rows
from rollsmith.plans.metrics import rounded
from rollsmith.plans.registry import TOKENS_SQL, Tables, query
from rollsmith.sources import games
from rollsmith.sources.scratch import scratch
from rollsmith.streaming import commits
from rollsmith.streaming import streams as Z


@query("o1_trained_player", """SELECT conv_id, (list(role ORDER BY turn) FILTER (length(left(trim(text), 150)) > 20 AND role = 'assistant'))[1] AS player FROM conversations GROUP BY conv_id""")
def o1(t: Tables) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("player"), F.concat(F.lit("[message]"), "text").alias("message"))))
    games_ = t.conversations.groupBy("conv_id").agg(cells.alias("turns"), F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("f"))
    block = F.coalesce(F.array_join(F.transform(F.filter("turns", lambda m: m["player"] == "assistant"), lambda m: m["message"]), " "), F.lit(""))
    return games_.select("conv_id", M.trained_player(F.col("turns"), block).alias("player"))


@query("o2_questions_by_round", "SELECT lang, round(avg(q), 9) AS mean_questions, count(*) AS n FROM (SELECT lang, doc_id, sum(length(s) - length(replace(s, '?', ''))) AS q FROM (SELECT lang, doc_id, replace(text, '.', '?') AS s FROM documents) GROUP BY ALL) GROUP BY lang")
def o2(t: Tables) -> DataFrame:
    return rounded(M.questions_by_round(t.documents.select("lang", "doc_id", F.replace("text", F.lit("."), F.lit("?")).alias("s")), "lang", "doc_id", "s"), 9)


@query("o3_project_totals", "SELECT count(*) AS calls, round(sum(value), 4) AS cost, (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events WHERE user_id < 50) AS models FROM events WHERE user_id < 50")
def o3(t: Tables) -> DataFrame:
    return rounded(M.project_totals(t.events, "value", "event_type", F.col("user_id") < 50), 4)


@query("o4_passages", "SELECT n_regionkey, string_agg('Doc ' || rn || ' (Title: ' || n_name || ')' || chr(10) || 'key ' || n_nationkey || chr(10) || chr(10), '' ORDER BY rn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY n_regionkey")
def o4(t: Tables) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat("n_name", F.lit("\nkey "), "n_nationkey").alias("p"))))
    return t.nation.groupBy("n_regionkey").agg(F.transform(cells, lambda x: x["p"]).alias("ps")).select("n_regionkey", M.passages("ps").alias("text"))


@query("o5_left_pad_positions", f"WITH {TOKENS_SQL} SELECT seq, sum(p)::BIGINT AS total FROM (SELECT seq, greatest(sum(mask) OVER (PARTITION BY seq ORDER BY t) - 1, 0) AS p FROM tok) GROUP BY seq")
def o5(t: Tables) -> DataFrame:
    return token_arrays(t, "mask").select("seq", F.aggregate(M.left_pad_positions("mask"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("o6_unpad_index", f"WITH {TOKENS_SQL} SELECT seq * 32 + t - 1 AS position FROM tok WHERE mask > 0")
def o6(t: Tables) -> DataFrame:
    return M.unpad_index(token_arrays(t, "mask"), "seq", "mask", 32)


@query("o6_cumulative_lengths", f"WITH {TOKENS_SQL}, n AS (SELECT seq // 64 AS batch, seq, sum(mask) AS n FROM tok GROUP BY seq) SELECT batch, seq, sum(n) OVER (PARTITION BY batch ORDER BY seq)::BIGINT AS \"end\", (sum(n) OVER (PARTITION BY batch ORDER BY seq) - n)::BIGINT AS start FROM n")
def o6b(t: Tables) -> DataFrame:
    return M.cumulative_lengths(token_arrays(t, "mask").withColumn("batch", F.floor(F.col("seq") / 64)), "batch", "seq", "mask")


@query("o7_temperature", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / 0.7)), 6) AS total FROM embeddings")
def o7(t: Tables) -> DataFrame:
    return rounded(t.embeddings.select("vec_id", T.total(M.temperature(F.col("embedding").cast("array<double>"), 0.7)).alias("total")))


@query("o8_prompt_and_response", "SELECT vec_id, 10 AS prompt, 20 AS response, round(embedding[11]::DOUBLE, 6) AS first FROM embeddings")
def o8(t: Tables) -> DataFrame:
    prompt, response = M.prompt_and_response(F.col("embedding").cast("array<double>"), F.lit(10), 50, 20)
    return rounded(t.embeddings.select("vec_id", F.size(prompt).alias("prompt"), F.size(response).alias("response"), F.get(response, F.lit(0)).alias("first")))


@query("o9_final_check", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'lengths differ' WHEN turn % 3 = 1 THEN 'ok' ELSE 'text differs' END AS status FROM conversations")
def o9(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.array(F.lit(1), F.lit(2)).alias("a"), F.when(F.col("turn") % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("b"), F.col("text").alias("want"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(F.concat("text", F.lit("x"))).alias("got"))
    return rows.select("conv_id", "turn", M.final_check(["a", "b"], "want", "got", "ignore_whitespace").alias("status"))


@query("o10_size_in_gib", "SELECT round(sum(octet_length(encode(text)) + octet_length(encode(lang))) / 1073741824, 12) AS gib FROM documents")
def o10(t: Tables) -> DataFrame:
    return rounded(M.size_in_gib(t.documents, ["text", "lang"], {}), 12)


@query("o11_pretty_table", "SELECT n_nationkey, lpad(n_name, greatest(12, length(n_name))::INT, ' ') || '           -' || chr(10) || lpad(n_nationkey::VARCHAR, 12, ' ') AS text FROM nation")
def o11(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", M.pretty_table(F.array(F.array("n_name", F.lit("")), F.array(F.col("n_nationkey").cast("string")))).alias("text"))


@query("o12_verdict", "SELECT event_id, (event_id % 2 = 0)::INT::DOUBLE AS score FROM events")
def o12(t: Tables) -> DataFrame:
    return t.events.select("event_id", M.verdict(F.concat(F.lit("so \\boxed{"), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit("}"))).alias("score"))


@query("o13_batch_normed", f"WITH {TOKENS_SQL}, c AS (SELECT seq, t, reward, sum(reward) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM tok) SELECT seq, t, round(reward / ((SELECT max(abs(s)) FROM c) + 1e-6), 9) AS reward FROM c")
def o13(t: Tables) -> DataFrame:
    return rounded(M.batch_normed(token_rows(t).select("seq", "t", "reward"), "reward"), 9)


@query("o14_sequence_log_prob", f"WITH {TOKENS_SQL} SELECT seq, round(coalesce(sum(lp) FILTER (nxt > 0), 0), 9) AS total, round(avg(lp) FILTER (nxt > 0), 9) AS mean FROM (SELECT seq, lp, lead(mask) OVER (PARTITION BY seq ORDER BY t) AS nxt FROM tok) GROUP BY seq")
def o14(t: Tables) -> DataFrame:
    a = token_arrays(t, "lp", "mask").withColumn("labels", F.transform("mask", lambda m: F.when(m > 0, 5).otherwise(-100)))
    return rounded(a.select("seq", M.sequence_log_prob("lp", "labels").alias("total"), M.sequence_log_prob("lp", "labels", mean=True).alias("mean")), 9)


@query("o15_prime_batch_metrics", f"WITH {TOKENS_SQL} SELECT round(avg(s), 9) AS score_mean, max(n) AS length_max, round(avg(n), 9) AS length_mean FROM (SELECT sum(reward * mask) AS s, sum(mask)::BIGINT AS n FROM tok GROUP BY seq)")
def o15(t: Tables) -> DataFrame:
    per = token_rows(t).groupBy("seq").agg(F.sum(F.col("reward") * F.col("mask")).alias("s"), F.sum("mask").alias("n"))
    return rounded(per.agg(F.avg("s").alias("score_mean"), F.max("n").alias("length_max"), F.avg("n").alias("length_mean")), 9)


@query("o16_text_export", "SELECT count(*) + count(DISTINCT conv_id) AS lines FROM (SELECT conv_id, unnest(string_split(text, chr(10))) FROM conversations)")
def o16(t: Tables) -> DataFrame:
    path = scratch(t.spark, "export")
    M.text_export(t.conversations.withColumn("reward", F.lit(1.0)), path, "conv_id", "turn", "role", "text", "reward")
    return t.spark.read.text(path).agg(F.count("*").alias("lines"))


@query("o17_preference_ids", "SELECT n_nationkey, 6 AS size, (n_nationkey || ',2,0,0,0,0') AS chosen, '7,7,7,7,7,7' AS rejected FROM nation")
def o17(t: Tables) -> DataFrame:
    both = M.preference_ids(F.array("n_nationkey"), F.array_repeat(F.lit(7), 9), 6, 0, 2)
    text = lambda i: F.array_join(both[i].cast("array<string>"), ",")
    return t.nation.select("n_nationkey", F.size(both[0]).alias("size"), text(0).alias("chosen"), text(1).alias("rejected"))


@query("o18_nested_key", "SELECT n_nationkey, n_name AS answer FROM nation")
def o18(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", F.array(F.struct(F.struct(F.array("n_name").alias("answer")).alias("info"))).alias("extra"))
    return rows.select("n_nationkey", M.nested(rows, "extra", ["info", "answer"]).alias("answer"))


@query("e1_custom_reward", "SELECT event_id, round(value / 100 + 0.25, 9) AS score FROM events")
def e1(t: Tables) -> DataFrame:
    mine = G.Registry("scorer")
    mine.register("shifted", lambda value, by: value / 100 + by)
    return t.events.select("event_id", F.round(mine.get("shifted", by=0.25)(F.col("value")), 9).alias("score"))


@query("e2_reward_managers", """SELECT 'naive' AS manager, count(*) AS n, sum((event_id % 3 = 0)::INT)::DOUBLE AS total FROM events UNION ALL SELECT 'batch', count(*), sum(length(event_type))::DOUBLE FROM events
UNION ALL SELECT 'prime', count(*), sum(CASE WHEN event_id % 3 = 0 THEN user_id ELSE 0 END)::DOUBLE FROM events
UNION ALL SELECT 'dapo', count(*), round(sum(1 + least(-(event_id % 100 - 80) / 20.0 * 0.5, 0)), 6) FROM events""")  # fmt: skip
def e2(t: Tables) -> DataFrame:
    rows = t.events.withColumn("answer", F.concat(F.lit("#### "), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(-1))).withColumn("length", F.col("event_id") % 100).withColumn("source", F.lit("openai/gsm8k")).withColumn("truth", F.col("user_id").cast("string"))
    number = F.when(F.col("event_id") % 3 == 0, F.col("truth")).otherwise("no number")
    found = {
        "naive": managers.managed("naive", rows, source="source", solution="answer", truth="truth"),
        "batch": managers.managed("batch", rows, solution="event_type", truth="truth", score=lambda a, b: [float(len(x)) for x in a]),
        "prime": managers.managed("prime", rows.withColumn("truth", number), solution="answer", truth="truth", score=lambda a, b: float(b)),
        "dapo": managers.managed("dapo", rows, score=F.lit(1.0), length="length", most=100, buffer=20, factor=0.5),
    }
    return reduce(DataFrame.union, [rows.agg(F.lit(name).alias("manager"), F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total")) for name, rows in found.items()])


@query("e3_struct_scores", "SELECT event_id, (user_id % 2)::DOUBLE AS score, event_type || '!' AS note FROM events")
def e3(t: Tables) -> DataFrame:
    score = G.guarded(lambda a, b: {"score": float(int(b) % 2), "note": a + "!"}, {"score": "double", "note": "string"})
    return t.events.select("event_id", score(F.col("event_type"), F.col("user_id").cast("string")).alias("r")).select("event_id", "r.*")


@query("e4_failing_scorer", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE ELSE 0 END AS score FROM events")
def e4(t: Tables) -> DataFrame:
    score = G.guarded(lambda a, b: float(b))
    return t.events.select("event_id", score(F.lit(""), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("no number")).alias("score"))


@query("e5_batched_scorer", "SELECT event_id, length(event_type)::DOUBLE AS score FROM events")
def e5(t: Tables) -> DataFrame:
    return t.events.select("event_id", G.batched(lambda a, b: [float(len(x)) for x in a])(F.col("event_type"), F.lit("")).alias("score"))


def _refused(register, *arguments) -> bool:
    try:
        register(*arguments)
    except ValueError:
        return True
    return False


@query("e6_loss_and_estimator_registries", f"""WITH {TOKENS_SQL} SELECT 'gpg' AS name, round(sum(-lp * (reward - 0.5) * mask) / (sum(mask) + 1e-8), 9) AS loss, false AS same_refused, true AS other_refused FROM tok
UNION ALL SELECT 'twice', round(2 * sum(-lp * (reward - 0.5) * mask) / (sum(mask) + 1e-8), 9), false, true FROM tok""")  # fmt: skip
def e6(t: Tables) -> DataFrame:
    rows, mine = token_rows(t).withColumn("advantage", F.col("reward") - 0.5), G.Registry("loss")
    twice = mine.register("twice", lambda tokens, by: gpg_loss(tokens).withColumn("loss", F.col("loss") * by))
    mine.register("gpg", gpg_loss)
    found = [("gpg", gpg_loss, mine.get("gpg")(rows)), ("twice", twice, mine.get("twice", by=2)(rows))]
    estimators = _refused(A.register("grpo"), A.grpo), _refused(A.register("grpo"), A.rloo)
    refused = lambda name, own: (F.lit(_refused(mine.register, name, own) or estimators[0]).alias("same_refused"), F.lit(_refused(mine.register, name, rounded) and estimators[1]).alias("other_refused"))
    return rounded(reduce(DataFrame.union, [loss.select(F.lit(name).alias("name"), "loss", *refused(name, own)) for name, own, loss in found]), 9)


@query("e7_custom_source_and_sampler", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def e7(t: Tables) -> DataFrame:
    sources, samplers = G.Registry("source"), G.Registry("sampler")
    sources.register("orders_by_status", lambda tables, status: tables.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"))
    samplers.register("cheap_first", lambda rows: indexed(rows, ["o_totalprice", "o_orderkey"], "place").withColumn("place", F.col("place") + 1))
    return samplers.get("cheap_first")(sources.get("orders_by_status", status="O")(t)).select("o_orderkey", "place")


@query("t3_sorted_steps", "SELECT n_regionkey, n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place FROM nation")
def t3(t: Tables) -> DataFrame:
    from rollsmith.operators.ranking import indexed

    return indexed(t.nation.select("n_regionkey", "n_nationkey"), ["n_regionkey", "n_nationkey"], "place").withColumn("place", F.col("place") + 1)


@query("k7_example_report", "SELECT place, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, CASE WHEN rn <= 2 THEN 'worst' WHEN rn > n - 2 THEN 'best' WHEN rn > n // 2 - 1 AND rn <= n // 2 + 1 THEN 'median' END AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents)) WHERE place IS NOT NULL GROUP BY place")
def k7(t: Tables) -> DataFrame:
    rows = W.best_median_worst(t.documents.select("doc_id", "n_chars"), "n_chars", ["doc_id"], 2)
    return rows.groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("u20_seeded_sampler", "SELECT count(DISTINCT p) AS places, count(*) AS n FROM (SELECT r_regionkey AS p FROM region)")
def u20(t: Tables) -> DataFrame:
    from rollsmith.operators.splits import sampler_order

    return sampler_order(t.region, "random", ["r_regionkey"], seed=3).agg(F.count_distinct("order_key").alias("places"), F.count("*").alias("n"))


@query("z3_pipelined_steps", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def z3(t: Tables) -> DataFrame:
    path, rows = scratch(t.spark, "arrivals"), t.events.select("event_id", "value")
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    done = scratch(t.spark, "consumed")
    commits.one_ahead(Z.source(t.spark, path, rows.schema, 1), "steps", lambda b: b.where("value is not null"), lambda b, n: commits.write_number(b, done, n))
    return t.spark.read.parquet(done).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("z6_resumed_stream", "SELECT count(*) AS n FROM events")
def z6(t: Tables) -> DataFrame:
    path, out, checkpoint = (scratch(t.spark, n) for n in ("arrivals", "resumed", "checkpoint"))
    rows = t.events.select("event_id")
    rows.where("event_id % 2 = 0").write.parquet(path)
    for part in (None, rows.where("event_id % 2 = 1")):
        if part is not None:
            part.write.mode("append").parquet(path)
        stream = Z.source(t.spark, path, rows.schema, 8)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("z8_sessions", """SELECT user_id, count(*) AS sessions FROM (SELECT user_id, s, max(ts) AS last FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
SELECT user_id, ts, (coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true))::INT AS new FROM events)) GROUP BY ALL)
WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY user_id""")  # fmt: skip
def z8(t: Tables) -> DataFrame:
    from rollsmith.plans.records import _stream

    return Z.drain(Z.sessions(_stream(t), "ts", ["user_id"], "6 hours"), "sessions").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("s13_game_groups", "SELECT (range // 4)::BIGINT AS grp, 1::BIGINT AS states, 4::BIGINT AS n FROM range(8) GROUP BY ALL")
def s13(t: Tables) -> DataFrame:
    g = games.games(t.spark, 8, seed=3, group_size=4)
    return g.groupBy(F.floor(F.col("game_id") / 4).alias("grp")).agg(F.count_distinct(F.to_json("table")).alias("states"), F.count("*").alias("n"))


@query("r17_library_verifier", "SELECT event_id, CASE WHEN false THEN 1.0 END::DOUBLE AS score FROM events")
def r17(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.library_verified(F.col("event_type"), F.col("event_type")).alias("score"))


@query("x20_role_marks", "SELECT item_id, greatest((length(text) - length(replace(text, 'the', ''))) // 3, (length(text) - length(replace(text, 'and', ''))) // 3)::BIGINT AS turns FROM benchmark")
def x20(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.turns_by_marks("text", "the", "and").alias("turns"))
