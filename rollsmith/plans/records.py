"""Queries of records (P6-P19), JSON (N1-N7), proposals (X7), sources (S1-S15), sinks (K1-K8), streams (Z1-Z5) and the offline round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith import schemas
from rollsmith.functions import text as X
from rollsmith.operators import records as R
from rollsmith.operators import rollouts as O
from rollsmith.plans.metrics import rounded
from rollsmith.plans.registry import Tables, query
from rollsmith.sources import games as G
from rollsmith.sources import readers as S
from rollsmith.sources import sinks as K
from rollsmith.sources.scratch import scratch
from rollsmith.streaming import streams as Z
from rollsmith.streaming.commits import step_log
from rollsmith.streaming.groups import closing_state, gather_closing


def _messages(t: Tables) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return t.conversations.groupBy("conv_id").agg(cells.alias("x")).select("conv_id", F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("p6_prompt_records", "SELECT 'bench' AS data_source, text || ' Think.' AS content, item_id::VARCHAR AS truth, row_number() OVER (ORDER BY item_id) - 1 AS index FROM benchmark")
def p6(t: Tables) -> DataFrame:
    found = R.prompt_records(t.benchmark, source="bench", question=F.col("text"), answer=F.col("item_id").cast("string"), order=["item_id"], split="train", instruction=" Think.")
    return found.select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"))


@query("p7_map_examples", "SELECT 'x' || item_id AS id, length(text) AS n FROM benchmark")
def p7(t: Tables) -> DataFrame:
    return R.map_examples(t.benchmark, lambda d: [F.concat(F.lit("x"), "item_id").alias("id"), F.length("text").cast("long").alias("n")])


@query("p8_shuffled_choices", "SELECT n_nationkey, 4 AS choices, true AS found FROM nation")
def p8(t: Tables) -> DataFrame:
    rows = R.shuffled_choices(t.nation, F.col("n_name"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), ["n_nationkey"], 7)
    at = F.array_position(F.split(F.lit("ABCDEFGHIJ"), ""), F.col("letter")).cast("int")
    return rows.select("n_nationkey", F.size("choices").alias("choices"), (F.element_at("choices", at) == F.col("n_name")).alias("found"))


@query("p9_search_records", "SELECT 'searchR1_' || source AS data_source, 'Q: ' || text AS content, doc_id AS index, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS truth FROM documents")
def p9(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.col("text").alias("q"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("truth"), F.array("source").alias("golds"))
    found = R.search_records(rows, question="q", truth=F.col("truth"), golds=F.col("golds"), source="source", index="doc_id", split="test", system="s", prefix="Q: ")
    return found.select("data_source", F.col("prompt")[1]["content"].alias("content"), F.col("extra_info.index").alias("index"), F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth")[0].alias("truth"))


@query("p10_cleaned", "SELECT item_id, replace(regexp_replace(replace(trim('  ' || text || ' [title] x [note] y  z '), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS text FROM benchmark")
def p10(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.cleaned(F.concat(F.lit("  "), "text", F.lit(" [title] x [note] y  z "))).alias("text"))


@query("p11_unrolled_preferences", "SELECT n_name AS prompt, 'chosen' AS kind, n_nationkey::VARCHAR AS response FROM nation UNION ALL SELECT n_name, 'rejected', n_regionkey::VARCHAR FROM nation")
def p11(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_name").alias("prompt"), F.col("n_nationkey").cast("string").alias("chosen"), F.col("n_regionkey").cast("string").alias("rejected"))
    return R.unrolled_preferences(rows)


@query("p12_perspectives", """SELECT conv_id, p AS player, (i - 1)::INT AS at, CASE WHEN r = p THEN 'assistant' ELSE 'user' END AS role, c AS content FROM (SELECT conv_id, p, generate_subscripts(cs, 1) AS i, unnest(rs) AS r, unnest(cs) AS c FROM (
SELECT conv_id, list(role ORDER BY turn) AS rs, list(text ORDER BY turn) AS cs FROM conversations WHERE role <> 'system' GROUP BY conv_id), (SELECT unnest(['user', 'assistant']) AS p))""")  # fmt: skip
def p12(t: Tables) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "system", "note").otherwise("message").alias("type"), F.col("role").alias("player"), F.col("text").alias("message"))))
    log = t.conversations.groupBy("conv_id").agg(cells.alias("log"))
    return R.perspectives(log, "conv_id", "log", ["user", "assistant"]).select("conv_id", "player", F.posexplode("messages").alias("at", "m")).select("conv_id", "player", "at", "m.*")


@query("p13_typed_content", "SELECT item_id, 'text,image,text,video' AS kinds, 'a ' || item_id || '|#| b|#' AS texts FROM benchmark")
def p13(t: Tables) -> DataFrame:
    parts = R.typed_content(F.concat(F.lit("a "), "item_id", F.lit("<image> b<video>")))
    return t.benchmark.select("item_id", F.array_join(F.transform(parts, lambda p: p["type"]), ",").alias("kinds"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("#"))), "|").alias("texts"))


@query("p14_tagged_messages", "SELECT item_id, 'assistant,tool,assistant' AS roles, 'think||so ' || item_id AS contents, 'x=' || item_id AS code FROM benchmark".replace("'think||so '", "'think|out|so '"))
def p14(t: Tables) -> DataFrame:
    m = R.tagged_messages(F.concat(F.lit("think <code>```python\nx="), "item_id", F.lit("\n```</code><interpreter> out</interpreter> so <answer>"), "item_id", F.lit("</answer>")))
    return t.benchmark.select("item_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.array_join(F.transform(m, lambda x: x["content"]), "|").alias("contents"), m[0]["code"].alias("code"))


@query("p15_agent_records", "SELECT lower(r_name) AS data_source, 'Solve.' || r_name || ' Box it.' AS content, r_regionkey::VARCHAR AS truth FROM region")
def p15(t: Tables) -> DataFrame:
    found = R.agent_records(t.region, source=F.concat(F.lit("Org/"), "r_name"), problem=F.concat(F.lit("Solve."), "r_name"), answer=F.col("r_regionkey"), format_=" Box it.")
    return found.select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"))


@query("p16_game_prompts", "SELECT n_regionkey, 'Assign every paper.' || chr(10) || string_agg(n_nationkey || ',' || length(n_name), chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def p16(t: Tables) -> DataFrame:
    tables = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array("n_nationkey", F.length("n_name")))).alias("table"))
    return R.game_prompts(tables.withColumn("best", F.lit(0.0)), "n_regionkey", "table", "best").select("n_regionkey", F.col("prompt")[0]["content"].alias("content"))


@query("p19_table_view", """SELECT vec_id, ',A,B,C,D,E,F,G,H' || array_to_string(list_transform(range(8), lambda r: ';r' || (r + 1) || ',' || array_to_string(
list_transform(embedding[r * 8 + 1 : r * 8 + 8], lambda x: CASE WHEN x > 0 THEN trunc(x::DOUBLE * 250)::INT::VARCHAR ELSE '' END), ',')), '') AS view FROM embeddings""")  # fmt: skip
def p19(t: Tables) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("embedding").cast("array<double>"), r * 8 + 1, F.lit(8)))
    view = R.table_view(cells, F.transform(cells, lambda r: F.transform(r, lambda v: (v > 0).cast("int"))), F.lit(250.0), list("ABCDEFGH"), [f"r{i}" for i in range(1, 9)])
    return t.embeddings.select("vec_id", F.array_join(F.transform(view, lambda r: F.array_join(r, ",")), ";").alias("view"))


@query("n1_reward_chain", "SELECT event_id, (props->>'$.k')::DOUBLE AS reward FROM events")
def n1(t: Tables) -> DataFrame:
    return R.reward_chain(t.events.select("event_id", "props"), ["game_normalized_reward"], "props", ["reward", "k"]).select("event_id", "reward")


@query("n1_reward_chain_incomplete", "SELECT event_id, NULL::DOUBLE AS reward FROM events")
def n1b(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") > 3, F.col("props")).alias("props"))
    return R.reward_chain(rows, [], "props", ["k"]).select("event_id", "reward")


@query("n2_turn_count", "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 7 WHEN 1 THEN count(*) ELSE greatest(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')) END::INT AS turns FROM conversations GROUP BY conv_id")
def n2(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_join(F.collect_list("role"), " ").alias("said"), F.to_json(F.collect_list(F.struct(F.col("turn").cast("int"), F.col("role").alias("player"), F.lit("x").alias("message")))).alias("c"))
    info, conversation = F.when(F.col("conv_id") % 3 == 0, F.lit('{"num_messages": 7}')), F.when(F.col("conv_id") % 3 == 1, F.col("c"))
    return rows.select("conv_id", R.turn_count(info, conversation, F.col("said")).alias("turns"))


@query("n3_game_details", "SELECT event_id, event_id % 2 = 0 AS completed, (event_id % 2 * 5)::INT AS num_messages, 0.0 AS game_normalized_reward FROM events")
def n3(t: Tables) -> DataFrame:
    info = F.when(F.col("event_id") % 2 == 0, F.lit('{"completed": true}')).otherwise(F.lit('{"num_messages": 5, "completed": null}'))
    return t.events.select("event_id", R.game_details(info).alias("g")).select("event_id", "g.completed", "g.num_messages", "g.game_normalized_reward")


@query("n4_required_keys", "SELECT doc_id, text FROM documents")
def n4(t: Tables) -> DataFrame:
    return schemas.require(t.documents, ["doc_id", "text"]).select("doc_id", "text")


@query("n5_chat_errors", """SELECT conv_id, CASE WHEN count(*) < 2 THEN 'too short' ELSE '' END AS errors FROM conversations GROUP BY conv_id""")
def n5(t: Tables) -> DataFrame:
    return _messages(t).select("conv_id", F.array_join(R.chat_errors("messages"), "; ").alias("errors"))


@query("n6_flattened", "SELECT r_regionkey AS \"a/key\", r_name AS \"a/b/name\" FROM region")
def n6(t: Tables) -> DataFrame:
    return schemas.flat(t.region.select(F.struct(F.col("r_regionkey").alias("key"), F.struct(F.col("r_name").alias("name")).alias("b")).alias("a")))


@query("n7_preferred_reward", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0.5 END AS reward FROM events")
def n7(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("normalized_reward"), F.lit(0.5).alias("reward"))
    return rows.select("event_id", R.preferred_reward(rows).alias("reward"))


@query("x7_proposals", """SELECT event_id, (['ok', 'no header', 'wrong number of lines', 'unknown name', 'column repeated'])[1 + event_id % 5] AS status, CASE WHEN event_id % 5 = 0 THEN '1:0,0:1' END AS pairs FROM events""")
def x7(t: Tables) -> DataFrame:
    texts = ["Let us. Proposal:<br/>&emsp; - **BLEU**: Bob Lee<br/>- GloVe: Ann\nthanks", "- BLEU: Ann", "Proposal:\n- BLEU: Ann", "Proposal:\n- BLEU: Ann\n- GloVe: Nobody", "Proposal:\n- BLEU: Ann\n- the BLEU: Bob"]
    said = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 5 + 1).cast("int"))
    p = R.proposal(said, ["Ann Roe", "Bob Lee"], ["BLEU", "GloVe"])
    return t.events.select("event_id", p.alias("p")).select("event_id", "p.status", F.array_join(F.transform("p.pairs", lambda x: F.concat_ws(":", x["row"], x["column"])), ",").alias("pairs"))


@query("s1_parquet_many", "SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region")
def s1(t: Tables) -> DataFrame:
    return S.parquet(t.spark, f"{t.folder}/region.parquet", f"{t.folder}/region.parquet").select("r_regionkey")


@query("s2_pretokenized", "SELECT l_orderkey AS game_id, l_orderkey // 8 AS group_index, count(*) AS n FROM lineitem GROUP BY ALL")
def s2(t: Tables) -> DataFrame:
    path = scratch(t.spark, "rollouts")
    ids = t.lineitem.groupBy(F.col("l_orderkey").alias("game_id")).agg(F.sort_array(F.collect_list("l_partkey")).alias("input_ids"))
    K.parquet(ids.select("*", *[F.transform("input_ids", lambda x: F.lit(1)).alias(c) for c in ("attention_mask", "position_ids", "loss_mask")], F.lit(1.0).alias("sample_weight")), path)
    return S.pretokenized(t.spark, path).select("game_id", "group_index", F.size("input_ids").cast("long").alias("n"))


@query("s3_json_lines", "SELECT n_nationkey, n_name FROM nation")
def s3(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lines")
    t.nation.write.json(path)
    return S.json_lines(t.spark, path, "n_nationkey int, n_name string")


@query("s4_json_lines_permissive", "SELECT n_nationkey, n_name FROM nation")
def s4(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lines")
    t.nation.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).union(t.region.select(F.lit("{broken").alias("value"))).write.text(path)
    return S.json_lines(t.spark, path, "n_nationkey int, n_name string", strict=False)


@query("s5_first_lines", "SELECT n_nationkey FROM nation WHERE n_nationkey < 7")
def s5(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lines")
    t.nation.select(F.to_json(F.struct("n_nationkey")).alias("value"), "n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    return S.first_lines(t.spark, path, 7, "n_nationkey int")


@query("s6_step_files", "SELECT r_regionkey::BIGINT AS step, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey")
def s6(t: Tables) -> DataFrame:
    path = scratch(t.spark, "steps")
    for r in range(5):
        one = t.nation.where(F.col("n_regionkey") == r).agg(F.collect_list(F.struct("n_nationkey")).alias("episodes"))
        one.select(F.to_json(F.struct("episodes")).alias("value")).coalesce(1).write.text(f"{path}/step_{r}")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"step_(\d+)", 1).cast("long")
    return t.spark.read.schema("episodes array<struct<n_nationkey:int>>").json(f"{path}/step_*").select(number.alias("step"), F.explode("episodes").alias("e")).select("step", "e.n_nationkey")


@query("s7_experiment_logs", "SELECT n_regionkey::VARCHAR AS experiment, n_nationkey FROM nation")
def s7(t: Tables) -> DataFrame:
    path = scratch(t.spark, "logs")
    t.nation.select(F.col("n_regionkey").cast("string").alias("e"), F.to_json(F.struct("n_nationkey")).alias("value")).write.partitionBy("e").text(path)
    return S.experiment_logs(t.spark, path, "n_nationkey int").withColumn("experiment", F.replace("experiment", F.lit("e="), F.lit("")))


@query("s8_round_folders", "SELECT n_regionkey AS round, n_nationkey FROM nation WHERE n_regionkey < 3")
def s8(t: Tables) -> DataFrame:
    path = scratch(t.spark, "rounds")
    for r in range(3):
        K.parquet(t.nation.where(F.col("n_regionkey") == r).select("n_nationkey"), f"{path}/round_{r}/train.parquet")
    return S.rounds(t.spark, path)


@query("s9_fallback_scan", "SELECT r_name FROM region")
def s9(t: Tables) -> DataFrame:
    return S.first_existing(t.spark, f"{t.folder}/region_trimmed.parquet", f"{t.folder}/region.parquet").select("r_name")


@query("s10_split_slice", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > floor((SELECT count(*) FROM orders) * 0.75)")
def s10(t: Tables) -> DataFrame:
    return S.split_slice(t.orders.select("o_orderkey"), ["o_orderkey"], 0.75, 1.0)


@query("s12_losses_from_log", "SELECT 0.0 AS first, 2.4 AS last, 25::BIGINT AS n")
def s12(t: Tables) -> DataFrame:
    path = scratch(t.spark, "log")
    t.nation.coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat(F.lit("step "), "n_nationkey", F.lit(" {'val/loss': "), F.col("n_nationkey") / 10, F.lit("}")).alias("value")).write.text(path)
    return S.losses_from_log(t.spark, path)


@query("s13_games")
def s13(t: Tables) -> DataFrame:
    return G.games(t.spark, 16, seed=7, group_size=2).select("game_id", F.to_json("table").alias("table"), "best", "draws")


@query("s14_appended", "SELECT item_id FROM benchmark UNION ALL SELECT conv_id FROM conversations WHERE turn = 0 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) <= 30")
def s14(t: Tables) -> DataFrame:
    return S.appended(t.benchmark.select("item_id", "text"), t.conversations.where("turn = 0").select(F.col("conv_id").alias("item_id"), "text"), "text", 30).select("item_id")


@query("k1_parquet_partitions", "SELECT r_regionkey, r_name FROM region")
def k1(t: Tables) -> DataFrame:
    path = scratch(t.spark, "table")
    K.parquet(t.region, path, ["r_regionkey"])
    return t.spark.read.schema("r_name string, r_regionkey int").parquet(path)


@query("k2_generations", "SELECT turn::VARCHAR AS input, role AS output, 0.5 AS score, 3 AS step FROM conversations")
def k2(t: Tables) -> DataFrame:
    path = scratch(t.spark, "generations")
    K.generations(t.conversations.select(F.col("turn").cast("string").alias("input"), F.col("role").alias("output"), F.lit(0.5).alias("score")), path, 3)
    return S.json_lines(t.spark, path, "input string, output string, score double, step int")


@query("k3_threshold_files", """SELECT threshold, split, n FROM (SELECT 0.5::DOUBLE AS threshold, count(*) AS c FROM events WHERE value / 100 >= 0.5 UNION ALL SELECT 0.9, count(*) FROM events WHERE value / 100 >= 0.9),
LATERAL (SELECT 'train' AS split, floor(c * 0.9)::BIGINT AS n UNION ALL SELECT 'val', (c - floor(c * 0.9))::BIGINT)""")  # fmt: skip
def k3(t: Tables) -> DataFrame:
    path = scratch(t.spark, "thresholds")
    K.by_threshold(t.events.select("event_id", (F.col("value") / 100).alias("r")), path, "r", [0.5, 0.9], ["event_id"])
    rows = t.spark.read.option("basePath", path).parquet(f"{path}/threshold=*")
    return rows.groupBy(F.col("threshold").cast("double").alias("threshold"), "split").agg(F.count("*").alias("n"))


@query("k4_statistics_file", "SELECT 'mean: ' || round(avg(l_tax), 4) AS line FROM lineitem UNION ALL SELECT 'n: ' || count(*) FROM lineitem")
def k4(t: Tables) -> DataFrame:
    path = scratch(t.spark, "stats") + ".txt"
    mean, n = t.lineitem.agg(F.round(F.avg("l_tax"), 4), F.count("*")).first()
    K.statistics(t.spark, path, {"mean": mean, "n": n})
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("k5_side_file", "SELECT true AS same, false AS other")
def k5(t: Tables) -> DataFrame:
    path = scratch(t.spark, "side") + ".json"
    K.side_file(t.spark, path, {"percentile": 0.6, "seed": 42})
    return t.spark.range(1).select(F.lit(K.done_with(t.spark, path, {"seed": 42, "percentile": 0.6})).alias("same"), F.lit(K.done_with(t.spark, path, {"seed": 1})).alias("other"))


@query("k6_metric_sink", "SELECT 1 AS step, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def k6(t: Tables) -> DataFrame:
    path = scratch(t.spark, "metrics")
    K.metrics(t.events.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value")).withColumn("step", F.lit(1)), path)
    return t.spark.read.parquet(path)


@query("k8_role_files", "SELECT role, count(*) AS n FROM (SELECT CASE role WHEN 'assistant' THEN 'user' WHEN 'user' THEN 'assistant' ELSE role END AS role FROM conversations) GROUP BY role")
def k8(t: Tables) -> DataFrame:
    path = scratch(t.spark, "roles")
    K.role_files(_messages(t), "messages", path)
    return S.json_lines(t.spark, f"{path}/user", f"messages {schemas.MESSAGES}").select(F.explode("messages").alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n"))


@query("m21_tool_runs", "SELECT conv_id, max(run) AS runs FROM (SELECT conv_id, sum(CASE WHEN role = 'tool' AND prev = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, CASE WHEN turn IN (2, 3, 5) THEN 'tool' ELSE role END AS role FROM conversations))) GROUP BY conv_id")
def m21(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn").isin(2, 3, 5), "tool").otherwise(F.col("role")).alias("role"))
    return R.tool_runs(rows, "conv_id", "turn").groupBy("conv_id").agg(F.max("run").alias("runs"))


ROUND_SQL = """r AS (SELECT doc_id, text, n_chars, (doc_id * 7919 % 10007) / 10007.0 AS reward FROM documents), w AS (SELECT *, reward - avg(reward) OVER (PARTITION BY doc_id // 8) AS weight FROM r),
f AS (SELECT * FROM w WHERE NOT contains(text, '!!')), l AS (SELECT * FROM f WHERE n_chars <= (SELECT least(floor(quantile_cont(n_chars, 0.95)), 5000) FROM f)), p AS (SELECT * FROM l WHERE weight > 0),
k AS (SELECT * FROM p WHERE round(weight, 12) >= (SELECT round(quantile_cont(weight, 0.3), 12) FROM p))"""


@query("offline_round", f"WITH {ROUND_SQL} SELECT 'val' AS split, ceil(count(*) * 0.1)::BIGINT AS n FROM k UNION ALL SELECT 'train', (count(*) - ceil(count(*) * 0.1))::BIGINT FROM k")
def offline_round(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", "n_chars", (F.col("doc_id") * 7919 % 10007 / 10007.0).alias("reward"))
    found = O.process(rows, text="text", length="n_chars", reward="reward", game="doc_id", key=["doc_id"], marker="!!", percentile=0.3)
    return found.groupBy("split").agg(F.count("*").alias("n"))


@query("offline_round_rows", f"WITH {ROUND_SQL} SELECT doc_id, round(weight, 9) AS weight FROM k")
def offline_round_rows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", "n_chars", (F.col("doc_id") * 7919 % 10007 / 10007.0).alias("reward"))
    return rounded(O.process(rows, text="text", length="n_chars", reward="reward", game="doc_id", key=["doc_id"], marker="!!", percentile=0.3).select("doc_id", "weight"), 9)


@query("offline_round_record", """WITH r AS (SELECT lang, doc_id, n_chars, (n_chars % 101) / 100.0 AS reward FROM documents), w AS (SELECT *, reward - avg(reward) OVER (PARTITION BY doc_id // 8) AS w FROM r),
c AS (SELECT lang, least(floor(quantile_cont(n_chars, 0.95)), 5000) AS cut FROM w GROUP BY lang)
SELECT lang, count(*) AS rows, count(*) FILTER (n_chars <= cut) AS rows_kept, round(avg(reward), 6) AS mean_reward, round(avg((w > 0)::INT), 6) AS positive_ratio, round(avg((w < 0)::INT), 6) AS negative_ratio,
max(n_chars) AS longest, max(n_chars) FILTER (n_chars <= cut) AS longest_kept, round(avg((reward = 1)::INT) FILTER (n_chars <= cut), 6) AS perfect_ratio_after_trim FROM w JOIN c USING (lang) GROUP BY lang""")  # fmt: skip
def offline_round_record(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "doc_id", "n_chars", ((F.col("n_chars") % 101) / 100.0).alias("reward"))
    return rounded(O.record(rows, length="n_chars", reward="reward", game="doc_id", by=["lang"]))


def _stream(t: Tables, files: int = 4) -> DataFrame:
    """The events as a stream of several files in order of time."""
    path = scratch(t.spark, "arrivals")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(files, "ts").sortWithinPartitions("ts")
    rows.write.parquet(path)
    return Z.source(t.spark, path, rows.schema, files)


@query("z1_arrival_rates", """SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, n, round(n / 3600, 9) AS per_second FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")  # fmt: skip
def z1(t: Tables) -> DataFrame:
    found = Z.drain(Z.rates(_stream(t), "ts", ["event_type"]), "rates")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("per_second", 9).alias("per_second"))


@query("z4_gathered_groups", "SELECT user_id, g AS \"group\", 8 AS n FROM (SELECT user_id, count(*) // 8 AS k FROM events GROUP BY user_id), LATERAL (SELECT unnest(range(k)) AS g)")
def z4(t: Tables) -> DataFrame:
    stream = _stream(t).select("user_id", "value")
    return Z.drain(Z.gather_groups(stream, "user_id", "value", 8), "groups").select("user_id", "group", F.size("values").alias("n"))


@query("z4_closed_groups", """WITH e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) // 1000 AS t, value FROM events), w AS (SELECT max(t) - 600000 AS mark FROM e),
b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 28800000, true)::INT AS first FROM e), l AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t, event_id) AS life FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, life ORDER BY t, event_id) - 1 AS i, min(t) OVER (PARTITION BY user_id, life) AS start, max(t) OVER (PARTITION BY user_id, life) AS last FROM l)
SELECT user_id, start, i // 4 AS "group", count(*)::INTEGER AS n, round(sum(value), 4) AS total, count(*) = 4 AS complete FROM p, w GROUP BY user_id, life, start, last, i // 4, mark
HAVING last + 28800000 <= mark OR count(*) = 4 AND max(t) <= mark""")  # fmt: skip
def z4_closed(t: Tables) -> DataFrame:
    stream = _stream(t).select("user_id", "event_id", "value", "ts")
    with closing_state(t.spark):
        found = Z.drain(gather_closing(stream, "user_id", "value", "event_id", "ts", size=4, gap="8 hours"), "closed")
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4)
    return found.select("user_id", F.unix_millis("start").alias("start"), "group", F.size("values").alias("n"), total.alias("total"), "complete")


@query("z5_rolling_log", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def z5(t: Tables) -> DataFrame:
    log = step_log(_stream(t), "episodes", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return log.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
