"""Queries of batch algebra (P1-P5, P17, P18, U1-U10, U18, T2, J2), splits (U11-U14, U20, T7) and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators import balance as L
from rollsmith.operators import batch as B
from rollsmith.operators import splits as S
from rollsmith.plans.registry import Tables, query


def _batch(t: Tables) -> DataFrame:
    """Events as a batch: position, an id, a value and a label."""
    return t.events.select(F.col("event_id").alias("pos"), "user_id", "value", "event_type")


@query("p1_select_keys", "SELECT event_id AS pos, value FROM events")
def p1(t: Tables) -> DataFrame:
    return B.select_keys(_batch(t), ["value"])


@query("p2_pop", "SELECT event_id AS pos, user_id, event_type FROM events")
def p2(t: Tables) -> DataFrame:
    return B.pop(_batch(t), ["value"])[1]


@query("p3_rename", "SELECT event_id AS pos, user_id, value AS reward, event_type AS kind FROM events")
def p3(t: Tables) -> DataFrame:
    return B.rename(_batch(t), {"value": "reward", "event_type": "kind"})


@query("p4_select_indices", "SELECT (event_id // 7)::BIGINT AS ord, event_id AS pos, user_id, value, event_type FROM events WHERE event_id % 7 = 0")
def p4(t: Tables) -> DataFrame:
    index = t.events.where("event_id % 7 = 0").select(F.expr("event_id div 7").alias("ord"), F.col("event_id").alias("index"))
    return B.take(_batch(t), index)


@query("p5_slice", "SELECT event_id AS pos, value FROM events WHERE event_id >= 100 AND event_id < 900 AND (event_id - 100) % 3 = 0")
def p5(t: Tables) -> DataFrame:
    return B.slice_rows(_batch(t).select("pos", "value"), 100, 900, 3)


@query("p18_transpose_samples", "SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def p18(t: Tables) -> DataFrame:
    return B.columns_to_rows(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text").withColumn("text", F.array_join("text", "|"))


@query("p17_rows_to_columns", "SELECT string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) AS r_regionkey, string_agg(r_name, ',' ORDER BY r_regionkey) AS r_name FROM region")
def p17(t: Tables) -> DataFrame:
    one = t.region.withColumn("pos", F.col("r_regionkey"))
    return B.fold(one, ["r_regionkey", "r_name"], 1 << 30).select(F.array_join(F.col("r_regionkey").cast("array<string>"), ",").alias("r_regionkey"), F.array_join("r_name", ",").alias("r_name"))


@query("u1_concat", "SELECT event_id AS pos, value FROM events UNION ALL SELECT (SELECT count(*) FROM events) + event_id, value FROM events")
def u1(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("pos"), "value")
    return B.concat([rows, rows])


@query("u2_concat_fill", "SELECT r_regionkey AS pos, r_name, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT n_nationkey + 5, NULL, n_name FROM nation")
def u2(t: Tables) -> DataFrame:
    return B.concat([t.region.select(F.col("r_regionkey").alias("pos"), "r_name"), t.nation.select(F.col("n_nationkey").alias("pos"), "n_name")], fill=True)


@query("u3_offset_merge", "SELECT conv_id AS game_id, turn FROM conversations UNION ALL SELECT conv_id + 800, turn FROM conversations")
def u3(t: Tables) -> DataFrame:
    first = t.conversations.select(F.col("conv_id").alias("game_id"), "turn")
    games, group_size = 100, 8
    return first.unionByName(first.withColumn("game_id", F.col("game_id") + games * group_size))


@query("u4_repeat_interleaved", "SELECT event_id * 3 + k AS pos, value FROM events, (SELECT unnest([0, 1, 2]) AS k)")
def u4(t: Tables) -> DataFrame:
    return B.repeat(t.events.select(F.col("event_id").alias("pos"), "value"), 3)


@query("u4_repeat_tiled", "SELECT event_id + k * (SELECT count(*) FROM events) AS pos, value FROM events, (SELECT unnest([0, 1]) AS k)")
def u4b(t: Tables) -> DataFrame:
    return B.repeat(t.events.select(F.col("event_id").alias("pos"), "value"), 2, interleave=False)


@query("u5_repeat_each", "SELECT event_id, c AS copy FROM (SELECT event_id, unnest(range(event_id % 4)) AS c FROM events)")
def u5(t: Tables) -> DataFrame:
    return B.repeat_each(t.events.select("event_id"), F.col("event_id") % 4)


@query("u6_unfold_chunks", "SELECT vec_id, (i // 16)::INT AS chunk, (i % 16)::INT AS at, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)")
def u6(t: Tables) -> DataFrame:
    return B.unfold_chunks(t.embeddings.select("vec_id", "embedding"), ["embedding"], 4).select("vec_id", "chunk", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))


@query("u7_fold", "SELECT event_id // 16 AS row, (event_id % 16)::INT AS at, value AS x FROM events")
def u7(t: Tables) -> DataFrame:
    return B.fold(_batch(t), ["value"], 16).select("row", F.posexplode("value").alias("at", "x"))


@query("u7_unfold", "SELECT event_id AS pos, value FROM events")
def u7b(t: Tables) -> DataFrame:
    return B.unfold(B.fold(_batch(t), ["value"], 16), ["value"], 16)


@query("u8_chunk", "SELECT chunk, count(*) AS n, min(pos) AS first FROM (SELECT event_id AS pos, event_id // ((SELECT count(*) FROM events) + 6) // 7 AS x, event_id // (((SELECT count(*) FROM events) + 6) // 7) AS chunk FROM events) GROUP BY chunk")
def u8(t: Tables) -> DataFrame:
    return B.chunk(_batch(t), 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("u8_split", "SELECT event_id // 333 AS chunk, count(*) AS n FROM events GROUP BY 1")
def u8b(t: Tables) -> DataFrame:
    return B.split(_batch(t), 333).groupBy("chunk").agg(F.count("*").alias("n"))


@query("u9_pad_to_divisor", """SELECT event_id AS pos, value, false AS padded FROM events
UNION ALL SELECT event_id + n, value, true FROM events, (SELECT count(*) AS n FROM events) WHERE event_id < (64 - n % 64) % 64""")  # fmt: skip
def u9(t: Tables) -> DataFrame:
    return B.pad_to_divisor(t.events.select(F.col("event_id").alias("pos"), "value"), 64)


@query("u9_unpad", "SELECT event_id AS pos, value FROM events")
def u9b(t: Tables) -> DataFrame:
    return B.unpad(B.pad_to_divisor(t.events.select(F.col("event_id").alias("pos"), "value"), 64))


@query("u10_mini_batches", "SELECT epoch::INT AS epoch, event_id // 50 AS batch, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(3)) AS epoch) GROUP BY ALL")
def u10(t: Tables) -> DataFrame:
    return B.mini_batches(_batch(t), 50, 3).groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t2_reorder", "SELECT n - 1 - event_id AS pos, value FROM events, (SELECT count(*) AS n FROM events)")
def t2(t: Tables) -> DataFrame:
    n = t.events.count()
    order = t.events.select(F.col("event_id").alias("pos"), (n - 1 - F.col("event_id")).alias("index"))
    return B.reorder(t.events.select(F.col("event_id").alias("pos"), "value"), order)


@query("u18_restore", "SELECT event_id AS pos, value FROM events")
def u18(t: Tables) -> DataFrame:
    n = t.events.count()
    order = t.events.select(F.col("event_id").alias("pos"), F.pmod(F.col("event_id") * 7 + 3, F.lit(n)).alias("index"))
    moved = B.reorder(t.events.select(F.col("event_id").alias("pos"), "value"), order)
    return B.reorder(moved, B.inverse(order))


@query("j2_zip_union", "SELECT event_id AS pos, user_id, value, event_type FROM events")
def j2(t: Tables) -> DataFrame:
    rows = _batch(t)
    return B.zip_union(rows.select("pos", "user_id", "value"), rows.select("pos", "user_id", "event_type"))


@query("u11_split_counts", "SELECT 'train' AS split, floor(count(*) * 0.9)::BIGINT AS n FROM orders UNION ALL SELECT 'val', (count(*) - floor(count(*) * 0.9))::BIGINT FROM orders")
def u11(t: Tables) -> DataFrame:
    return S.split_exact(t.orders.select("o_orderkey"), 0.9, ["o_orderkey"]).groupBy("split").agg(F.count("*").alias("n"))


@query("u12_split_three_counts", """WITH c AS (SELECT count(*) AS n FROM customer) SELECT 'train' AS split, round_even(n * 0.8, 0)::BIGINT AS n FROM c
UNION ALL SELECT 'val', round_even(n * 0.1, 0)::BIGINT FROM c UNION ALL SELECT 'test', (n - round_even(n * 0.8, 0) - round_even(n * 0.1, 0))::BIGINT FROM c""")  # fmt: skip
def u12(t: Tables) -> DataFrame:
    return S.split_three(t.customer.select("c_custkey"), (0.8, 0.1, 0.1), ["c_custkey"]).groupBy("split").agg(F.count("*").alias("n"))


@query("u13_split_ceil_counts", "SELECT 'val' AS split, ceil(count(*) * 0.1)::BIGINT AS n FROM part UNION ALL SELECT 'train', (count(*) - ceil(count(*) * 0.1))::BIGINT FROM part")
def u13(t: Tables) -> DataFrame:
    return S.split_exact(t.part.select("p_partkey"), 0.9, ["p_partkey"], rounding="ceil").groupBy("split").agg(F.count("*").alias("n"))


@query("u14_resample_weights", "SELECT event_id, round(greatest(abs(value) ** 2 + 1e-8, 1e-8) / sum(greatest(abs(value) ** 2 + 1e-8, 1e-8)) OVER (), 12) AS probability FROM events")
def u14(t: Tables) -> DataFrame:
    return S.weighted(t.events.select("event_id", "value"), "value").select("event_id", F.round("probability", 12).alias("probability"))


@query("u14_resample")
def u14b(t: Tables) -> DataFrame:
    drawn = S.resample(t.events.select("event_id", "value"), "value", "event_id")
    return drawn.groupBy("event_id").agg(F.count("*").alias("copies"), F.round(F.first("probability"), 12).alias("probability"))


@query("u20_curriculum_sampler", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INT AS place FROM orders")
def u20(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    keyed = S.sampler_order(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "curriculum", ["o_orderkey"], difficulty="o_totalprice")
    return keyed.select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("order_key")).alias("place"))


@query("t7_top_up", """SELECT event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL (SELECT event_id, value FROM events WHERE event_id % 3 <> 0
QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= (SELECT count(*) // 2 - count(*) FILTER (event_id % 3 = 0) FROM events))""")  # fmt: skip
def t7(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    return S.top_up(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), rows.count() // 2, [F.col("value").desc(), "event_id"])


def _lengths(t: Tables) -> DataFrame:
    return t.orders.select(F.expr("o_orderkey div 512").alias("batch"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 100).alias("length"))


@query("u15_balanced_parts")
def u15(t: Tables) -> DataFrame:
    return L.partition(_lengths(t), "batch", "pos", "length", 8).groupBy("batch", "part").agg(F.sum("length").alias("tokens"), F.count("*").alias("n"))


@query("u16_greedy_parts")
def u16(t: Tables) -> DataFrame:
    return L.partition(_lengths(t), "batch", "pos", "length", 8, method="greedy")


@query("u17_micro_batches", """SELECT batch, tokens, rows, ceil(greatest(least(rows, ceil(tokens / 20000)), 1) / 4)::BIGINT * 4 AS micro_batches FROM (
SELECT o_orderkey // 512 AS batch, sum(floor(o_totalprice / 100))::BIGINT AS tokens, count(*) AS rows FROM orders GROUP BY 1)""")  # fmt: skip
def u17(t: Tables) -> DataFrame:
    return L.micro_batch_count(_lengths(t), ["batch"], "length", 20000, multiple=4)


SERPENTINE_SQL = """SELECT batch, pos, length, CASE WHEN (rn // 8) % 2 = 0 THEN rn % 8 ELSE 7 - rn % 8 END::INT AS part FROM (
SELECT *, row_number() OVER (PARTITION BY batch ORDER BY length DESC, pos) - 1 AS rn FROM (
SELECT o_orderkey // 512 AS batch, o_orderkey AS pos, floor(o_totalprice / 100)::BIGINT AS length FROM orders))"""


@query("u19_serpentine_rebalance", SERPENTINE_SQL)
def u19(t: Tables) -> DataFrame:
    return L.serpentine(_lengths(t), "batch", "pos", "length", 8)


@query("a33_imbalance", f"SELECT batch, min(s)::BIGINT AS least, max(s)::BIGINT AS largest, round(avg(s), 6) AS mean, (max(s) - min(s))::BIGINT AS gap FROM (SELECT batch, part, sum(length) AS s FROM ({SERPENTINE_SQL}) GROUP BY ALL) GROUP BY batch")
def a33(t: Tables) -> DataFrame:
    return L.imbalance(L.serpentine(_lengths(t), "batch", "pos", "length", 8), ["batch"], "part", "length").withColumn("mean", F.round("mean", 6))


@query("t6_micro_batch_order", f"SELECT batch, part, work, first, row_number() OVER (PARTITION BY batch ORDER BY work DESC, first DESC)::INT AS place FROM (SELECT batch, part, sum(length * length)::BIGINT AS work, min(pos) AS first FROM ({SERPENTINE_SQL}) GROUP BY ALL)")
def t6(t: Tables) -> DataFrame:
    return L.micro_batch_order(L.serpentine(_lengths(t), "batch", "pos", "length", 8), ["batch"], "part", "length", "pos")


@query("u15_tree_parts", "SELECT count(*) AS n, sum(floor(o_totalprice / 100))::BIGINT AS tokens, 8::BIGINT AS parts, true AS close FROM orders")
def u15_tree(t: Tables) -> DataFrame:
    """All orders as one batch in eight parts, whose sums differ by less than the largest length."""
    rows = t.orders.select(F.lit(0).alias("batch"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 100).alias("length"))
    parts = L.partition_tree(rows, "batch", "pos", "length", 8, chunk=1024, fan_in=4).groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("most"))
    return parts.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), (F.max("tokens") - F.min("tokens") < F.max("most")).alias("close"))
