"""What shows only on larger tables: ties, sums in another order, work and memory that outgrow the input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollsmith import plans
from rollsmith.operators import dispatch as D
from rollsmith.operators import filters as P
from rollsmith.operators import metrics as M
from rollsmith.operators import records as E


def test_first_known_takes_the_first_row_of_equal_keys(spark, tmp_path):
    rows = [(1, 2, 7, 0.04, "R"), (1, 2, 7, 0.03, "A"), (2, 1, 1500000, 0.05, "A"), (2, 2, 100000, 0.06, "N"), (3, None, 7, 0.05, "A")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_tax double, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in plans.QUERIES["a35_first_known"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0.04, "R"), (2, 0.06, "N"), (3, None, None)}


def test_weights_alike_but_for_their_last_digits_stay_together(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.1 + 0.2, 0.3, 0.3, 0.3, 0.1 + 0.2, 0.2, 0.5])], "i int, w double")
    assert {r["i"] for r in P.weight_percentile(df, "w", 0.7).collect()} == {0, 1, 2, 3, 4, 6}


def test_validation_metrics_sort_a_group_once_and_keep_null_ones(spark):
    rows = [("s", "p", 0.8), ("s", "p", 0.9), (None, "p", 0.8), (None, "p", 0.9)]
    found = M.validation_metrics(spark.createDataFrame(rows, "s string, p string, v double"), "s", "p", "v")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    got = {(r["s"], r["metric"]): r["score"] for r in found.collect()}
    assert abs(got["s", "best@2/mean"] - 0.875) < 1e-12 and got[None, "best@2/mean"] == got["s", "best@2/mean"]


def test_resampling_a_group_takes_few_calls_of_numpy_and_the_same_draws(monkeypatch):
    rng = np.random.default_rng(3)
    for size, n, votes in ((1, 4, 1), (5, 8, 3), (60, 60, 60), (9, 300, 2)):
        values, named = rng.random(size), rng.integers(0, votes, size)
        for block in (1 << 20, 700):
            monkeypatch.setattr(M, "BLOCK", block)
            got = M._resampled(values, np.unique(named, return_inverse=True)[1], n, 50, 7)
            np.random.seed(7)
            for row in got:
                at = np.random.choice(size, size=n, replace=True)
                _, first, counts = np.unique(named[at], return_index=True, return_counts=True)
                assert row.tolist() == [values[at].max(), values[at].min(), values[at[first[counts == counts.max()].min()]]]


def test_groups_are_resampled_by_all_tasks(spark):
    df = spark.range(400).selectExpr("id div 4 AS g", "id AS i", "rand(1) AS v", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE 'b' END AS w")
    found = M.majority_draws(df, ["g"], "v", "w", "i", draws=5)
    assert found.count() == 200 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert M.bootstrap(df, "g", "v", 4, draws=5, vote="w", order="i").count() == 100


def test_a_proposal_is_parsed_once(spark):
    df = spark.range(1).select(F.concat(F.lit("Proposal:\n- B: Ann"), F.col("id").cast("string")).alias("m"))
    found = df.repartition(1).select(E.proposal(F.col("m"), ["Ann0", "Bob"], ["B"]).alias("p")).select("p.status", "p.pairs")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4
    assert found.first()["status"] == "ok" and found.first()["pairs"][0]["row"] == 0


def test_a_large_worker_has_several_tasks(spark, monkeypatch):
    def work(worker, frames):
        from pyspark import TaskContext

        for rows in frames:
            yield rows.assign(task=TaskContext.get().partitionId())

    monkeypatch.setattr(D, "ROWS", 10)
    df = spark.range(95).withColumnRenamed("id", "n")
    for how, copies in (("one_to_all", 3), ("shares", 1)):
        got = D.dispatch(df, how, 3, ["n"], work, "n long, task long").collect()
        assert sorted((r["worker"], r["place"]) for r in got if r["place"] == r["n"])[:2] == [(0, 0), (0, 1)] and len(got) == 95 * copies
        assert len({r["task"] for r in got if r["worker"] == 0}) > 1


def test_distinct_runs_are_counted_without_a_row_for_each(spark):
    lists = [("a", ["x", "y", "x", "y"]), ("a", ["x y", "x"]), ("b", ["x", None, "y", None]), ("b", []), ("b", None), (None, ["x", "y x"]), (None, ["x", "y", "x"])]
    df = spark.createDataFrame(lists, "g string, w array<string>").repartition(3)
    for n in (1, 2, 3, 9):
        for by in ([], ["g"]):
            found = M.distinct_n(df, by, "w", n)
            assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
            runs = {}
            for g, w in lists:
                for i in range(len(w or []) - n + 1):
                    runs.setdefault(g if by else 0, []).append(None if None in w[i : i + n] else " ".join(w[i : i + n]))
            got = {(r["g"] if by else 0): (r["unique"], r["total"]) for r in found.collect() if r["total"]}
            assert got == {g: (len(set(r)), len(r)) for g, r in runs.items()}
    texts = spark.createDataFrame([("a", " x\ty\x0bx \n y"), ("a", ""), ("a", None), ("a", " "), ("a", "é\x1cx"), ("a", "y")], "g string, w string")
    for n, (unique, total) in ((1, (3, 6)), (2, (2, 3))):
        assert M.distinct_n(texts, ["g"], "w", n).select("unique", "total").first() == (unique, total)


def test_packs_keep_neighbours_of_one_key_together(monkeypatch):
    monkeypatch.setattr(M, "WORDS", 5)
    rows = [(k, ["w"] * (i % 4)) for k, many in enumerate((1, 7, 2, 1, 9, 3)) for i in range(many)]
    table = pa.table({"k": [k for k, _ in rows], "w": [w for _, w in rows]})
    for size in (1, 4, 50):
        packs = list(M._packs(iter(table.to_batches(max_chunksize=size)), "w", ["k"]))
        assert pa.concat_tables(packs).equals(table) and sum(len(set(p["k"].to_pylist())) for p in packs) == 6 and len(packs) > 2
        assert pa.concat_tables(M._packs(iter(table.to_batches(max_chunksize=size)), "w")).equals(table)


def test_self_bleu_of_packed_runs(spark):
    rows = [("a", 1, "x y x y z"), ("a", 2, "x y"), ("a", 1, "y z y"), ("a", 3, "x"), ("b", 1, "x y x y"), ("b", None, "x y x"), (None, 4, "p q p q"), (None, 5, "p q r"), ("c", 6, None), ("a", 7, " \n")]
    texts = spark.createDataFrame(rows, "g string, i int, w string").repartition(4)
    uses, scores = {}, {}
    for g, i, w in rows:
        w = (w or "").split()
        uses.setdefault((g, i), []).extend(zip(w, w[1:]))
    for (g, i), mine in uses.items():
        if mine:
            others = [u for (h, j), u in uses.items() if h == g and j != i]
            scores.setdefault(g, []).append(sum(min(mine.count(x), max((o.count(x) for o in others), default=0)) for x in set(mine)) / len(mine))
    for df in (texts, texts.withColumn("w", F.split(F.trim(F.translate("w", "\n", " ")), " ")).withColumn("w", F.expr("filter(w, x -> x <> '')"))):
        found = M.self_bleu(df, ["g"], "i", "w")
        assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {r["g"]: (round(r["self_bleu"], 12), r["texts"]) for r in found.collect()}
        assert got == {g: (round(float(np.mean(s)), 12), len(s)) for g, s in scores.items()}


def test_two_most_uses_of_large_numbers():
    number, group, uses = np.array([5, 5, 5, 1, 1, 5]), np.array([0, 0, 1, 0, 0, 0]), np.array([2, 9, 4, 3, 3, 7])
    for scale in (1, 1 << 59):
        top, second = M._two(number * scale, group, uses)
        assert sorted(zip(group[top], uses[top], second)) == [(0, 3, 3), (0, 9, 7), (1, 4, 0)]
