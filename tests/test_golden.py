"""Golden values, edge rows and properties of the library's operators."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollsmith import schemas
from rollsmith.functions import registry as G
from rollsmith.functions import scorers as R
from rollsmith.functions import text as X
from rollsmith.functions import tokens as T
from rollsmith.operators import advantage as A
from rollsmith.operators import balance as L
from rollsmith.operators import batch as B
from rollsmith.operators import filters as P
from rollsmith.operators import joins as J
from rollsmith.operators import losses as O
from rollsmith.operators import metrics as M
from rollsmith.operators import records as E
from rollsmith.operators import splits as S
from rollsmith.operators import windows as W
from rollsmith.sources import games
from rollsmith.sources import readers, sinks
from rollsmith.sources.scratch import scratch


def one(spark, expression, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first()["x"]


def test_grpo_groups_of_one_and_equal_scores(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("b", 2, 1.0), ("b", 3, 1.0), ("c", 4, 0.0), ("c", 5, 2.0)], "uid string, id int, s double")
    got = {r["id"]: r["advantage"] for r in A.grpo(df, "s", "uid").collect()}
    assert got[1] == pytest.approx(3.0, abs=1e-4) and got[2] == got[3] == 0.0
    assert got[5] == pytest.approx(1 / (math.sqrt(2) + 1e-6)) and got[4] == -got[5]
    assert {r["id"]: r["advantage"] for r in A.rloo(df, "s", "uid").collect()}[1] == 3.0
    assert {r["id"]: r["advantage"] for r in A.centred(df, "s", "uid").collect()}[1] == 0.0


def test_passk_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1, 3.0)], "uid string, id int, s double")
    with pytest.raises(Exception, match="fewer than two"):
        A.grpo_passk(df, "s", "uid", "id").collect()


def test_estimators_do_not_depend_on_row_order(spark):
    rows = [(i % 5, i, float(i * 7 % 11)) for i in range(40)]
    shape = "uid int, id int, s double"
    for name in ("grpo", "rloo", "centred"):
        a = {r["id"]: r["advantage"] for r in A.estimate(name, spark.createDataFrame(rows, shape), "s", "uid").collect()}
        b = {r["id"]: r["advantage"] for r in A.estimate(name, spark.createDataFrame(random.Random(1).sample(rows, 40), shape), "s", "uid").collect()}
        assert a == pytest.approx(b)
    with pytest.raises(ValueError, match="unknown estimator"):
        A.estimate("none", None)
    with pytest.raises(ValueError, match="registered already"):
        A.register("grpo")(lambda df: df)


def test_gae_ignores_values_at_masked_tokens(spark):
    reward, mask = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0], [0, 1, 1, 1, 0, 0, 1, 1, 1, 0, 0]
    rng = random.Random(0)
    a = [rng.random() for _ in mask]
    b = [x if m else rng.random() for x, m in zip(a, mask)]
    df = spark.createDataFrame([(1, reward, a, mask), (2, reward, b, mask)], "seq int, r array<double>, v array<double>, m array<int>")
    got = {r["seq"]: r["g"] for r in df.select("seq", T.gae("r", "v", "m", 0.9, 0.8).alias("g")).collect()}
    kept = [i for i, m in enumerate(mask) if m]
    assert [got[1][i] for i in kept] == pytest.approx([got[2][i] for i in kept])


def test_masked_moments_and_eos(spark):
    x, m = F.array(*map(F.lit, [1.0, 2.0, float("nan"), 4.0])), F.array(*map(F.lit, [1, 1, 0, 1]))
    assert one(spark, T.masked_sum("x", "m"), x=x, m=m) == 7.0
    assert one(spark, T.masked_var("x", "m"), x=x, m=F.array(*map(F.lit, [1, 0, 0, 0]))) is None
    ids = lambda v: F.array(*map(F.lit, v))
    assert one(spark, T.first_eos_mask("i", [1]), i=ids([20, 10, 34, 1, 0, 0, 0])) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, T.first_eos_mask("i", [1]), i=ids([78, 0, 76, 2, 1, 0, 0])) == [1, 1, 1, 1, 1, 0, 0]
    assert one(spark, T.first_eos_mask("i", [1, 2]), i=ids([78, 0, 76, 2, 1, 0, 0])) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, T.pad_left("i", 5, 0), i=ids([7, 8])) == [0, 0, 0, 7, 8]
    assert one(spark, T.truncate("i", 4, "middle"), i=ids([1, 2, 3, 4, 5, 6])) == [1, 2, 5, 6]
    with pytest.raises(Exception, match="longer than"):
        one(spark, T.truncate("i", 1, "error"), i=ids([7, 8]))


def test_reduce_by_name_and_majority(spark):
    rows = [("loss", v) for v in (1.0, 2.0, 3.0)] + [("max_reward", v) for v in (5.0, 8.0, 6.0)] + [("min_error", v) for v in (0.1, 0.05, 0.2)]
    got = {r["metric"]: r["value"] for r in M.reduce_by_name(spark.createDataFrame(rows, "metric string, v double"), "metric", "v").collect()}
    assert got == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}
    votes = spark.createDataFrame([(1, "A", 0.9), (2, "B", 0.8), (3, "A", 0.7)], "pos int, pred string, val double").withColumn("g", F.lit(1))
    assert M.majority_value(votes, ["g"], "pred", "val", "pos").first()["value"] == 0.9
    tie = spark.createDataFrame([(1, "B", 0.5), (2, "A", 0.9)], "pos int, pred string, val double").withColumn("g", F.lit(1))
    assert M.majority_value(tie, ["g"], "pred", "val", "pos").first()["value"] == 0.5


def test_validation_metrics_and_bootstrap_agree(spark):
    df = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)], "src string, prompt string, v double")
    got = {(r["src"], r["metric"]): r["score"] for r in M.validation_metrics(df, "src", "prompt", "v").collect()}
    assert got[("s1", "mean@2")] == pytest.approx(0.85) and ("s2", "std@1") not in got
    assert got[("s1", "best@2/mean")] == pytest.approx(0.875) and got[("s1", "worst@2/mean")] == pytest.approx(0.825)
    many = spark.createDataFrame([(1, i, float(i * i % 7), "x") for i in range(9)], "g int, i int, v double, w string")
    drawn = M.bootstrap(many, "g", "v", 4, draws=3000, vote="w", order="i").first()
    exact = M.best_worst(many.withColumn("k", F.lit(4)), ["g"], "v", "k").first()
    assert drawn["best_mean"] == pytest.approx(exact["best_mean"], abs=0.1) and drawn["worst_std"] == pytest.approx(exact["worst_std"], abs=0.1)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in M.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])


def test_self_bleu_by_brute_force(spark):
    texts = ["a b c a b", "a b d", "c a b a b a b", "z"]
    df = spark.createDataFrame([(1, i, t.split()) for i, t in enumerate(texts)], "g int, id int, w array<string>")
    grams = [[tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)] for t in texts]
    scores = []
    for i, g in enumerate(grams):
        if g:
            scores.append(sum(min(g.count(x), max((h.count(x) for j, h in enumerate(grams) if j != i), default=0)) for x in set(g)) / len(g))
    assert M.self_bleu(df, ["g"], "id", "w").first()["self_bleu"] == pytest.approx(np.mean(scores))


@pytest.mark.parametrize("equal", [False, True])
def test_balanced_parts_cover_all_once(equal):
    rng = random.Random(3)
    lengths = [rng.randint(1, 900) for _ in range(96)]
    for solve in (L.differencing, L.greedy):
        parts = solve(lengths, 8, equal)
        assert sorted(i for p in parts for i in p) == list(range(96))
        if equal:
            assert {len(p) for p in parts} == {12}
    sums = [sum(lengths[i] for i in p) for p in L.differencing(lengths, 8, equal)]
    assert max(sums) - min(sums) < 60
    with pytest.raises(ValueError):
        L.differencing([1, 2, 3], 2, True)


def test_batch_round_trips(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("v"))
    rows = lambda d: sorted((r["pos"], r["v"]) for r in d.collect())
    assert rows(B.unpad(B.pad_to_divisor(df, 4))) == rows(df) and B.pad_to_divisor(df, 4).count() == 12
    assert B.pad_to_divisor(df.where("pos < 3"), 8).count() == 8
    assert rows(B.unfold(B.fold(df, ["v"], 5), ["v"], 5)) == rows(df)
    assert B.repeat_each(df, F.col("pos") % 3).count() == sum(i % 3 for i in range(10))
    with pytest.raises(Exception, match="batches differ"):
        B.zip_union(df, df.withColumn("v", F.col("v") + F.when(F.col("pos") == 3, 1).otherwise(0))).collect()
    with pytest.raises(Exception, match="batches differ"):
        B.zip_union(df, df.where("pos < 9").withColumnRenamed("v", "w")).collect()
    with pytest.raises(ValueError):
        B.rename(df, {"x": "y"})


def test_splits_are_exact_and_seeded(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a = S.split_exact(df, 0.9, ["k"], 42)
    assert a.where("split = 'train'").count() == 902
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, S.split_exact(df.repartition(7), 0.9, ["k"], 42).collect()))
    assert S.resample(df.withColumn("s", F.col("k") % 5), "s", "k").count() == 1003
    with pytest.raises(ValueError):
        S.split_three(df, (0.5, 0.1, 0.1), ["k"])


def test_bins_and_prefixes(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 4, 5, 6, 7)], "v double")
    assert sorted(r["bin"] for r in W.quantile_bins(df, "v", 4).collect()) == [0, 0, 0, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError, match="not unique"):
        W.quantile_bins(spark.createDataFrame([(1.0,)] * 5, "v double"), "v", 4).collect()
    toks = spark.createDataFrame([(1, s, t, x) for s, ids in ((1, [5, 6, 7]), (2, [5, 6, 8]), (3, [5, 6])) for t, x in enumerate(ids)], "g int, s int, t int, x int")
    assert W.common_prefix(toks, "g", "s", "t", "x").first()["prefix"] == 2


def test_filters_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", None)], "k string, r double")
    assert [r["k"] for r in df.where(P.at_threshold(F.col("r"), 1.0)).collect()] == ["a"]
    with pytest.raises(ValueError):
        P.require_positive(spark.createDataFrame([(0.0,), (-1.0,)], "w double"), "w")
    with pytest.raises(ValueError):
        P.fill_groups(df, "k", 9)
    assert P.varied_groups(spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("z", 1), ("z", 2)], "u string, s int"), "s", "u").count() == 3


def test_text_functions(spark):
    assert one(spark, X.words("t"), t="  a  b\n") == ["a", "b"] and one(spark, X.words("t"), t="  ") == []
    assert one(spark, X.action_tag("t"), t="[Message] hi [PROPOSE] x") == "propose" and one(spark, X.action_tag("t"), t="none") is None
    assert one(spark, X.public_text("t"), t="plan [message] a <think>b</think> c <think>open") == "a  c <think>open"
    assert one(spark, X.questions("t"), t="One. Two? three\nfour! Five? ") == ["Two?", "Five?"]
    assert one(spark, X.last_boxed("t"), t="\\boxed{1} \\boxed{a{b}c} d") == "a{b}c"
    assert one(spark, X.last_boxed("t"), t="\\boxed{a{b") is None and one(spark, X.last_boxed("t"), t="no") is None
    assert one(spark, X.normalized_answer("t"), t="The  Cat, a dog!") == "cat dog"
    assert one(spark, X.latex_form("t"), t="0.5") == "\\frac{1}{2}" and one(spark, X.latex_form("t"), t="\\sqrt3") == "\\sqrt{3}"
    assert one(spark, X.mentions("t", ["aa"]), t="aaaa Aa") == 3


def test_scorers(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, R.hash_answer(F.col("s"), F.col("g")), s="so #### 1,234", g="1234") == 1.0
    assert one(spark, R.hash_answer(F.col("s"), F.col("g"), "flexible"), s="it is 12.", g="12.") == 1.0
    assert one(spark, R.exact_match(F.col("s"), F.col("g")), s="<answer>x</answer>" * 11, g=lit("x")) == 0.25
    assert one(spark, R.exact_match(F.col("s"), F.col("g")), s="none", g=lit("x")) == 0.0
    assert one(spark, R.graded_math(F.col("s"), F.col("g")), s="(1, 2)", g="(1,2)") == 1.0
    assert one(spark, R.graded_math(F.col("s"), F.col("g")), s="2/4", g="1/2") == 0.0
    with pytest.raises(Exception, match="no scorer"):
        one(spark, R.routed(F.col("d"), F.col("s"), F.col("s")), d="other", s="x")
    v = np.random.default_rng(0).integers(0, 100, (5, 5))
    from itertools import permutations

    assert R.best_assignment(v) == max(sum(v[i][p[i]] for i in range(5)) for p in permutations(range(5)))


def test_proposals(spark):
    rows, cols = ["Ann Roe", "Bob Lee"], ["BLEU: a method", "GloVe"]
    parse = lambda m: one(spark, E.proposal(F.col("m"), rows, cols), m=m)
    ok = parse("Hi!\nProposal:<br/>&emsp; - BLEU: a method: Bob<br/>&nbsp;- GloVe: ann\n\nbye")
    assert ok["status"] == "ok" and [(p["row"], p["column"]) for p in ok["pairs"]] == [(1, 0), (0, 1)]
    assert parse("no header")["status"] == "no header"
    assert parse("Proposal:\n- GloVe: Ann")["status"] == "wrong number of lines"
    assert parse("Proposal:\n- GloVe: Ann\n- BLEU: Ann")["status"] == "row repeated"


def test_chat_checks_and_views(spark):
    m = lambda *x: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in x])
    assert one(spark, E.chat_errors("m"), m=m(("system", "s"), ("user", "a"), ("assistant", "b"))) == []
    assert one(spark, E.chat_errors("m"), m=m(("user", " "), ("user", "b"))) == ["roles do not alternate", "empty content"]
    assert [p["type"] for p in one(spark, E.typed_content("t"), t="<image>a<video>")] == ["image", "text", "video"]
    assert one(spark, E.game_details("t"), t="{bad")["num_messages"] == 0


def test_peers_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 2), rng.random()) for g in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, i int, acc int, s double")
    got = {(r["g"], r["i"]): r["peer_mean"] for r in J.opposite_peers(df, "g", "acc", "s").collect()}
    for g, i, acc, _ in rows:
        peers = [s for h, _, a, s in rows if h == g and (a < acc if acc > 0 else a > acc)]
        assert got[(g, i)] == pytest.approx(np.mean(peers) if peers else 0.0)


def test_losses(spark):
    assert one(spark, O.log_sigmoid(F.col("x")), x=-800.0) == pytest.approx(-800.0) and one(spark, O.log_sigmoid(F.col("x")), x=0.0) == pytest.approx(-math.log(2))
    bad = spark.createDataFrame([(1.0, [0.1], [0.1, 0.2])], "w double, a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        O.offline_kl(bad, "w", "a", "b", 0.1).collect()


def test_games_follow_their_seed(spark):
    a, b = (games.games(spark, 6, seed=11, group_size=2).orderBy("game_id").collect() for _ in range(2))
    assert a == b and a[0]["table"] == a[1]["table"] != a[2]["table"]
    assert games.game(1 << 40)["best"] > 0


def test_readers_and_sinks(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([('{"a": 1}',), ("{broken",), ("",)], "value string").write.text(path)
    assert readers.json_lines(spark, path, "a int", strict=False).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, path, "a int").collect()
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, path + "-none")
    with pytest.raises(ValueError, match="missing"):
        schemas.require(spark.range(1), ["x"])
    few = scratch(spark, "few")
    sinks.by_threshold(spark.range(5).select("id", F.lit(1.0).alias("r")), few, "r", [0.5], ["id"])
    assert {r["split"] for r in spark.read.parquet(f"{few}/threshold=0.5").collect()} == {"all"}


def test_registries(spark):
    r = G.Registry("scorer")
    f = r.register("x", lambda a: a)
    assert r.register("x", f) is f
    with pytest.raises(ValueError, match="registered already"):
        r.register("x", lambda a: a)
    with pytest.raises(ValueError, match="known: x"):
        r.get("y")


def test_ranks_and_quantiles_of_whole_tables(spark):
    from rollsmith.operators.ranking import hash_ranked, indexed, quantiles

    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.random(), 0.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["k"]: r["index"] for r in indexed(df, ["v", "k"]).collect()} == {k: i for i, (k, _) in enumerate(order)}
    ranked, n = hash_ranked(df, F.xxhash64("k"), ["k"])
    assert n == 500 and sorted(r["_rank"] for r in ranked.collect()) == list(range(500))
    known = [v for _, v in rows if v is not None]
    assert quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0]) == pytest.approx(np.quantile(known, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist())
    assert quantiles(df.where("k < 0"), "v", [0.5]) == [None] and indexed(df.where("k < 0"), ["k"]).count() == 0


def test_majority_metrics(spark):
    rows = [(1, "p", i, 0.8 + i / 10, v) for i, v in enumerate("ABA")] + [(1, "q", 0, 0.5, "A")]
    df = spark.createDataFrame(rows, "source int, prompt string, pos int, v double, pred string")
    got = {r["metric"]: r["score"] for r in M.validation_metrics(df, "source", "prompt", "v", vote="pred", order="pos", draws=2000).collect()}
    assert {"maj@2/mean", "maj@2/std", "maj@3/mean", "best@2/mean"} <= set(got) and "maj@1/mean" not in got
    # All 27 equally likely draws of three, a tied vote to the one drawn first.
    exact = []
    for at in itertools.product(range(3), repeat=3):
        votes = ["ABA"[i] for i in at]
        top = max(votes.count(v) for v in votes)
        exact.append(0.8 + next(i for i, v in zip(at, votes) if votes.count(v) == top) / 10)
    assert got["maj@3/mean"] == pytest.approx(np.mean(exact), abs=0.01) and got["maj@3/std"] == pytest.approx(np.std(exact), abs=0.01)


def test_bootstrap_follows_its_seed(spark):
    values = [3.0, 1.0, 2.0, 5.0]
    df = spark.createDataFrame([(7, i, v) for i, v in enumerate(values)], "g int, pos int, v double")
    r = M.bootstrap(df, "g", "v", 2, draws=50, seed=42, order="pos").first()
    np.random.seed(42)
    drawn = [np.array(values)[np.random.choice(4, size=2, replace=True)] for _ in range(50)]
    assert r["best_mean"] == pytest.approx(np.mean([d.max() for d in drawn])) and r["worst_std"] == pytest.approx(np.std([d.min() for d in drawn])) and r["maj_mean"] is None


def test_resample_draws_independently(spark):
    n = 3000
    df = spark.createDataFrame([(i, 40.0 if i == 0 else 0.0 if i % 2 else 1.0) for i in range(n)], "k int, v double")
    copies = np.zeros((6, n), int)
    for seed in range(6):
        for r in S.resample(df.repartition(seed + 1), "v", "k", seed=seed).groupBy("k").agg(F.count("*").alias("c"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect():
            copies[seed, r["k"]] = r["c"]
            assert r["c"] == r["d"] == r["m"]
    assert (copies.sum(axis=1) == n).all() and not copies[:, 1::2].any()
    weight = 1600 / (1600 + n / 2 - 1)
    assert abs(copies[:, 0].mean() - n * weight) < 5 * np.sqrt(n * weight * (1 - weight) / 6)
    rest = copies[:, 2::2]  # each of these expects about one copy: as often none as in independent draws
    mean = n * (1 - weight) / (n / 2 - 1)
    assert rest.mean() == pytest.approx(mean, abs=0.05) and rest.var() == pytest.approx(mean, rel=0.15)
    assert sorted(r["k"] for r in S.resample(df, "v", "k", seed=3).collect()) == sorted(r["k"] for r in S.resample(df.repartition(9), "v", "k", seed=3).collect())
    assert S.resample(df.where("k < 0"), "v", "k").count() == 0


def plain_differencing(lengths, k):
    """The same rule on lists: the two states of widest spread are joined, largest set to smallest."""
    states = [[(n, ((i, n),)), *[(0, ())] * (k - 1)] for i, n in sorted(enumerate(lengths), key=lambda x: (x[1], x[0]))]
    rank = lambda s: (s[0], len(s[1]), s[1])
    serial = list(range(len(states)))
    while len(states) > 1:
        best = sorted(range(len(states)), key=lambda i: (states[i][0][0] - states[i][-1][0], rank(states[i][0])), reverse=True)[:2]
        a, b = (states[i] for i in best)
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=rank, reverse=True)
        states = [s for i, s in enumerate(states) if i not in best] + [joined]
        serial = [s for i, s in enumerate(serial) if i not in best] + [max(serial) + 1]
    return [s[0] for s in states[0]]


def test_balanced_parts_follow_the_rule(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for b in range(3):
        lengths = [rng.choice([5, 5, 9, rng.randint(1, 500)]) for _ in range(60)]
        rows += [(b, i, n) for i, n in enumerate(lengths)]
        wanted[b] = sorted(plain_differencing(lengths, 5))
    df = spark.createDataFrame(rows, "batch int, pos int, length int")
    for b, sums in wanted.items():
        got = L.partition(df, "batch", "pos", "length", 5).where(F.col("batch") == b).groupBy("part").agg(F.sum("length").alias("s")).collect()
        assert sorted(r["s"] for r in got) == sums
    greedy = {r["pos"]: r["part"] for r in L.partition(df, "batch", "pos", "length", 5, method="greedy").where("batch = 0").collect()}
    sums = [0] * 5
    for _, i, n in rows[:60]:
        assert sums[greedy[i]] == min(sums)
        sums[greedy[i]] += n


def test_best_assignments_by_brute_force():
    from rollsmith.functions.scorers import best_assignment
    from rollsmith.sources.games import game

    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 6):
        v = rng.normal(size=(n, n)) * 50
        assert best_assignment(v) == pytest.approx(max(sum(v[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))))
    g = game(11)
    known = np.where((np.array(g["mask1"]) | np.array(g["mask2"])) > 0, np.array(g["table"]), 50.0)
    assert g["best"] == pytest.approx(max(sum(known[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(5))))
    assert best_assignment(rng.normal(size=(14, 14))) > 0


def test_seeded_choices(spark):
    from rollsmith.operators import losses
    from rollsmith.operators import windows as W

    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "k int, v double")
    pick = lambda seed: {r["k"] for r in W.sample_band(df.repartition(seed), "v", 20.0, 80.0, 15, ["k"], seed).collect()}
    assert len(pick(1)) == 15 and pick(1) == pick(1) != pick(2) and all(20 <= k <= 80 for k in pick(1) | pick(2))
    places = {seed: [r["k"] for r in df.orderBy(W.hashed_order(["k"], seed), "k").collect()] for seed in (1, 2)}
    assert places[1] != places[2] and sorted(places[1]) == list(range(200)) and places[1] != list(range(200))
    rng = np.random.default_rng(1)
    adv, lp = rng.normal(size=400) * 2, rng.normal(size=400)
    old = lp + rng.normal(size=400) * 0.05
    tokens = spark.createDataFrame([(i, float(a), float(x), float(o), 1) for i, (a, x, o) in enumerate(zip(adv, lp, old))], "t int, advantage double, lp double, old_lp double, mask int")
    got = sorted(losses.clip_cov(tokens, ["t"], ratio=0.02).collect(), key=lambda r: r["t"])
    cov = (adv - adv.mean()) * (lp - lp.mean())
    out = [r["t"] for r in got if r["corr"] == 0]
    ratio = np.exp(lp - old)
    plain = np.maximum(-adv * ratio, -adv * np.clip(ratio, 0.8, 1.2))
    assert len(out) == 8 and all(1 < cov[i] < 5 for i in out)
    assert [r["loss"] for r in got] == pytest.approx([0.0 if i in out else plain[i] for i in range(400)])


@pytest.mark.parametrize("direct", [1 << 18, 0])
def test_group_quantiles_and_running_totals(spark, monkeypatch, direct):
    from rollsmith.operators import ranking
    from rollsmith.operators.ranking import group_quantiles, running_total

    monkeypatch.setattr(ranking, "DISTINCT", direct)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, float("nan"), 0.5, rng.random()]), i) for i in range(600)] + [("none", None, 600)]
    df = spark.createDataFrame([(g, None if v is None or v != v else v, i) for g, v, i in rows], "g string, v double, i int").repartition(9)
    got = {r["g"]: r["q"] for r in group_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 1.0], "q").collect()}
    for g in {"a", "b", None, "hot"}:
        values = [v for h, v, _ in rows if h == g and v is not None and v == v]
        assert got[g] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 1.0]).tolist())
    assert "none" not in got and group_quantiles(df, [], "v", [0.5], "q").count() == 1
    total = {r["i"]: r["s"] for r in running_total(df.select("i"), [F.col("i").desc()], "i", "s").collect()}
    assert all(total[i] == sum(range(i, 601)) for i in (0, 5, 300, 600))
    summary = {r["g"]: r["p50"] for r in M.reward_summary(df, "v", ["g"]).collect()}
    assert summary["none"] is None and summary[None] == pytest.approx(got[None][2])
