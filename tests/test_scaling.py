"""Exact majorities, affine scans and tree partitions against plain forms of them."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollsmith.functions import tokens as T
from rollsmith.operators import balance as L
from rollsmith.operators import metrics as M
from rollsmith.operators.votes import majority_expected, majority_moments


def enumerated(votes, values, n):
    won = []
    for draw in itertools.product(range(len(votes)), repeat=n):
        found = {}
        for i in draw:
            found.setdefault(votes[i], []).append(values[i])
        won.append(max(found.values(), key=len)[0])
    return np.mean(won), np.std(won)


def moments(votes, values, n):
    labels = sorted(set(votes), key=votes.count)
    of = lambda f: np.array([np.mean([f(v) for v, w in zip(values, votes) if w == label]) for label in labels])
    return majority_moments([votes.count(label) for label in labels], of(lambda v: v), of(lambda v: v * v), n)


@pytest.mark.parametrize("votes", ["a", "ab", "aab", "abc", "aabb", "aaab", "abcd"])
def test_majority_equals_enumeration(votes):
    random.seed(len(votes))
    values = [random.random() for _ in votes]
    for n in range(1, 7):
        assert np.allclose(moments(votes, values, n), enumerated(votes, values, n), atol=1e-7)


def test_majority_of_many_draws():
    mean, std = moments("a" * 40 + "b" * 24, [1.0] * 40 + [0.0] * 24, 64)
    assert 0.9 < mean < 1 and abs(std - (mean * (1 - mean)) ** 0.5) < 1e-9
    assert np.allclose(moments([str(i) for i in range(30)], list(range(30)), 30), (14.5, np.std(range(30))))


def test_majority_column_and_its_drawn_form(spark):
    random.seed(4)
    rows = [(p, i, random.choice("abc"), random.random()) for p in range(3) for i in range(9 + p)] + [(9, 0, "a", 0.5), (9, 1, None, 1.0), (9, 2, "b", None)]
    df = spark.createDataFrame(rows, "p int, i int, vote string, v double")
    exact = {(r["p"], r["k"]): r for r in majority_expected(df, ["p"], "v", "vote").collect()}
    assert sorted(k for p, k in exact if p == 0) == [2, 4, 8, 9] and sorted(k for p, k in exact if p == 9) == [2]
    drawn = M.majority_draws(df.where("p < 9"), ["p"], "v", "vote", "i", draws=3000).collect()
    for r in drawn:
        e = exact[r["p"], r["k"]]
        assert abs(r["maj_mean"] - e["maj_mean"]) <= 3 * e["maj_std"] / 3000**0.5 + 1e-9 and abs(r["maj_std"] - e["maj_std"]) < 0.03
    whole = {(r["metric"]): r["score"] for r in M.validation_metrics(df.where("p = 0").withColumn("s", F.lit("s")), "s", "p", "v", vote="vote").collect()}
    assert abs(whole["maj@4/mean"] - exact[0, 4]["maj_mean"]) < 1e-12


def plain_gae(r, v, m, gamma, lam):
    out, nxt, last = [], 0.0, 0.0
    for x, y, k in zip(r[::-1], v[::-1], m[::-1]):
        now = x + gamma * nxt - y + gamma * lam * last
        nxt, last = (y, now) if k else (nxt, last)
        out.append(last)
    return out[::-1]


def test_scans_against_loops(spark):
    random.seed(3)
    rows = [(i, *(list(map(f, range(n))) for f in (lambda _: random.gauss(0, 1), lambda _: random.gauss(0, 1), lambda _: int(random.random() < 0.7)))) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 100, 1000])]
    df = spark.createDataFrame(rows, "seq int, r array<double>, v array<double>, m array<int>")
    got = df.select("seq", T.gae("r", "v", "m", 0.99, 0.95).alias("g"), T.reverse_scan("r", "m", 0.9, True).alias("a"), T.reverse_scan("r", "m", 0.9, False).alias("b")).collect()
    for i, (row, (_, r, v, m)) in enumerate(zip(sorted(got), rows)):
        reset, plain, a, b = [], [], 0.0, 0.0
        for x, k in zip(r[::-1], m[::-1]):
            a, b = x + 0.9 * a, x + 0.9 * b
            reset.append(a)
            plain.append(b)
            a *= k
        assert np.allclose(row["g"], plain_gae(r, v, m, 0.99, 0.95)) and np.allclose(row["a"], reset[::-1]) and np.allclose(row["b"], plain[::-1]), i


def test_one_long_sequence(spark):
    n = 1_000_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i)).alias("r"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.cos(i)).alias("v"), F.array_repeat(F.lit(1), n).alias("m"))
    got = df.select(T.gae("r", "v", "m", 0.99, 0.95).alias("g")).select(F.element_at("g", 1), F.element_at("g", n // 2), F.element_at("g", n)).first()
    want = plain_gae(np.sin(np.arange(1, n + 1)).tolist(), np.cos(np.arange(1, n + 1)).tolist(), [1] * n, 0.99, 0.95)
    assert np.allclose(tuple(got), (want[0], want[n // 2 - 1], want[-1]))


def test_sequences_over_several_rows(spark):
    random.seed(8)
    f, a = ([random.random() for _ in range(57)] for _ in range(2))
    want, x = [], 0.0
    for p, q in zip(f[::-1], a[::-1]):
        x = q + p * x
        want.append(x)
    cells = [{"f": p, "a": q} for p, q in zip(f, a)]
    rows = [("s", 0, cells[:20]), ("s", 1, []), ("s", 2, cells[20:21]), ("s", 3, cells[21:]), ("t", 5, cells[:2]), (None, 0, cells[:1])]
    got = {(r["seq"], r["segment"]): r["x"] for r in T.affine_scan_segments(spark.createDataFrame(rows, "seq string, segment int, c array<struct<f:double,a:double>>"), "c").collect()}
    assert np.allclose(sum((got["s", i] for i in range(4)), []), want[::-1]) and np.allclose(got["t", 5], [a[0] + f[0] * a[1], a[1]])


def spread(rows):
    sums = {}
    for part, n in rows:
        sums[part] = sums.get(part, 0) + n
    return max(sums.values()) - min(sums.values())


def test_a_batch_of_one_chunk_is_partitioned_as_before(spark):
    random.seed(6)
    rows = [(b, i, random.randint(1, 5000)) for b in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "b int, i int, n int")
    for equal in (False, True):
        one, other = (sorted(map(tuple, f(df, "b", "i", "n", 4, equal_size=equal).collect())) for f in (L.partition, L.partition_tree))
        sums = lambda x: sorted((b, sorted(sum(n for c, _, n, p in x if (c, p) == (b, q)) for q in range(4))) for b in range(3))
        parts = lambda x: {frozenset((c, i) for c, i, _, p in x if (c, p) == (b, q)) for b in range(3) for q in range(4)}
        assert parts(one) == parts(other) and sums(one) == sums(other)


@pytest.mark.parametrize("equal", [False, True])
def test_batches_of_many_chunks(spark, equal):
    random.seed(7)
    lengths = [random.choice([1, 10, 1000]) + random.randint(0, 4000) for _ in range(3000)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)] + [(1, i, 5) for i in range(6)] + [(None, 1, 1), (1, None, 1)], "b int, i int, n int")
    got = L.partition_tree(df, "b", "i", "n", 6, equal_size=equal, chunk=100, fan_in=3).collect()
    mine = [r for r in got if r["b"] == 0]
    assert sorted(r["i"] for r in mine) == list(range(3000)) and {r["part"] for r in mine} == set(range(6)) and sorted(r["part"] for r in got if r["b"] == 1) == list(range(6))
    turns = L.serpentine(df.where("b = 0"), "b", "i", "n", 6).collect()
    assert spread((r["part"], r["n"]) for r in mine) <= spread((r["part"], r["n"]) for r in turns)
    if equal:
        assert {sum(r["part"] == q for r in mine) for q in range(6)} == {500}


def test_parts_of_equal_size_need_a_divisible_batch(spark):
    with pytest.raises(Exception, match="not divisible"):
        L.partition_tree(spark.createDataFrame([(0, i, 1) for i in range(7)], "b int, i int, n int"), "b", "i", "n", 2, equal_size=True).collect()
