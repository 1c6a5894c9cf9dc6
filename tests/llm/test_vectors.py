"""Searches over repeated ids, components of any size, and any number of tasks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from rollsmith.llm import additive, html, maxscore, vectors

SCHEMA = "vec_id long, embedding array<double>"


def ranked(rows):
    got = defaultdict(list)
    for r in rows.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def pairs(rows, q, k, scale=None):
    whole = [(i, np.floor(scale * np.array(v)) if scale else np.array(v)) for i, v in rows]
    found = [(i, float(v @ w)) for n, w in whole if n == q for i, v in whole if i != q]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("shard", [16, 2048])
def test_every_row_of_a_repeated_id(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    rng = np.random.default_rng(4)
    rows = [(i % 60, [float(x) for x in rng.normal(size=4)]) for i in range(150)]
    rows += [(0, [9.0, 0.0, 0.0, 0.0]), (7, [8.0, 1.0, 0.0, 0.0]), (7, [-8.0, 1.0, 0.0, 0.0])] + [(20, [float(i), 1.0, 2.0, 0.0]) for i in range(40)] + [(7, [8.0, 1.0, 0.0, 0.0])] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact, near = ranked(maxscore.exact_search(df, vectors.every("id", 20))), ranked(additive.nearest(df, vectors.every("id", 20)))
    assert set(exact) == set(near) == {0, 20, 40}
    for q in exact:
        assert exact[q] == pairs(rows, q, 10, 1024)
        want = pairs(rows, q, 20)
        assert [i for i, _ in near[q]] == [i for i, _ in want] and [s for _, s in near[q]] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("large", [[1e200] + [0.0] * 7, [1e308] * 8, [-1e154] + [1e153] * 7, [1e40] * 8, [5e-324] * 8])
def test_components_of_any_size(spark, large):
    rng = np.random.default_rng(5)
    x = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, 8)))]
    rows = x + [(1001, large), (1020, large)]
    got = ranked(additive.nearest(spark.createDataFrame(rows, SCHEMA), vectors.every("id", 20)))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and all(np.isfinite(s) or max(large) > 1e150 for _, s in found)
        with np.errstate(over="ignore"):
            own, big = np.array(dict(rows)[q]), max(map(abs, large))
            size = lambda v: float(v @ (own / max(np.abs(own).max(), 1e-300)))
            want = sorted(((i, size(np.array(v) / max(big, 1.0))) for i, v in rows if i != q), key=lambda e: (-e[1], e[0]))[:20]
        hits += len({i for i, _ in found} & {i for i, _ in want})
    assert hits >= 0.9 * 20 * len(got) if max(large) < 1e100 else hits >= 0.5 * 20 * len(got)
    for i, s in got[0]:
        assert s == pytest.approx(float(np.array(dict(rows)[i]) @ np.array(dict(rows)[0]))) or not np.isfinite(s)


def test_recall_does_not_depend_on_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 128)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(1500, 24)))], SCHEMA)
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(ranked(additive.nearest(df, vectors.every("id", 50), rerank=64)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_deep_and_wide_pages():
    import tracemalloc

    tracemalloc.start()
    assert html.render("<blockquote>" * 100_000 + "x").strip() == "x" and html.render("<ul><li>" * 100_000 + "x").strip() == "- x"
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    lines = html.render("<table>" + ("<tr>" + "<td>ab" * 1000) * 300 + "</table>").split("\n")
    assert len(lines) == 300 and set(lines) == {"  ".join(["ab"] * 1000)}


@pytest.mark.parametrize("page, text", [
    ('<p style="visibility:hidden">a<span style="visibility:visible">B</span>c</p>d', "B\n\nd"), ('<div style="display:none">a<b style="display:block;visibility:visible">b</b></div>c', "c"),
    ('<ul><li style="visibility: collapse">a<li>b</ul>', "- b"), ('<div style="backface-visibility:hidden">a</div>', "a"), ('<div style="visibility:hidden;visibility:visible">a</div>', "a"), ('<div style="visibility:hidden"><br><hr>a</div>b', "b"),
    ("<pre>\n\na</pre>", "\na"), ("<pre>\na\n b</pre>", "a\n b"), ("<pre><b>x</b>\ny</pre>", "x\ny"),
])
def test_visibility_and_first_breaks(page, text):
    assert html.render(page).strip("\n") == text.strip("\n")
