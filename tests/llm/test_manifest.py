"""The Merkle manifest against a tree grown in plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollsmith.llm.common import id_remainder
from rollsmith.llm.manifest import audit, fold, proofs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, at int, hash string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    return h(*(told(row[f]) for f in FIELDS[:-1]), told(text))


def tree(nodes, fanout):
    """The root, and for each node the steps of its proof as (before, after)."""
    steps, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j in range(len(run)):
                for i in groups[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            joined.append([i for j in range(len(run)) for i in groups[a + j]])
        nodes, groups = up, joined
    return nodes[0], steps


def expected(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, text), r["doc_id"]))
    out = []
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    root, above = tree([trees[s][0] for s in names], fanout) if names else ("", [])
    for place, s in enumerate(names):
        for x, own in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            steps, node = own + above[place], x[3]
            for left, right in steps:
                node = h(left, node, right)
            out.append((x[4], x[2], trees[s][0], root, h(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def found(docs, fanout=3):
    tampered = F.when(id_remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = audit(docs, FIELDS, {"text": tampered}, fanout=fanout)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=repr)


def sample():
    rows = [dict(doc_id=i, text=f"line {i}\nand é {i % 7}", lang="en", source=["web", "wiki", None, "", "=x", "é"][i * i % 6], n_chars=i, part="p", at=1, hash="h") for i in range(60)]
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[4], text="other\n"), dict(rows[5], doc_id=None), dict(rows[5], doc_id=None, text=None, lang=None, n_chars=None), dict(rows[7], text=""), dict(rows[8], doc_id=1000, text="long\n" * 40000)]
    return rows + [dict(rows[9], doc_id=-5, source="lone")]


def test_against_a_plain_tree(spark):
    rows = sample()
    docs = spark.createDataFrame([[r[c.split()[0]] for c in SCHEMA.split(", ")] for r in rows], SCHEMA).repartition(5)
    got = found(docs)
    assert got == expected(rows, 3)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n, fanout", [(0, 3), (1, 3), (4, 2)])
def test_small_tables(spark, n, fanout):
    rows = [dict(doc_id=i, text="a\nb", lang=None, source="s", n_chars=3, part="p", at=1, hash="h") for i in range(n)]
    assert found(spark.createDataFrame([[r[c.split()[0]] for c in SCHEMA.split(", ")] for r in rows], SCHEMA), fanout) == (expected(rows, fanout) if n else [])


def test_proofs_lead_every_leaf_to_the_root(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rows = proofs(docs, ["doc_id", "text"]).withColumn("end", fold(F.col("leaf"), F.col("steps")))
    assert rows.count() == 40 and rows.where("end <> root").count() == 0 and rows.select("root").distinct().count() == 1
    # A leaf that is not in the table doesn't lead there.
    assert rows.where(fold(F.sha2(F.lit("x"), 256), F.col("steps")) == F.col("root")).count() == 0


def test_a_parent_needs_children(spark):
    with pytest.raises(ValueError):
        proofs(spark.createDataFrame([], SCHEMA), ["text"], fanout=1)
