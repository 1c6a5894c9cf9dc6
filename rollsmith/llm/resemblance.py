"""Near-duplicate stage: SimHash links, completed and verified by the similarity of five-word shingles.

A text is lower-cased (A-Z), cut into words at ASCII white space and into shingles of
``WIDTH`` = 5 words. Texts link at a Jaccard similarity of ``ALIKE`` = 0.8 or more of their
sets of distinct shingles (32 bits of their XXH64 values), counted on the whole sets.

Candidates come first from ``simhash``: fingerprints of the five-word shingles within
``simhash.MAX_BITS`` differing bits, by deletion-variant signatures. Texts just 0.8 alike
differ in some 10 of 64 bits, which no segment small enough to be exact and large enough
to be selective reaches, so these candidates are completed by ``BANDS`` keys of ``ROWS``
minimum hashes each: a pair at 0.8 shares no key with a chance of 0.672**20, 0.04 %,
and fewer at more. Before sets are compared, a pair's lengths and two bits of each of
128 minimum hashes must leave 0.8 possible (four standard deviations).

Equal sets are one node. In a group of equal keys of up to ``DIRECT`` nodes every pair
is a candidate; in a larger one each node meets the group's most central ones and those
nearest to it in a sample. What these links leave unconnected is then compared, in
blocks of bounded size, with every node of the group that has another label; only links
leave such a task, never pairs. So work stays in proportion where a large group is
alike and no pair is left out; where many are nearly alike, but under 0.8 to all, time
grows with the square of their number, and rows moved with that square over a block's size.

Defined results: null and blank texts have the empty set and are alike; fewer words
than ``WIDTH`` make one shingle; of a group the smallest known id stays, once, even if its
row is repeated; rows of unknown id stay only where no id is known; texts of any length
are read whole; all columns are kept, whatever their names; empty gives empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm import simhash
from rollsmith.llm.common import TextBuffer, frugal, materialize, slices, tidy
from rollsmith.llm.components import connected_components
from rollsmith.llm.simhash import digests, first_rows, kept_firsts, majority

WIDTH, ALIKE = 5, 0.8
HASHES, BANDS, ROWS = 128, 20, 5
#: Nodes of a group that are compared pair by pair; of a larger one its central nodes, the nearest each node meets, the sample they are from, and nodes held at once.
DIRECT, CENTRES, NEAREST, SAMPLE, SLAB = 32, 2, 2, 512, 1 << 16
#: Shingles of the two sides of a block in which nodes that are still unconnected are compared.
SIDE, OTHER = 1 << 20, 1 << 22
#: Pairs of one node that a task compares.
PAIRS = 256
#: Of 128 pairs of bits, those that differ at 0.8: 0.15 of them, and four standard deviations.
DIFFER = 36
_FACTORS = np.random.default_rng(7).integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = [f"k{i}" for i in range(HASHES // 32)]


def shingled(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The distinct shingles of UTF-8 bytes, sorted, as 32-bit numbers, and the fingerprint of all."""
    parts, counts, n = [], np.zeros(64, np.int64), 0
    for values in digests(text, width):
        parts.append(np.unique((values >> np.uint64(32)).astype(np.uint32)))
        counts += simhash.bit_counts(values)
        n += len(values)
    whole = (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))) if parts else np.zeros(0, np.uint32)
    return whole, majority(counts, n)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return shingled(text, width)[0]


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of the hashes over a set."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(shingles[at : at + 2048], _FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of rows of minimum hashes."""
    bands = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ bands[:, :, r]) * _MIX
        key ^= key >> np.uint64(32)
    return key


def sketches(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum hash, 32 hashes a word."""
    two = ((least >> np.uint32(13)) & np.uint32(3)).astype(np.uint64).reshape(len(least), -1, 32)
    return np.bitwise_or.reduce(two << np.arange(0, 64, 2, dtype=np.uint64), axis=2)


def differing(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many of the pairs of bits differ."""
    x = many ^ one
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, text_hash, node, n, fp, shingles, keys`` and the sketch of every row; a node is a distinct set."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                buffer = TextBuffer(part.column("text"))
                data, at = buffer.data.tobytes(), buffer.offsets.tolist()
                sets, prints = zip(*(shingled(data[a:b], width) for a, b in zip(at, at[1:])))
                least = np.array([least_hashes(s) for s in sets])
                keys, sketch = band_keys(least).view(np.int64), sketches(least).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                columns = [part.column("id"), part.column("text_hash"), pa.array(node), pa.array(list(map(len, sets)), pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())]
                columns += [pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "n", "fp", "shingles", "keys", *_SKETCH])

    return kept.mapInArrow(frugal(run), f"id {kept.schema['id'].dataType.simpleString()}, text_hash long, node long, n long, fp long, shingles binary, keys array<long>, " + ", ".join(f"{k} long" for k in _SKETCH))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """The columns of each group of equal keys with more than one row, of a partition sorted by ``key``.

    A group of over ``SLAB`` rows comes in parts; the flag says that a group is whole.
    """
    key, parts, size, parted = None, [], 0, False

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts)]

    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in names]
        keys = columns[0]
        if not len(keys):
            continue
        begin = int(np.searchsorted(keys, key, side="right")) if key is not None and keys[0] == key else 0
        if begin:
            parts.append([c[:begin] for c in columns])
            size += begin
        if begin < len(keys):  # the group that was held has ended
            if size > 1 or parted and size:
                yield not parted, joined()
            last = int(np.searchsorted(keys, keys[-1]))
            edge = begin + np.flatnonzero(np.concatenate(([True], keys[begin + 1 : last] != keys[begin : last - 1], [True]))) if last > begin else np.zeros(0, np.int64)
            for i in np.flatnonzero(np.diff(edge) > 1):
                yield True, [c[edge[i] : edge[i + 1]] for c in columns]
            key, parts, size, parted = keys[-1], [[c[last:] for c in columns]], len(keys) - last, False
        if size >= SLAB:
            yield False, joined()
            parts, size, parted = [], 0, True
    if size > 1 or parted and size:
        yield not parted, joined()


def _possible(n: np.ndarray, sketch: np.ndarray, i: int) -> np.ndarray:
    """Which nodes may be alike to node ``i``, by lengths and sketches."""
    return (np.minimum(n, n[i]) >= ALIKE * np.maximum(n, n[i]) - 1e-9) & (differing(sketch, sketch[i]) <= DIFFER)


def _centres(sketch: np.ndarray) -> np.ndarray:
    """The nodes nearest to what is most frequent in each place of the sketch."""
    some = (sketch[:SAMPLE, :, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    most = np.stack([(some == v).sum(axis=0) for v in range(4)]).argmax(axis=0).astype(np.uint64)
    centre = np.bitwise_or.reduce(most << np.arange(0, 64, 2, dtype=np.uint64), axis=1)
    return np.argsort(differing(sketch, centre), kind="stable")[:CENTRES]


def _sent(columns: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if columns["a"]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns.values()], names=list(columns))


def _nearest(n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each node the ``NEAREST`` of a sample that may be alike; nodes come in the order of their hashes."""
    some = min(SAMPLE, len(n))
    for at in range(0, len(n), 1024):
        mine = slice(at, at + 1024)
        far = differing(sketch[mine, None, :], sketch[None, :some, :])
        far[np.minimum(n[mine, None], n[:some]) < ALIKE * np.maximum(n[mine, None], n[:some]) - 1e-9] = 999
        own = np.arange(at, min(at + 1024, some))
        far[own - at, own] = 999
        for j in np.argsort(far, axis=1, kind="stable")[:, :NEAREST].T:
            good = np.flatnonzero(far[np.arange(len(j)), j] <= DIFFER)
            yield at + good, j[good]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each group; of a large one those of its centres and samples, and its nodes (``b`` = ``a``) by key."""
    out: dict[str, list[np.ndarray]] = {"key": [], "a": [], "b": []}
    rows = 0
    for whole, (key, node, n, *words) in _groups(batches, ["key", "node", "n", *_SKETCH]):
        sketch = np.stack(words, axis=1).view(np.uint64)
        direct = whole and len(node) <= DIRECT
        for i in range(len(node)) if direct else _centres(sketch):
            hit = _possible(n, sketch, i)
            hit[: i + 1 if direct else 0] = False
            hit[i] = False
            found = node[hit]
            for name, x in (("key", np.zeros(len(found), np.int64)), ("a", np.full(len(found), node[i])), ("b", found)):
                out[name].append(x)
            rows += len(found)
        if not direct:
            for i, j in _nearest(n, sketch):
                for name, x in (("key", np.zeros(len(i), np.int64)), ("a", node[j]), ("b", node[i])):
                    out[name].append(x)
            for name, x in (("key", key), ("a", node), ("b", node)):
                out[name].append(x)
            rows += 3 * len(node)
        if rows > 50_000:
            yield from _sent(out)
            out, rows = {"key": [], "a": [], "b": []}, 0
    yield from _sent(out)


def _between(key: int, mine: list[tuple], other: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links of each node of ``mine`` with one node of ``other`` for each label they do not share.

    A pair that shares an earlier key as well is left to that key's group.
    """
    node, label, n = (np.array([x[k] for x in other], np.int64) for k in range(3))
    sketch, keys = np.array([x[3] for x in other], np.int64).view(np.uint64), np.array([x[4] for x in other], np.int64)
    values = np.concatenate([x[5] for x in other])
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(other)), n)[order]
    values = values[order]
    for a, a_label, a_n, a_sketch, a_keys, own in mine:
        hit = (label != a_label) & (np.minimum(n, a_n) >= ALIKE * np.maximum(n, a_n) - 1e-9)
        hit &= differing(sketch, np.array(a_sketch, np.int64).view(np.uint64)) <= DIFFER
        band = a_keys.index(key)
        if band and hit.any():
            hit &= ~(keys[:, :band] == np.array(a_keys[:band], np.int64)).any(axis=1)
        if not hit.any():
            continue
        low = np.searchsorted(values, own)
        count = np.searchsorted(values, own, side="right") - low
        places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[places], minlength=len(other))
        good = np.flatnonzero(hit & (both >= ALIKE * (a_n + n - both) - 1e-9))  # a similarity of just 0.8 counts
        for i in good[np.unique(label[good], return_index=True)[1]].tolist():
            yield a, int(node[i])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each block of a partition sorted by key and block, ``side`` 0 first."""
    block, sides = None, ([], [])

    def solved() -> Iterator[pa.RecordBatch]:
        if sides[0] and sides[1] and (found := list(_between(block[0], *sides))):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "mine", "other", "side", "node", "label", "n", "keys", *_SKETCH)]
        for *now, side, node, label, n, keys, p, q, r, t, data in zip(*columns, batch.column("shingles")):
            if now != block:
                yield from solved()
                block, sides = now, ([], [])
            sides[side].append((node, label, n, (p, q, r, t), keys, np.frombuffer(data.as_buffer(), np.uint32).copy()))
    yield from solved()


def remaining(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` in large groups (``key, node``) between nodes that ``labels`` does not connect yet.

    Nodes outside their group's most frequent label are compared with all of the group.
    """
    known = members.join(labels.select(F.col("node").alias("labelled"), "label"), F.col("node") == F.col("labelled"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    known = materialize(known.join(nodes.select("node", "n"), "node"))
    per = known.groupBy("key", "label").agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).groupBy("key").agg(F.max(F.struct("nodes", "label", "n")).alias("top"), F.sum("nodes").alias("nodes"), F.sum("n").alias("n"))
    per = per.where(F.col("top.nodes") < F.col("nodes")).select(F.col("key").alias("group"), F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / SIDE + 0.001).cast("int").alias("mines"), F.ceil(F.col("n") / OTHER + 0.001).cast("int").alias("others"))
    open_ = known.join(per, known["key"] == per["group"]).drop("group")
    at = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = open_.where("label <> top").select("key", "node", "label", F.lit(0).alias("side"), at(1, "mines").alias("mine"), every("others").alias("other"))
    other = open_.select("key", "node", "label", F.lit(1).alias("side"), every("mines").alias("mine"), at(2, "others").alias("other"))
    whole = nodes.join(sets, "node")
    met = mine.union(other).join(whole, "node").repartition("key", "mine", "other").sortWithinPartitions("key", "mine", "other", "side", "node")
    return met.mapInArrow(frugal(_rest), "a long, b long")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are alike; ahead of the pairs of a node comes its own row, with ``b`` null."""
    head, own = None, np.zeros(0, np.uint32)
    for batch in batches:
        a, b = [], []
        for x, y, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")):
            s = np.frombuffer(data.as_buffer(), np.uint32)
            if y is None:
                head, own = x, s.copy()
            elif x == head:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both >= ALIKE * (len(own) + len(s) - both) - 1e-9:  # a similarity of just 0.8 counts
                    a.append(x)
                    b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets (``node, shingles``) are alike. A node's pairs are dealt to as many tasks as they need."""
    heads = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {PAIRS}) as int)").alias("parts"))
    dealt = pairs.join(heads, "a").select("a", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"), "b")
    others = dealt.join(sets, dealt["b"] == sets["node"]).select("a", "part", "b", "shingles")
    own = heads.join(sets, heads["a"] == sets["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    met = own.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.mapInArrow(frugal(_alike), "a long, b long")


def printed(rows: DataFrame) -> DataFrame:
    """Candidates ``a, b``: nodes of equal fingerprints, and of those that ``simhash`` links."""
    per = rows.groupBy("fp").agg(F.min("node").alias("least"))
    same = rows.select("fp", "node").distinct().join(per, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(per.select("fp"))
    first, second = (per.select(F.col("fp").alias(f"{x}_fp"), F.col("least").alias(f"{x}_node")) for x in "xy")
    linked = near.join(first, near["a"] == first["x_fp"]).join(second, near["b"] == second["y_fp"]).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    return same.union(linked.where("a <> b"))


@tidy
def links(rows: DataFrame) -> DataFrame:
    """A spanning set of the links ``a, b`` between the nodes of ``described`` rows."""
    nodes = materialize(rows.dropDuplicates(["node"]).select("node", "n", "keys", *_SKETCH))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n", *_SKETCH).repartition("key").sortWithinPartitions("key", "node")
    found = materialize(keyed.mapInArrow(frugal(_near), "key long, a long, b long"))
    members = found.where("a = b").select("key", F.col("a").alias("node"))
    pairs = materialize(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(printed(rows)).distinct())
    touched = found.select(F.col("a").alias("node")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = materialize(rows.select("node", "shingles").join(touched, "node", "left_semi").dropDuplicates(["node"]))
    first = materialize(alike(pairs, sets))
    if members.isEmpty():
        return first
    return first.union(remaining(members, connected_components(first), nodes, sets))


@tidy
def kept_alike(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Which row stays of each group that links connect, for ``first_rows``."""
    rows = materialize(described(docs, id_col, text_col, width))
    return kept_firsts(rows, "node", connected_components(links(rows)))


def keep_one_alike(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, of one document of each group that links connect: the smallest id (known ids first)."""
    return first_rows(docs, kept_alike(docs, id_col, text_col, width), id_col=id_col, text_col=text_col)
