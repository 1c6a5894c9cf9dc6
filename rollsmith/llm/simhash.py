"""Near-duplicates by SimHash, found through deletion-variant signatures.

A text is lower-cased (A-Z), cut into words at ASCII white space and into shingles
of ``width`` words; a bit of its 64-bit fingerprint is set if it is set in over half
of the shingles' XXH64 values (seed 42). Fingerprints link at ``MAX_BITS`` = 3 or
fewer differing bits. Of the two 32-bit halves of linked fingerprints, one differs
in at most one bit, so each distinct fingerprint is indexed under the 64 variants
that leave out one bit of one half; an equality grouping brings candidates together
and the distance is verified. A group yields a spanning forest of its links, never
all pairs, and a group too large to compare directly is indexed again by the
one-wildcard variants of the other half's 16-bit pieces, which loses no link.

Defined results: a null or blank text has fingerprint zero; fewer words than
``width`` make one shingle; a null id is never a component's id, unless no member
has one (then null); repeated rows share their component; empty gives empty. Very
long texts are read whole, in runs of words; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import LOWER, TextBuffer, frugal, materialize, slices, tidy
from rollsmith.llm.components import connected_components

MAX_BITS, SEED = 3, 42
#: Bytes of a text that are cut into words at once, and the group size from which a group is indexed again.
PIECE, DIRECT = 1 << 20, 4096


def _word_lists(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by ``width - 1`` words, so memory stays bounded."""
    if len(text) <= PIECE:
        yield text.split()
        return
    kept: list[bytes] = []
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE]
        words = piece.split()
        rest = b""
        if at + PIECE < len(text) and words and not piece[-1:].isspace():
            rest = words.pop()
        run = kept + words
        if len(run) >= width or at + PIECE >= len(text):
            yield run
            kept = run[len(run) - width + 1 :] if width > 1 else []
        else:
            kept = run


def digests(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The XXH64 values of the shingles of UTF-8 bytes, in runs."""
    n = 0
    digest = xxhash.xxh64_intdigest
    for words in _word_lists(text.translate(LOWER.tobytes()), width):
        if not words:
            continue
        joined = b" ".join(words)
        lengths = list(map(len, words))
        ends = list(accumulate(x + 1 for x in lengths))
        starts = [e - x - 1 for e, x in zip(ends, lengths)]
        if len(words) < width:
            if n:
                continue
            values = [digest(joined, SEED)]
        else:
            values = list(map(digest, [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :])], repeat(SEED)))
        n += len(values)
        yield np.array(values, dtype="<u8")


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in over half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of UTF-8 bytes, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for values in digests(text, width):
        counts += bit_counts(values)
        n += len(values)
    return majority(counts, n)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, text_hash, fp`` for every row: fp is the fingerprint as a signed long."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buffer = TextBuffer(part.column("text"))
                data, at = buffer.data.tobytes(), buffer.offsets.tolist()
                found = np.array([fingerprint(data[a:b], width) for a, b in zip(at, at[1:])], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(found)], names=["id", "text_hash", "fp"])

    return kept.mapInArrow(frugal(run), f"id {kept.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def _forest(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct values, by search over those not yet reached."""
    rest = values
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for f in frontier:
                hit |= np.bitwise_count(rest ^ f) <= MAX_BITS
            frontier, rest = rest[hit], rest[~hit]
            if len(frontier):
                yield np.full(len(frontier), root), frontier


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys that are longer than one."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    long = np.diff(edge) > 1
    return edge[:-1][long], edge[1:][long]


def group_links(values: np.ndarray, high: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the distinct values of one group; ``high`` says that the upper half is the shared one."""
    if len(values) <= DIRECT:
        yield from _forest(values)
        return
    other = values & np.uint64(0xFFFFFFFF) if high else values >> np.uint64(32)
    for piece in (0, 16):
        part = (other >> np.uint64(piece)) & np.uint64(0xFFFF)
        for bit in range(16):
            keys = part & ~np.uint64(1 << bit)
            order = np.argsort(keys, kind="stable")
            for a, b in zip(*_runs(keys[order])):
                yield from _forest(values[order[a:b]])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of equal keys of a partition sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, ends = _runs(keys)
        two = ends - starts == 2
        a, b = fps[starts[two]], fps[starts[two] + 1]
        near = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        left, right = [a[near]], [b[near]]
        for s, e in zip(starts[~two], ends[~two]):
            for x, y in group_links(np.unique(fps[s:e]), bool(keys[s] >> 37)):
                left.append(x)
                right.append(y)
        x, y = np.concatenate(left), np.concatenate(right)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = batch.column("key").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        if held and held[0][0][0] == keys[-1]:
            held.append((keys, fps))
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from solve(*(np.concatenate(x) for x in zip(*held, (keys[:cut], fps[:cut]))))
        held = [(keys[cut:], fps[cut:])]
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held)))


def links(distinct: DataFrame) -> DataFrame:
    """A spanning set of the links ``a, b`` between distinct fingerprints (column ``fp``)."""
    variant = "transform(sequence(0, 63), i -> shiftleft(cast(i as bigint), 32) + ((shiftright(fp, 32 * (i div 32)) & 4294967295L) & ~shiftleft(1L, i % 32)))"
    keyed = distinct.select("fp", F.explode(F.expr(variant)).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(_linked), "a long, b long")


def components(rows: DataFrame) -> DataFrame:
    """``fp, label`` for each distinct fingerprint: label is the same for all that links connect."""
    distinct = rows.select("fp").distinct()
    labels = connected_components(links(distinct))
    return distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))


@tidy
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: its id, ``fingerprint`` in hex, and ``component_id``."""
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    per = rows.groupBy("fp").agg(F.min("id").alias("least"))
    label = components(rows)
    per = materialize(per.join(label, "fp"))
    by_label = per.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = per.join(by_label, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@tidy
def _kept(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    return kept_firsts(rows, "fp", components(rows).select(F.col("fp").alias("node"), "label"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows, with all their columns, of one document a component: the smallest id (known ids first)."""
    return first_rows(docs, _kept(docs, id_col, text_col, width), id_col=id_col, text_col=text_col)


def kept_firsts(rows: DataFrame, node: str, labels: DataFrame) -> DataFrame:
    """``key, many``: the id and text hash of the row that stays of each label, and whether rows repeat them.

    ``rows`` has ``id, text_hash`` and the column ``node``; what ``labels`` (``node, label``) lacks is alone.
    """
    counted = rows.groupBy(node, "id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash", (F.col("n") > 1).alias("many"))
    first = counted.groupBy(F.col(node).alias("at")).agg(F.min(order).alias("first"))
    kept = first.join(labels, first["at"] == labels["node"], "left").groupBy(F.coalesce("label", "at").alias("label")).agg(F.min("first").alias("first"))
    return kept.select(F.struct(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash")).alias("key"), F.col("first.many").alias("many"))


def first_rows(docs: DataFrame, kept: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows whose id and text hash are a ``key`` of ``kept``, each key once; texts are exchanged once."""
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("row_key"))
    met = lambda x: keyed.join(x.hint("shuffle_hash"), keyed["row_key"] == x["key"])
    if kept.where("many").isEmpty():
        return met(kept).select("row.*")
    return met(kept.where("not many")).select("row.*").union(met(kept.where("many")).dropDuplicates(["row_key"]).select("row.*"))
