"""How document filters interact: what each removes, alone and in every order of all.

Texts are read from Arrow buffers: byte classes mark words, capitals and symbols, and prefix
sums of the marks count them for each text. A word's hash is a difference of prefix sums over
the bytes; a text's hashes are sorted, equal neighbours are held against each other byte by
byte, and what repeats is not distinct. A text whose words collide is counted word by word.
Each document so becomes a mask, with one bit for each filter that it fails.

Whether a text repeats one of a smaller id is found from digests: rows are counted for each
digest and what else is reported before they meet, so copies, however many, arrive as a few rows.
Masks are counted for each part, and the orders work on the counts alone: a part's 2 ** filters
masks give the figures of all orders and steps.

Defined results: a null text is empty; an empty text has no word, so it fails only what asks for
a least number, and a copy of it is a copy. A document of null id is never a copy nor the original
of one; rows that repeat an id are counted each, and are no copies of each other. Labels that
repeat an id hold if any row does; labels of null id, or of no document, count nowhere. A null part
is the empty string. Long texts are read whole, in blocks; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.llm.common import TextBuffer, frugal, materialize, slices, tidy

#: Bounds of the filters A (words), B (distinct words, percent), C (capitals, percent); the symbols of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes of text scanned at a time.
BLOCK = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _FIRST = (np.zeros(256, bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS)] = True
_FIRST[:128] = _FIRST[192:] = True  # bytes that begin a character
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[:1] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each word, as if it stood at the start."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[begins]) * down[begins]


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` on and from ``b`` on are equal, for each pair."""
    out, at = np.ones(len(a), bool), 0
    total = np.cumsum(size)
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        n = size[at:end]
        start = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(start, n)
        same = data[np.repeat(a[at:end], n) + step] == data[np.repeat(b[at:end], n) + step]
        out[at:end] = np.logical_and.reduceat(same, start)
        at = end
    return out


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a buffer into about ``BLOCK`` bytes, none of them within a word."""
    start = 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data) and not (gap := _SPACE[data[end : end + BLOCK]]).any():
            end += BLOCK
        end = end + int(gap.argmax()) if end < len(data) else len(data)
        yield start, end
        start = end


def count_texts(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words, distinct words, capitals, characters and symbols of each text."""
    buffer = TextBuffer(texts)
    n = len(buffer)
    first = np.zeros(len(buffer.data) + 1, bool)
    first[buffer.offsets[:-1]] = True
    counts = np.zeros((3, n), np.int64)
    begins, ends, hashes = [], [], []
    for a, b in _blocks(buffer.data):
        data = buffer.data[a:b]
        for row, marks in zip(counts, (_CAPITAL, _FIRST, _SYMBOL)):
            total = np.concatenate(([0], np.cumsum(marks[data], dtype=np.int64)))
            at = np.clip(buffer.offsets - a, 0, b - a)
            row += total[at[1:]] - total[at[:-1]]
        word = ~_SPACE[data]
        before = np.concatenate(([False], word[:-1])) & ~first[a:b]
        after = np.concatenate((word[1:], [False])) & ~first[a + 1 : b + 1]
        begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        hashes.append(_hashes(data, begin, end))
        begins.append(begin + a)
        ends.append(end + a)
    begin, end, code = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((begins, np.int64), (ends, np.int64), (hashes, np.uint64)))
    owner = np.searchsorted(buffer.offsets[1:], begin, "right")
    words = np.bincount(owner, minlength=n)
    order = np.lexsort((code, owner))
    here = np.flatnonzero((code[order[1:]] == code[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    one, other = order[here], order[here + 1]
    size = end[one] - begin[one]
    same = size == end[other] - begin[other]
    same[same] = _alike(buffer.data, begin[one[same]], begin[other[same]], size[same])
    distinct = words - np.bincount(owner[one], minlength=n)
    for text in np.unique(owner[one[~same]]):
        mine = slice(*np.searchsorted(owner, (text, text + 1)))
        distinct[text] = len({buffer.data[a:b].tobytes() for a, b in zip(begin[mine], end[mine])})
    return words, distinct, *counts


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", BLOCK):
            words, distinct, capitals, characters, symbols = count_texts(piece.column("text"))
            fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * characters, symbols > 0)
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("part"), piece.column("digest"), pa.array(mask, pa.int32())], names=["id", "part", "digest", "mask"])


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, digest, mask``: each document's text as a digest, and bits 0 to 3 for the filters A to D that it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(frugal(_masks), "id long, part string, digest binary, mask int")


def with_copies(marked: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """``part, mask, n, good, toxic``: documents counted by mask, with bit 4 for texts that a smaller id has too."""
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(good_col) == 1).alias("good"), F.max(F.col(bad_col) == 1).alias("toxic"))
    no, keys = F.lit(False), ["digest", "mask", "part", "good", "toxic"]
    known = marked.where("id is not null").join(told, "id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    same = known.groupBy("id", *keys).agg(F.count("*").alias("rows"))
    groups = same.groupBy(*keys).agg(F.min(F.struct("id", "rows")).alias("least"), F.sum("rows").alias("rows"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("least.id") == first, F.col("least.rows")).otherwise(0)
    copy = F.lit(1 << FILTERS.index("E"))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("rows") - F.col("own")).alias("n")))
    found = groups.withColumn("own", own).select("part", "good", "toxic", F.inline(split)).where("n > 0")
    unknown = marked.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": no, "toxic": no})
    return found.unionByName(unknown).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def orders(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit of every order of the filters, from ``part, mask, n, good, toxic``; a mask has a bit for each of ``names``."""
    chains = np.array(list(itertools.permutations(range(len(names)))))
    bits, masks = 1 << chains, np.arange(1 << len(names))
    seen = np.cumsum(bits, axis=1) - bits
    bit, before = bits.reshape(-1, 1), seen.reshape(-1, 1)
    fails, earlier = masks & bit > 0, masks & before > 0
    here = (fails & ~earlier).astype(np.int64)
    redundant, alone, kept = ((x).astype(np.int64) for x in (fails & earlier, masks == bit, masks & (bit | before) == 0))
    text = np.repeat(["".join(names[i] for i in c) for c in chains], len(names))
    step = np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(chains))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                count = np.zeros((3, len(masks)), np.int64)
                for cell in cells:
                    count[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                removed = here @ count[0]
                share = np.zeros(len(names), np.int64)
                np.add.at(share, chains.ravel(), removed)
                rows = [kept @ count[0], removed, redundant @ count[0], alone @ count[0], here @ count[1], here @ count[2], share[chains.ravel()]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(step)), pa.array(text), pa.array(step), *map(pa.array, rows)], names=["part", "filter_order", "step", *columns])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


@tidy
def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, order of the five filters and step: what is kept, removed, redundant, failed by this filter alone, lost of good and toxic documents, and the filter's removals over all orders."""
    marked = materialize(failures(docs, id_col=id_col, text_col=text_col, part_col=part_col))
    return orders(with_copies(marked, labels, id_col=id_col))
