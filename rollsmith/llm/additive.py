"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one entry from each of ``BOOKS`` full-dimensional codebooks.
Codebooks are fitted on a bounded sample (``SAMPLE`` vectors by hash): k-means on the
residuals, then rounds of beam-search encoding and least squares. Every vector is
indexed: beam search keeps the ``BEAM`` best partial sums, and the norms of the vector
and of its reconstruction are stored with its codes. A query's products with all
entries make lookup tables; a candidate's estimate is the sum of its entries' products
times the ratio of the stored norms. Of every shard the best estimates of a query are scored
exactly, on the original vectors: one in ``SHARE``, and ``RERANK`` over all shards at least. How many
depends on the shards alone, not on how many tasks hold them. Equal vectors share one entry of the
index and are all expanded again, so ties go to the smaller ids however many copies there are.

Components of any finite size take part: the index is in units of the sample's middle size, a query
in units of its own, and vectors too large for squares and estimates are set apart and always
scored exactly. A product whose terms overflow is formed in units of both vectors.

Rows that take no part: null or non-finite vectors or components, zero vectors, null ids. An empty
table gives no rows; other columns are not read, whatever their names. See also ``vectors``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import materialize, tidy
from rollsmith.llm.vectors import Held, same_width, search, sharded, times, unpack

#: Bound of the training sample; codebooks and their size; beam width.
SAMPLE, BOOKS, ENTRIES, BEAM = 8192, 16, 128, 4
#: Best estimates of a query that are scored exactly: at least so many in all, and one in so many of each shard.
RERANK, SHARE = 256, 64
#: Units from which on a vector is set apart.
LARGE = 64.0
ROUNDS, LLOYD, SEED = 2, 8, 3


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search over the residual codebooks."""
    n = len(x)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :]
    for book in books:
        size, width = len(book), rest.shape[1]
        cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(axis=1)
        flat = cost.reshape(n, width * size)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
        parent, entry = best // size, best % size
        row = np.arange(n)[:, None]
        codes = np.concatenate((codes[row, parent], entry[:, :, None].astype(np.uint8)), axis=2)
        rest = rest[row, parent] - book[entry]
    final = (rest * rest).sum(axis=2).argmin(axis=1)
    return codes[np.arange(n), final]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit_codebooks(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = SEED) -> np.ndarray:
    """Codebooks (books, entries, dimensions) for a sample of vectors."""
    rng = np.random.default_rng(seed)
    entries = max(1, min(entries, len(sample)))
    rest, out = sample.copy(), []
    for _ in range(books):
        book = rest[rng.choice(len(rest), entries, replace=False)].copy()
        for _ in range(LLOYD):
            near = _nearest(rest, book)
            counts = np.bincount(near, minlength=entries)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        rest = rest - book[_nearest(rest, book)]
        out.append(book)
    result = np.stack(out)
    for _ in range(ROUNDS):
        codes = encode(sample, result).astype(np.int64) + np.arange(books) * entries
        size = books * entries
        together = np.zeros((size, size))
        for a in range(books):
            for b in range(books):
                np.add.at(together, (codes[:, a], codes[:, b]), 1)
        right = np.zeros((size, sample.shape[1]))
        for a in range(books):
            np.add.at(right, codes[:, a], sample)
        flat = result.reshape(size, -1)
        result = (flat + np.linalg.solve(together + 1e-2 * np.eye(size), right - together @ flat)).reshape(result.shape)
    return result


def _indexed(books: np.ndarray, unit: float):
    """Add to each packed shard the distinct vectors' codes, norm ratios (NaN for those set apart) and members."""
    names = ["shard", "ids", "vectors", "width", "codes", "ratio", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = unpack(*(batch.column(n)[i].as_py() for n in ("ids", "vectors", "width")))
                rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1])))[:, 0]
                _, first, owner = np.unique(rows, return_index=True, return_inverse=True)
                order = np.lexsort((ids, owner))
                distinct = x[first]
                with np.errstate(over="ignore"):
                    units = distinct / unit
                apart = ~(np.abs(units).max(axis=1, initial=0) < LARGE)
                units[apart] = 0
                wide, fitted = same_width(units, books.reshape(-1, books.shape[2]))
                fitted = fitted.reshape(books.shape[0], books.shape[1], -1)
                codes = encode(wide, fitted)
                near = decode(codes, fitted)
                ratio = np.linalg.norm(wide, axis=1) / np.maximum(np.linalg.norm(near, axis=1), 1e-12)
                ratio[apart] = np.nan
                ends = np.cumsum(np.bincount(owner, minlength=len(first)))
                cells = [batch.column("shard")[i].as_py(), ids[order].tobytes(), distinct.tobytes(), x.shape[1], codes.tobytes(), ratio.tobytes(), ends.astype(np.int64).tobytes()]
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

    return run


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with one query; each row's sum is formed alike, so equal rows give equal sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.einsum("rd,d->r", np.ascontiguousarray(rows), query)
        if not (fine := np.isfinite(found)).all():
            large = rows[~fine]
            size, own = np.abs(large).max(axis=1), np.abs(query).max()
            found[~fine] = np.einsum("rd,d->r", large / size[:, None], query / own) * size * own
    return found


@tidy
def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, rerank: int = RERANK) -> DataFrame:
    """For each row for which ``queries`` holds, the ``k`` rows found nearest by inner product.

    ``rerank`` estimates at least are scored exactly for each query; more find more.
    """
    packed, shards, rows = sharded(vectors, id_col, vec_col, drop_zero=True)
    sample = [r[0] for r in rows.select("vector", F.xxhash64("id", F.lit(9)).alias("at"), "id").orderBy("at", "id").limit(SAMPLE).select("vector").collect()]
    width = max(map(len, sample), default=1)
    drawn = np.array([v + [0.0] * (width - len(v)) for v in sample]).reshape(len(sample), width)
    unit = float(np.median(np.abs(drawn).max(axis=1))) if sample else 1.0
    with np.errstate(over="ignore"):
        drawn = drawn / unit
    drawn = drawn[np.abs(drawn).max(axis=1, initial=0) < LARGE]
    fitted = fit_codebooks(drawn) if len(drawn) else np.zeros((1, 1, 1))
    index = materialize(packed.mapInArrow(_indexed(fitted, unit), "shard int, ids binary, vectors binary, width int, codes binary, ratio binary, ends binary"))

    def run(row: dict, held: Held) -> Iterator[tuple]:
        ends = np.frombuffer(row["ends"], np.int64)
        ids = np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["vectors"], np.float64).reshape(len(ends), row["width"])
        if not len(x) or not len(held.ids):
            return
        x, q = same_width(x, held.vectors)
        if "tables" not in held.state:
            flat, asked = same_width(fitted.reshape(-1, fitted.shape[2]), held.vectors / np.abs(held.vectors).max(axis=1)[:, None])
            held.state["tables"] = (asked @ flat.T).astype(np.float32).reshape(len(asked), fitted.shape[0], fitted.shape[1])
        tables = held.state["tables"]
        codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ends), -1)
        estimate = np.zeros((len(q), len(x)), np.float32)
        for m in range(codes.shape[1]):
            estimate += np.take(tables[:, m, :], codes[:, m], axis=1)
        estimate *= np.frombuffer(row["ratio"], np.float64).astype(np.float32)
        apart = np.isnan(estimate[0])
        estimate[:, apart] = -np.inf
        mine = times(np.sort(ids), held.ids)  # rows of a query's own id, which may be among the best
        wanted = min(len(x), max(-(-rerank // shards), -(-len(x) // SHARE), k) + int(mine.max()))
        good = apart | (estimate >= np.partition(estimate, len(x) - wanted, axis=1)[:, len(x) - wanted, None])
        begins = np.concatenate(([0], ends[:-1]))
        out: list[list] = [[], [], []]
        for i, (number, vector) in enumerate(zip(held.ids, q)):
            rows_ = np.flatnonzero(good[i])
            s = products(x[rows_], vector)
            near = s >= held.floor[i]
            rows_, s = rows_[near], s[near]
            most = k + int(mine[i])
            if len(s) > most:
                near = s >= np.partition(s, len(s) - most)[len(s) - most]
                rows_, s = rows_[near], s[near]
            if not len(s):
                continue
            n = np.minimum(ends - begins, most)[rows_]  # of equal vectors only the smallest ids can be among the first k
            place = np.repeat(begins[rows_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found, s = ids[place], np.repeat(s, n)
            other = found != number
            found, s = found[other], s[other]
            best = np.lexsort((found, -s))[:k]
            for column, values in zip(out, (np.full(len(best), number), found[best], s[best])):
                column.append(values)
        if out[0]:
            yield tuple(map(np.concatenate, out))

    return search(index, shards, rows.where(queries), run, k, "double", state=4 * fitted.shape[0] * fitted.shape[1])
