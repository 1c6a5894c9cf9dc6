"""Exact top-k search by MaxScore over sharded postings of integer weights.

A vector's components, turned into integers, are its terms; a term's postings in a
shard are its column. For a query each term has a lower and an upper bound of what it
can add in the shard. Terms are sorted by that range: those whose ranges together
cannot lift a candidate over the threshold are non-essential. The essential postings
are traversed for all candidates; the others are probed, widest range first, only for
candidates whose bound still reaches the threshold. The threshold starts from the
exact scores of promising candidates, and from the k-th best of the shards before, and
never exceeds the k-th best, so results are exact; ties go to the smaller id. Shards are
merged to the best k for each query.

Integer products are computed in doubles where they are exact there. Vectors with a
larger component are set apart, in a shard and among the queries; pairs that have one
go through the same search in scaled doubles, whose error widens every comparison, and
what it leaves is scored in unbounded integers, held at the limits of a long.

Defined results: see ``vectors``; components of any finite size take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from rollsmith.llm.common import tidy
from rollsmith.llm.vectors import Held, same_width, search, sharded, times, unpack

SCALE, SEED_TERMS, SEEDS, PROBES = 1024, 8, 64, 8
_EXACT = float(1 << 53)


def top_k(candidates: np.ndarray, query: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, floor: float = -np.inf, error: float = 0.0, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``candidates`` (term-major) that may be among the k best and reach ``floor``, and their scores.

    ``error`` bounds the rounding of a score; it is 0 for integers held exactly in doubles.
    Scores beyond ``limit``, or below its negative, count as equal.
    """

    def held(threshold: float) -> float:
        return min(threshold, limit) if threshold > -limit else -np.inf

    below, above = query * low, query * high
    lower, upper = np.minimum(below, above), np.maximum(below, above)
    order = np.argsort(lower - upper, kind="stable")
    lower, upper, weight = lower[order], upper[order], query[order]
    n = candidates.shape[1]
    seeded = min(SEED_TERMS, len(order))
    partial = weight[:seeded] @ candidates[order[:seeded]]
    threshold = held(floor - error)
    if n > max(SEEDS, k):
        picked = np.argpartition(partial, n - max(SEEDS, k))[n - max(SEEDS, k) :]
        exact = weight @ candidates[np.ix_(order, picked)]
        threshold = max(threshold, held(np.partition(exact, len(exact) - k)[len(exact) - k] - 2 * error))
    # Terms from `split` on cannot alone lift a candidate from the least score to the threshold.
    suffix = np.concatenate((np.cumsum((upper - lower)[::-1])[::-1], [0.0]))
    rest = np.concatenate((np.cumsum(upper[::-1])[::-1], [0.0]))
    split = max(seeded, int(np.argmax(lower.sum() + suffix < threshold)) if np.isfinite(threshold) and lower.sum() < threshold else len(order))
    partial += weight[seeded:split] @ candidates[order[seeded:split]]
    alive = np.flatnonzero(partial + rest[split] >= threshold)
    partial = partial[alive]
    for a in range(split, len(order), PROBES):
        b = min(a + PROBES, len(order))
        partial = partial + weight[a:b] @ candidates[np.ix_(order[a:b], alive)]
        keep = partial + rest[b] >= threshold
        alive, partial = alive[keep], partial[keep]
        if len(partial) > 4 * k and b < len(order):
            # A candidate's least possible score is a floor for the k-th best.
            least = np.partition(partial, len(partial) - k)[len(partial) - k] + lower[b:].sum()
            threshold = max(threshold, held(least - 2 * error))
    return alive, partial


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) / scale, which no component overflows; from 2**60 on a double is an integer."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) < 2.0**60, np.floor(scale * x) / scale, x)


def _whole(row: np.ndarray, scale: int) -> list[int]:
    """The integers of a row of ``scaled`` values."""
    return [int(scale * v) if abs(v) < 2.0**60 else scale * int(v) for v in row.tolist()]


@tidy
def exact_search(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """For each row for which ``queries`` holds, its ``k`` highest integer inner products with other rows."""
    index, shards, rows = sharded(vectors, id_col, vec_col)
    asked = rows.where(queries)

    def run(row: dict, held: Held) -> Iterator[tuple]:
        ids, x = unpack(row["ids"], row["vectors"], row["width"])
        x, q = same_width(scaled(x, scale), scaled(held.vectors, scale))
        if not len(ids) or not len(held.ids):
            return
        most = np.sqrt(_EXACT / max(x.shape[1], 1)) / scale
        wide, wide_q = np.abs(x).max(axis=1, initial=0) >= most, np.abs(q).max(axis=1, initial=0) >= most
        out: list[list] = [[], [], []]
        groups = [(ids[part], x[part], one) for part, one in ((~wide, False), (wide, True)) if part.any()]
        for own, part, large in groups:
            columns = np.ascontiguousarray(part.T)
            low, high = columns.min(axis=1, initial=np.inf), columns.max(axis=1, initial=-np.inf)
            size = max(float(np.abs(columns).max(initial=0)), 1e-300)
            small = (columns / size, low / size, high / size) if large or wide_q.any() else None
            if not large:
                columns, low, high = columns * scale, low * scale, high * scale
            mine = times(own, held.ids)  # rows of the query's own id, which may be among the best
            for i, (number, vector) in enumerate(zip(held.ids, q)):
                if large or wide_q[i]:
                    found, scores = _rounded(own, part, *small, vector, number, k, mine[i], scale)
                else:
                    alive, scores = top_k(columns, vector * scale, k + mine[i], low, high, held.floor[i])
                    other = own[alive] != number
                    found, scores = own[alive][other], scores[other].astype(np.int64)
                best = _best(found, scores, k)
                for column, values in zip(out, (np.full(len(best), number), found[best], scores[best])):
                    column.append(values)
        yield tuple(map(np.concatenate, out))

    return search(index, shards, asked, run, k, "long")


def _rounded(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, number: int, k: int, mine: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Those among the k best by rounded products of ``columns``, scored in unbounded integers and held at the limits of a long."""
    size = max(float(np.abs(query).max(initial=0)), 1e-300)
    limit = 0.999 * 2.0**63 / scale / scale / size / max(float(np.abs(rows).max(initial=0)), 1e-300)
    alive, _ = top_k(columns, query / size, k + mine, low, high, error=max(len(query), 8) ** 2 * 2.0**-50, limit=limit)
    alive = alive[ids[alive] != number]
    terms = _whole(query, scale)
    exact = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(terms, _whole(rows[i], scale))))) for i in alive]
    order = sorted(range(len(alive)), key=lambda i: (-exact[i], ids[alive[i]]))[:k]
    return ids[alive[order]], np.array([exact[i] for i in order], np.int64)
