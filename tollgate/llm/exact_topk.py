"""Exact top-k by integer inner product: blocks in order of summed term maxima, pruned by the k-th score."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear_blocks import Hits, Method, Space, none, principal, principal_blocks, pruned, routed_search

#: Steps of a component.
SCALE = 64.0
#: Every so many ids is a query of the registered query, which asks for K.
EVERY, K = 20, 20
_LONG = 2**63


def narrow(vecs: np.ndarray) -> np.ndarray:
    """Rows whose whole numbers are so small that doubles hold their products' sums exactly."""
    dim = max(1, vecs.shape[1])
    return np.abs(vecs).max(axis=1, initial=0) <= math.floor(math.sqrt(2**52 / dim)) / SCALE - 1


def _classes(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on = narrow(vecs)
    return (~on).astype(np.int32), np.zeros(len(vecs))


def _whole(vecs: np.ndarray) -> np.ndarray:
    """floor(64 x) of any finite components, as Python's integers."""
    return np.array([[math.floor(64 * Fraction(x)) for x in row] for row in vecs.tolist()], object).reshape(vecs.shape)


def term_bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each (query, block) the sum, over terms, of the largest product that the block's greatest or least value gives."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class Terms(Space):
    """Rows of whole numbers, terms being their components; ``wide`` where doubles don't hold the products.

    Rows are cut along principal lines, so that regions and blocks hold like rows.
    """

    axis, blocks = staticmethod(principal), staticmethod(principal_blocks)

    def __init__(self, wide: bool):
        self.wide = wide

    def low(self, vecs: np.ndarray) -> np.ndarray:
        return np.zeros((len(vecs), 1)) if self.wide else vecs

    def summary(self, vecs: np.ndarray) -> np.ndarray:
        return np.zeros((len(vecs), 1)) if self.wide else np.floor(SCALE * vecs)

    def promise(self, queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        if self.wide:
            return np.full((len(queries), len(high)), -np.inf)
        on = narrow(queries)
        return np.where(on[:, None], np.floor(SCALE * np.where(on[:, None], queries, 0)) @ ((high + low) / 2).T, 0)

    def useful(self, queries: np.ndarray, kth: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        on = narrow(queries)
        if self.wide:
            return np.ones((len(queries), len(high)), bool)
        q = np.floor(SCALE * np.where(on[:, None], queries, 0))
        return ~on[:, None] | (term_bounds(q, high, low) >= kth[:, None])

    def search(self, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, first: np.ndarray, k: int, kth: np.ndarray) -> tuple[Hits, int]:
        """Exact top-k of each query among a shard's rows, in blocks.

        A block's forward index is its matrix of whole numbers. Its bound for a query sums the terms'
        maxima; where less, the bound is that of the ball around the block's mean.
        """
        on = narrow(queries)
        slow = np.arange(len(queries)) if self.wide else np.flatnonzero(~on)
        hits, scored = [none()], 0
        if len(slow):
            # Products beyond doubles: whole numbers of any size, clamped to a long.
            s = np.minimum(np.maximum(_whole(queries[slow]) @ _whole(vecs).T, -_LONG), _LONG - 1) if vecs.shape[1] else np.zeros((len(slow), len(vecs)), object)
            scored += s.size
            for i, own in zip(slow.tolist(), s.tolist()):
                order = sorted((-x, j, r) for r, (x, j) in enumerate(zip(own, ids.tolist())) if j != q_ids[i])[:k]
                hits.append((np.full(len(order), i), np.array([r for _, _, r in order], np.int64), np.array([-x for x, _, _ in order], np.int64)))
        fast = np.setdiff1d(np.arange(len(queries)), slow)
        if len(fast):
            q, v = np.floor(SCALE * queries[fast]), np.floor(SCALE * vecs)
            if v.shape[1]:
                bounds = term_bounds(q, np.maximum.reduceat(v, first[:-1]), np.minimum.reduceat(v, first[:-1]))
                mean = np.add.reduceat(v, first[:-1]) / np.diff(first)[:, None]
                radius = np.sqrt(np.maximum.reduceat(((v - np.repeat(mean, np.diff(first), axis=0)) ** 2).sum(1), first[:-1]))
                bounds = np.minimum(bounds, (q @ mean.T + np.sqrt((q**2).sum(1))[:, None] * radius) * (1 + 1e-9) + 1e-3 + 1e-9 * np.abs(bounds))
            else:
                bounds = np.zeros((len(q), len(first) - 1))
            known = np.minimum(kth[fast], 2.0**53)  # beyond it a clamped score of a wide row, which none here reaches
            (at, row, s), n = pruned(bounds, lambda some, b: q[some] @ v[first[b] : first[b + 1]].T, first, k, q_ids[fast][:, None] == ids[None, :], ids, known)
            hits.append((fast[at], row, s.astype(np.int64)))
            scored += n
        at, row, s = ([x[j] for x in hits if len(x[0])] for j in range(3))
        if not at:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), scored
        return (np.concatenate(at), np.concatenate(row), np.concatenate(s)), scored


METHOD = Method(lambda dim, kind, top: Terms(bool(kind)), _classes, False, "long")


def top_k(vectors: DataFrame, k: int = K, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact top-k: (query_id, rank, vec_id, score), score the inner product of floor(64 * x).

    ``is_query`` picks the queries by the column ``id``; by default ids divisible by 20. Candidates
    are all rows but those of the query's id. Vectors null, or holding null or non-finite
    components, and rows without id take no part; empty vectors score 0 with one another; vectors
    meet those of their own length. Ties go to the smaller id; repeated rows are rows of their own.
    Components of any finite size are exact; scores outside a long are clamped to it. Other columns,
    of whatever name, are not read. No usable rows give no rows.
    """
    asked = F.col("id") % EVERY == 0 if is_query is None else is_query
    return routed_search(vectors, METHOD, k, asked, id_col, vec_col).withColumnRenamed("id", "vec_id")


def oracle(k: int = K, every: int = EVERY) -> str:
    """The same rows in DuckDB SQL, by scoring every pair."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
   FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
