"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear_blocks import Hits, Method, Space, edges, merge_best, none, routed_search

#: Projected dimensions (even), and confidence of the stopping test.
DIMS, SURE = 24, 0.85
#: Shares of the test's squared radius up to which projected neighbours are verified in turn.
RINGS = (0.5, 0.75, 1.0)
EVERY, K, SEED = 20, 20, 42
#: What rounding may take from a projected squared distance, and from an inner product in single precision.
_NEAR, _SLACK = 1e-4, 1e-5


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def quantile(sure: float, dims: int) -> float:
    """Where ``chi_square`` reaches ``sure``."""
    low, high = 0.0, 100.0 + 10 * dims
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if chi_square(mid, dims) >= sure else (mid, high)
    return high


def _classes(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half octave of each vector's norm, and the norm's binary logarithm; of any finite vectors but zero."""
    _, e = np.frexp(np.abs(vecs).max(axis=1, initial=0))
    size = e + np.log2(np.sqrt((np.ldexp(vecs, -e[:, None]) ** 2).sum(1)))
    return np.floor(2 * size + 0.5).astype(np.int32), size


class Projected(Space):
    """Vectors of one length whose norms lie in one half octave.

    They are scaled by a power of two, which loses nothing, and by the longest norm; one more
    component brings each to norm 1, so that the inner product falls as the distance to the query's
    direction grows. Gaussian projections are 2-stable: a projected squared distance over the true one
    is chi-square distributed. The lines are made orthogonal, which narrows that distribution and
    leaves its mean, so the test holds with more than its confidence.
    """

    def __init__(self, dim: int, kind: int, top: float, dims: int = DIMS, sure: float = SURE, seed: int = SEED):
        self.exponent = kind // 2
        self.longest = 2.0 ** (top - self.exponent)
        lines = np.random.default_rng(seed).standard_normal((dim + 1, dims))
        if dim + 1 >= dims:
            lines = np.linalg.qr(lines)[0] * math.sqrt(dim + 1)
        self.lines, self.reach = lines, quantile(sure, dims)

    def _rows(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = np.ldexp(vecs, -self.exponent) / self.longest
        return unit, np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))[:, None]]) @ self.lines

    def _asked(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions of the queries, and logarithms of what turns a cosine-like product into a score."""
        _, e = np.frexp(np.abs(queries).max(axis=1, initial=0))
        scaled = np.ldexp(queries, -e[:, None])
        norm = np.sqrt((scaled**2).sum(1))
        return scaled / norm[:, None], e + np.log2(norm) + self.exponent + math.log2(self.longest)

    def _goal(self, kth: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Projected squared radius beyond which the test holds: a row as good would have shown up nearer."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            cosine = np.sign(kth) * np.exp2(np.minimum(np.log2(np.abs(kth)) - size, 60))
        cosine = np.where(np.isneginf(kth), -np.inf, np.where(kth == 0, 0, cosine))
        far = 2 - 2 * cosine
        return np.where(far < -1e-9, -1.0, self.reach * np.maximum(far, 0) + _NEAR)

    def low(self, vecs: np.ndarray) -> np.ndarray:
        return self._rows(vecs)[1]

    def summary(self, vecs: np.ndarray) -> np.ndarray:
        return self._rows(vecs)[1]

    def _away(self, asked: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Squared distance of each query's projection to each box."""
        out = np.zeros((len(asked), len(high)))
        for d in range(high.shape[1]):
            x = asked[:, d, None]
            out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
        return out

    def promise(self, queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        unit, size = self._asked(queries)
        cosine = 1 - self._away(unit @ self.lines[:-1], high, low) / (2 * self.lines.shape[1])
        return np.sign(cosine) * 2.0**10 + cosine * 2.0 ** -10 + np.where(cosine > 0, 1, -1) * (size[:, None] + np.log2(np.maximum(np.abs(cosine), 1e-9)))

    def useful(self, queries: np.ndarray, kth: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        unit, size = self._asked(queries)
        return self._away(unit @ self.lines[:-1], high, low) <= self._goal(kth, size)[:, None]

    def search(self, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, first: np.ndarray, k: int, kth: np.ndarray) -> tuple[Hits, int]:
        """Each query's k best among the projected neighbours that are verified until the test holds.

        The kd-tree of the shard's rows is walked for all queries together, from the root; a node is
        entered only where its box lies within the query's radius. Rings of rising projected distance
        are verified by the rows' true inner products; each raises the k-th score and so draws in the
        radius of the test. A query without k-th score first verifies the leaf that it descends to.
        """
        unit, low = self._rows(vecs)
        asked, size = self._asked(queries)
        near, thin, thin_q = low.astype(np.float32), unit.astype(np.float32), asked.astype(np.float32)
        at_low = asked @ self.lines[:-1]
        thin_low = at_low.astype(np.float32)
        length, asked_length = (near**2).sum(1), (thin_low**2).sum(1)
        levels = edges(len(vecs))
        boxes = [(np.maximum.reduceat(low, e[:-1]), np.minimum.reduceat(low, e[:-1])) for e in levels]
        n, kth, best, scored = len(queries), kth.astype(float), none(), 0

        def verified(mask: np.ndarray, some: np.ndarray) -> None:
            nonlocal best, scored
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                floor = np.where(np.isneginf(kth), -np.inf, np.where(kth == 0, 0, np.sign(kth) * np.exp2(np.minimum(np.log2(np.abs(kth)) - size, 60)))) - _SLACK
            at, row = [], []
            for i, m in zip(some.tolist(), mask):
                rows = np.flatnonzero(m)
                scored += len(rows)
                rows = rows[thin[rows] @ thin_q[i] >= floor[i]]
                rows = rows[ids[rows] != q_ids[i]]
                at.append(np.full(len(rows), i))
                row.append(rows)
            if at:
                a, r = np.concatenate(at), np.concatenate(row)
                best, full, least = merge_best([best, (a, r, exact(queries, vecs, a, r))], ids, n, k)
                kth[full] = np.maximum(kth[full], least)

        def walk(some: np.ndarray, radius: np.ndarray, seen: np.ndarray) -> np.ndarray:
            """Rows whose projected squared distance is within the radius of each of some queries, and beyond what was seen."""
            q, node = np.arange(len(some)), np.zeros(len(some), np.int64)
            for level, (high, least) in enumerate(boxes):
                if level:
                    lower = np.searchsorted(levels[level], levels[level - 1][node])
                    upper = np.searchsorted(levels[level], levels[level - 1][node + 1])
                    two = upper - lower > 1
                    q, node = np.concatenate([q, q[two]]), np.concatenate([lower, lower[two] + 1])
                on = np.concatenate([(np.maximum(0, np.maximum(least[b] - x, x - high[b])) ** 2).sum(1) <= radius[a] for a, b, x in ((q[i : i + 65536], node[i : i + 65536], at_low[some[q[i : i + 65536]]]) for i in range(0, len(q), 65536))]) if len(q) else np.zeros(0, bool)
                q, node = q[on], node[on]
            mask = np.zeros((len(some), len(vecs)), bool)
            by = np.argsort(node, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else []:
                a, b = levels[-1][node[group[0]]], levels[-1][node[group[0]] + 1]
                own = q[group]
                d = asked_length[some[own], None] + length[None, a:b] - 2 * thin_low[some[own]] @ near[a:b].T
                mask[own, a:b] = (d <= radius[own, None]) & (d > seen[own, None])
            return mask

        seen = np.full(n, -np.inf)
        new = np.flatnonzero(np.isneginf(kth))
        done = np.zeros((len(new), len(vecs)), bool)
        if len(new):
            leaf = self._away(at_low[new], *boxes[-1]).argmin(1)
            for i, b in enumerate(leaf.tolist()):
                done[i, levels[-1][b] : levels[-1][b + 1]] = True
            verified(done, new)
        slot = np.full(n, -1)
        slot[new] = np.arange(len(new))
        for ring in RINGS:
            goal = self._goal(kth, size)
            radius = np.where(np.isfinite(goal), goal * ring, np.inf)
            some = np.flatnonzero((radius > seen) & (goal >= 0))
            for a in range(0, len(some), 1024):
                part = some[a : a + 1024]
                mask = walk(part, radius[part], seen[part])
                was = slot[part] >= 0
                mask[was] &= ~done[slot[part[was]]]
                verified(mask, part)
            seen[some] = radius[some]
        return best, scored


def exact(queries: np.ndarray, vecs: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of original vectors, each summed in one order, so that equal vectors tie exactly.

    Where products overflow, they are summed for vectors scaled by powers of two.
    """
    out = np.zeros(len(at))
    for i in range(0, len(at), 65536):
        q, v = queries[at[i : i + 65536]], vecs[row[i : i + 65536]]
        with np.errstate(over="ignore", invalid="ignore"):
            s = (q * v).sum(1)
            odd = np.flatnonzero(~np.isfinite(s))
            if len(odd):
                (_, e), (_, f) = (np.frexp(np.abs(x[odd]).max(axis=1, initial=0)) for x in (q, v))
                s[odd] = np.ldexp((np.ldexp(q[odd], -e[:, None]) * np.ldexp(v[odd], -f[:, None])).sum(1), e + f)
        out[i : i + 65536] = np.clip(s, -np.finfo(float).max, np.finfo(float).max)
    return out


METHOD = Method(lambda dim, kind, top: Projected(dim, kind, top), _classes, True, "double")


def nearest(vectors: DataFrame, k: int = K, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Nearest found by inner product: (query_id, rank, vec_id, score), nearest first, ties to the smaller id.

    Every row is indexed, in the kd-tree of its shard; recall comes from the stopping test's
    confidence. ``is_query`` picks the queries by the column ``id``; by default ids divisible by 20.
    Vectors null, zero or holding null or non-finite components, and rows without id, take no part;
    vectors meet those of their own length. Repeated rows are rows of their own. Components of any
    finite size are searched alike; a score beyond a double is the largest double. Other columns, of
    whatever name, are not read. No usable rows give no rows.
    """
    asked = F.col("id") % EVERY == 0 if is_query is None else is_query
    return routed_search(vectors, METHOD, k, asked, id_col, vec_col).withColumnRenamed("id", "vec_id")
