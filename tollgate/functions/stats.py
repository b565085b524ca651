"""Closed-form statistics of a handful of numbers, on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np

#: Two-sided 95 % quantiles of Student's t by degrees of freedom; fixed values.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365}


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial p at one half; 1 where n is 0."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def mcnemar(b: int, c: int) -> float:
    """Exact McNemar p from the two discordant counts."""
    return binomial_two_sided(min(b, c), b + c)


def sign_test(differences: Sequence[float]) -> dict[str, float]:
    """Better, worse and tied counts, with the exact p over the untied."""
    better, worse = sum(d > 0 for d in differences), sum(d < 0 for d in differences)
    return {"better": better, "worse": worse, "tied": len(differences) - better - worse, "p": binomial_two_sided(min(better, worse), better + worse)}


def sign_flip(differences: Sequence[int]) -> float:
    """Exact two-sided sign-flip p of the sum of whole differences over any number of blocks; floor 2 * 0.5^n.

    The number of sign patterns that give each sum is built up block by block, so nothing is enumerated.
    """
    ways = {0: 1}
    for d in differences:
        more: dict[int, int] = {}
        for s, n in ways.items():
            for x in (s + d, s - d):
                more[x] = more.get(x, 0) + n
        ways = more
    seen = abs(sum(differences))
    return sum(n for s, n in ways.items() if abs(s) >= seen) / 2 ** len(differences)


def holm(p: Mapping[str, float]) -> dict[str, float]:
    """Holm's step-down adjustment: the running maximum of (m - i) p, at most 1."""
    out, worst = {}, 0.0
    for i, (name, x) in enumerate(sorted(p.items(), key=lambda kv: (kv[1], kv[0]))):
        worst = max(worst, min(1.0, (len(p) - i) * x))
        out[name] = worst
    return out


def _ranks(x: Sequence[float]) -> list[float]:
    return [1 + sum(b < a for b in x) + (sum(b == a for b in x) - 1) / 2 for a in x]


def spearman(x: Sequence[float], y: Sequence[float]) -> float | None:
    """Rank correlation; null where one side is constant."""
    a, b = _ranks(x), _ranks(y)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
    return None if va == 0 or vb == 0 else sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(va * vb)


def spearman_exact(x: Sequence[float], y: Sequence[float]) -> dict[str, float]:
    """Spearman's rho with its exact permutation p values over all orderings of at most 8 values."""
    if len(x) > 8:
        raise ValueError("too many values to enumerate")
    rho = spearman(x, y)
    if rho is None:
        return {"rho": None, "p_upper": None, "p_two_sided": None, "orderings": math.factorial(len(x))}
    ra, rb = _ranks(x), _ranks(y)
    ma = sum(ra) / len(ra)
    scale = math.sqrt(sum((p - ma) ** 2 for p in ra) * sum((q - ma) ** 2 for q in rb))
    all_ = [sum((p - ma) * (q - ma) for p, q in zip(ra, order)) / scale for order in permutations(rb)]
    return {
        "rho": rho,
        "p_upper": sum(r >= rho - 1e-12 for r in all_) / len(all_),
        "p_two_sided": sum(abs(r) >= abs(rho) - 1e-12 for r in all_) / len(all_),
        "orderings": len(all_),
    }


def chi_square_p(x: float, df: int) -> float:
    """Upper tail of chi-square, by the series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h, i = d, 0
    while True:
        i += 1
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b if abs(n * d + b) > 1e-300 else 1e-300)
        c = b + n / c if abs(b + n / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15 or i > 10_000:
            return min(1.0, h * front)


def contingency(counts: Sequence[Sequence[float]]) -> dict[str, float]:
    """Chi-square, p and Cramér's V of a table; empty rows and columns count as absent from the statistic."""
    rows, cols = [sum(r) for r in counts], [sum(c) for c in zip(*counts)]
    n = sum(rows)
    if not n or min(len(rows), len(cols)) < 2:
        return {"chi2": 0.0, "p_value": 1.0, "cramers_v": 0.0}
    chi2 = sum((x - r * c / n) ** 2 / (r * c / n) for row, r in zip(counts, rows) for x, c in zip(row, cols) if r and c)
    df = (sum(r > 0 for r in rows) - 1) * (sum(c > 0 for c in cols) - 1)
    return {"chi2": chi2, "p_value": chi_square_p(chi2, df) if df else 1.0, "cramers_v": math.sqrt(chi2 / (n * (min(len(rows), len(cols)) - 1)))}


def quantile(values: Sequence[float], q: float) -> float:
    """Linearly interpolated quantile."""
    x = sorted(values)
    at = q * (len(x) - 1)
    k = math.floor(at)
    return x[k] if k + 1 >= len(x) else x[k] + (at - k) * (x[k + 1] - x[k])


def spread(values: Sequence[float]) -> dict[str, float]:
    """How far a metric wanders over seeds: range, interquartile range and median absolute deviation, in per cent."""
    mean, median = sum(values) / len(values), quantile(values, 0.5)
    pct = lambda x, by: round(100 * x / by, 2) if by else 0.0
    return {
        "mean": mean, "min": min(values), "max": max(values), "median": median, "n": len(values),
        "spread_pct": pct(max(values) - min(values), mean), "iqr_pct": pct(quantile(values, 0.75) - quantile(values, 0.25), median),
        "mad_pct": pct(quantile([abs(v - median) for v in values], 0.5), median),
    }


def paired_ratio(a: Sequence[float], b: Sequence[float]) -> dict[str, float | None]:
    """Mean of a/b over pairs with its 95 % t-interval, for up to 8 pairs."""
    r = [x / y for x, y in zip(a, b, strict=True)]
    mean = sum(r) / len(r)
    t = T_95.get(len(r) - 1)
    half = None if t is None else t * math.sqrt(sum((x - mean) ** 2 for x in r) / (len(r) - 1) / len(r))
    return {"mean": mean, "lo": None if half is None else mean - half, "hi": None if half is None else mean + half, "n": len(r)}


def largest_remainder(shares: Mapping[str, float], total: int) -> dict[str, int]:
    """Whole counts nearest to ``shares * total`` that sum to it: floors, then one each by the largest remainder."""
    raw = {k: v * total for k, v in shares.items()}
    out = {k: math.floor(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: -(raw[k] - out[k]))[: total - sum(out.values())]:
        out[k] += 1
    return out


def binomial_spread(rings: Mapping[str, tuple[int, float]], draws: int, seed: int = 0) -> dict[str, float]:
    """Greatest over least rate of (rings, rate) by shape, against shapes that are all found at the pooled rate.

    A draw without a hit for some shape has an infinite ratio and counts as one that reaches the observed.
    """
    n, rate = (np.array([rings[k][j] for k in sorted(rings)], float) for j in (0, 1))
    pooled = float(np.rint(rate * n).sum() / n.sum())
    drawn = np.random.default_rng(seed).binomial(n.astype(int), pooled, (draws, len(n))) / n
    low = drawn.min(1)
    null = np.where(low > 0, drawn.max(1) / np.where(low > 0, low, 1), np.inf)
    seen = float(rate.max() / rate.min()) if rate.min() else math.inf
    finite = null[np.isfinite(null)].tolist()
    return {
        "observed_spread": seen, "pooled_rate": pooled, "null_spread_median": quantile(finite, 0.5) if finite else math.inf, "null_spread_p95": quantile(finite, 0.95) if finite else math.inf,
        "p_value": (1 + int((null >= seen).sum())) / (draws + 1),
    }


def replication_power(a: Mapping[str, tuple[int, float]], b: Mapping[str, tuple[int, float]], draws: int, seed: int = 0) -> dict[str, float]:
    """How low a rank correlation of two profiles of (rings, rate) by shape comes by chance if their order is the same.

    Both are drawn from the first profile, scaled to each one's own level, so only sampling noise
    separates them. Draws without a correlation, one side being constant, are left out.
    """
    shared = sorted(set(a) & set(b))
    n_a, n_b = (np.array([x[k][0] for k in shared]) for x in (a, b))
    p_a, p_b = (np.array([x[k][1] for k in shared], float) for x in (a, b))
    scaled = np.clip(p_a * np.average(p_b, weights=n_b) / np.average(p_a, weights=n_a), 1e-6, 1 - 1e-6)
    rng = np.random.default_rng(seed)
    pairs = zip((rng.binomial(n_a, p_a, (draws, len(shared))) / n_a).tolist(), (rng.binomial(n_b, scaled, (draws, len(shared))) / n_b).tolist())
    rho = [r for r in (spearman(x, y) for x, y in pairs) if r is not None]
    seen = spearman(p_a.tolist(), p_b.tolist())
    return {
        "observed_rho": seen, "n_typologies": len(shared), "median_rho": quantile(rho, 0.5), "rho_lo": quantile(rho, 0.025), "rho_hi": quantile(rho, 0.975),
        "share_at_or_below_observed": None if seen is None else sum(r <= seen + 1e-12 for r in rho) / len(rho),
    }
