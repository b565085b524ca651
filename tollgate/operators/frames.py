"""Sums, spreads and maxima over time frames of one account's events, in numpy and n log n steps.

Events of one time are one row, so what is held grows with the times and not with the events.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..contract import MINUTE, WINDOWS

_DAY, _WEEK, _MONTH = WINDOWS["1d"], WINDOWS["7d"], WINDOWS["30d"]
#: Features that are null where their frame is empty, and those that are 0 there.
NULLABLE = ("mean_amt_7d", "std_amt_7d", "max_amt_30d", "secs_since_prev", "out_share_7d", "new_cp_rate_7d")
COUNTS = ("n_1d", "n_7d", "n_30d", "n_out_7d", "n_in_7d", "n_new_cp_7d", "n_distinct_cp_ever")
_EMPTY = (0.0, 0.0, 0.0, -np.inf)


def _merge(a: tuple, b: tuple) -> tuple:
    """Number, mean, squared deviations and maximum of two sets together."""
    n = a[0] + b[0]
    d, w = b[1] - a[1], b[0] / np.maximum(n, 1)
    return n, np.where(a[0] == 0, b[1], a[1] + d * w), a[2] + b[2] + d * d * a[0] * w, np.maximum(a[3], b[3])


@dataclass
class Times:
    """Distinct times ``t``, rising; of the events at each: all, outgoing and first contacts; amounts that are not null, their mean, squared deviations and maximum."""

    t: np.ndarray
    rows: np.ndarray
    out: np.ndarray
    new: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, t: np.ndarray, amount: np.ndarray, known: np.ndarray, is_out: np.ndarray, is_new: np.ndarray) -> Times:
        """From events in any order."""
        amount = np.where(known, amount, 0.0)
        return cls(t, np.ones(len(t), np.int64), is_out, is_new, known.astype(float), amount, np.zeros(len(t)), np.where(known, amount, -np.inf))._packed()

    @classmethod
    def none(cls) -> Times:
        return cls(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0)] * 4)

    def _columns(self) -> tuple[np.ndarray, ...]:
        return self.t, self.rows, self.out, self.new, self.n, self.mean, self.dev, self.top

    def _packed(self) -> Times:
        if not len(self.t):
            return self
        order = np.argsort(self.t, kind="stable")
        t, rows, out, new, n, mean, dev, top = (c[order] for c in self._columns())
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        of = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))
        add = lambda x: np.add.reduceat(x, at)
        whole = add(n * mean) / np.maximum(add(n), 1)
        return Times(t[at], add(rows), add(out), add(new), add(n), whole, add(dev + n * (mean - whole[of]) ** 2), np.maximum.reduceat(top, at))

    def plus(self, other: Times) -> Times:
        return Times(*[np.concatenate(x) for x in zip(self._columns(), other._columns())])._packed()

    def since(self, t: int) -> Times:
        return Times(*[c[np.searchsorted(self.t, t) :] for c in self._columns()])

    def _over(self, tree: list[tuple], lo: np.ndarray, hi: np.ndarray) -> tuple:
        """``_merge`` of the times from ``lo`` to before ``hi``, each of a few whole nodes a level."""
        lo, hi, found = lo.copy(), hi.copy(), tuple(np.full(len(lo), x) for x in _EMPTY)
        for nodes in tree:
            for pick, at in ((lambda: (lo < hi) & (lo & 1 == 1), lo), (lambda: (lo < hi) & (hi & 1 == 1), hi)):
                rows = np.flatnonzero(pick())
                if len(rows):
                    if at is hi:
                        hi[rows] -= 1
                    node = tuple(x[at[rows]] for x in nodes)
                    for x, y in zip(found, _merge(tuple(x[rows] for x in found), node)):
                        x[rows] = y
                    if at is lo:
                        lo[rows] += 1
            lo >>= 1
            hi >>= 1
            if (lo >= hi).all():
                break
        return found

    def features(self, at: np.ndarray, before: int = 0) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Features of an event at each of the times ``at``, and where those of ``NULLABLE`` are null.

        Frames end a minute before. ``before`` are first contacts earlier than any of these times.
        """
        with np.errstate(all="ignore"):
            tree = [(self.n, self.mean, self.dev, self.top)]
            while len(tree[-1][0]) > 1:
                even = tuple(np.append(x, e) if len(x) % 2 else x for x, e in zip(tree[-1], _EMPTY))
                tree.append(_merge(tuple(x[::2] for x in even), tuple(x[1::2] for x in even)))
            hi = np.searchsorted(self.t, at - MINUTE, "right")
            day, week, month = (np.searchsorted(self.t, at - s) for s in (_DAY, _WEEK, _MONTH))
            rows, out, new = (np.concatenate([[0], np.cumsum(x)]) for x in (self.rows, self.out, self.new))
            n7, out7, new7 = (x[hi] - x[week] for x in (rows, out, new))
            n, mean, dev, _ = self._over(tree, week, hi)
            some, _, _, top = self._over(tree, month, hi)
            last = self.t[np.maximum(hi, 1) - 1] if len(self.t) else at
            values = {
                "n_1d": rows[hi] - rows[day], "n_7d": n7, "n_30d": rows[hi] - rows[month], "mean_amt_7d": mean, "std_amt_7d": np.sqrt(dev / n), "max_amt_30d": top, "n_out_7d": out7,
                "secs_since_prev": at - last, "n_in_7d": n7 - out7, "out_share_7d": out7 / n7, "n_new_cp_7d": new7, "new_cp_rate_7d": new7 / n7, "n_distinct_cp_ever": new[hi] + before,
            }
        return values, {"mean_amt_7d": n == 0, "std_amt_7d": n == 0, "max_amt_30d": some == 0, "secs_since_prev": hi <= month, "out_share_7d": n7 == 0, "new_cp_rate_7d": n7 == 0}
