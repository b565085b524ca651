import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tollgate.functions import stats


def test_exact_tests():
    assert stats.mcnemar(0, 0) == 1.0
    assert stats.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024)
    assert stats.sign_test([1, 1, 0, -1]) == {"better": 2, "worse": 1, "tied": 1, "p": 1.0}
    assert stats.sign_test([1] * 8)["p"] == pytest.approx(0.0078125)
    assert stats.sign_flip([1, 2, 3]) == pytest.approx(2 * 0.5**3)
    assert stats.sign_flip([]) == 1.0


def test_holm_is_monotone_and_capped():
    got = stats.holm({"a": 0.01, "b": 0.04, "c": 0.03})
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06)}
    assert max(stats.holm({"x": 0.9, "y": 0.8}).values()) == 1.0


def test_spearman_exact():
    got = stats.spearman_exact([1, 2, 3, 4], [1, 2, 3, 4])
    assert got["rho"] == pytest.approx(1) and got["p_upper"] == pytest.approx(1 / 24) and got["p_two_sided"] == pytest.approx(2 / 24)
    assert stats.spearman_exact([1, 1], [1, 2])["rho"] is None


def test_chi_square_tail():
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_p(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, abs=1e-12)
    got = stats.contingency([[10, 0], [0, 10]])
    assert got["chi2"] == pytest.approx(20) and got["cramers_v"] == pytest.approx(1)
    assert stats.contingency([[0, 0], [0, 0]])["cramers_v"] == 0


@given(st.lists(st.floats(0.01, 1), min_size=2, max_size=8), st.integers(0, 500))
def test_largest_remainder_sums(shares, total):
    got = stats.largest_remainder({str(i): s / sum(shares) for i, s in enumerate(shares)}, total)
    assert sum(got.values()) == total
    assert all(abs(got[str(i)] - s / sum(shares) * total) <= 1 + 1e-9 for i, s in enumerate(shares))


def test_spread_and_ratio():
    got = stats.spread([0.794, 0.898, 0.895, 0.896, 0.591, 0.830, 0.844, 0.851])
    assert got["spread_pct"] == pytest.approx(37.2, abs=0.1) and got["mad_pct"] < got["iqr_pct"] < got["spread_pct"]
    assert stats.paired_ratio([2, 2], [1, 1]) == {"mean": 2, "lo": 2, "hi": 2, "n": 2}
    values = [random.Random(1).random() for _ in range(11)]
    assert stats.quantile(values, 0.5) == sorted(values)[5]
