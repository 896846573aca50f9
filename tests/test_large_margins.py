"""p-value finishers and the table simulation far beyond small margins."""

import math
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from cohortflow.operators import finishers as fin
from cohortflow.operators import montecarlo
from cohortflow.operators.montecarlo import hypergeometric, simulate
from cohortflow.operators.running import add_ranges, running


def fisher_fraction(a, b, c, d):
    m, n, k = a + c, b + d, a + b
    w = {x: comb(m, x) * comb(n, k - x) for x in range(max(0, k - n), min(k, m) + 1)}
    return float(Fraction(sum(v for v in w.values() if v <= w[a] * (1 + Fraction(1, 10 ** 7))), sum(w.values())))


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (0, 5, 7, 2), (10, 0, 0, 10), (2, 30, 40, 4), (1, 0, 0, 0), (4, 90, 100, 800), (0, 0, 3, 4)])
def test_fisher_against_fractions(t):
    assert math.isclose(fin.fisher_2x2_p(*t), fisher_fraction(*t), rel_tol=1e-9)


def test_fisher_with_huge_margins():
    # rare against a billion: the count is Poisson with mean 3 / 2 + ... of a fair split
    assert math.isclose(fin.fisher_2x2_p(3, 2 * 10 ** 9, 0, 2 * 10 ** 9), 0.25, rel_tol=1e-6)
    assert 0 <= fin.fisher_2x2_p(3, 10 ** 6, 10 ** 6, 10 ** 6) < 1e-300
    p = fin.fisher_2x2_p(10 ** 9, 10 ** 9, 10 ** 9, 10 ** 9 + 40_000)
    assert 0 < p < 1


@pytest.mark.parametrize("df", [2e5 + 2, 1e6, 1e8, 1e10])
def test_chisq_tail_at_large_df(df):
    """At the median (about df - 2/3) the tail is one half; one sigma above, the normal value with its skewness term."""
    assert math.isclose(fin.chisq_sf(df - 2 / 3, df), 0.5, abs_tol=1e-6)
    z, skew = 1.0, math.sqrt(8 / df)
    edgeworth = 0.5 * math.erfc(z / math.sqrt(2)) + skew / 6 * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert math.isclose(fin.chisq_sf(df + math.sqrt(2 * df), df), edgeworth, abs_tol=1e-5)


def test_expansion_meets_the_fraction():
    for a in (9.9e4, 1.01e5):
        for x in (0.99 * a, a, 1.01 * a):
            exact = 1 - fin._gamma_series(a, x) if x < a + 1 else fin._gamma_cf(a, x)
            assert math.isclose(fin._gamma_large(a, x), exact, rel_tol=1e-6, abs_tol=1e-12)


def test_far_tails():
    assert math.isclose(fin.norm_two_sided(9.0), 2.2571768e-19, rel_tol=1e-5)
    assert math.isclose(fin.t_two_sided(2.0, 1e10), fin.norm_two_sided(2.0), rel_tol=1e-8)


def test_hypergeometric_beyond_the_sampler():
    rng = np.random.default_rng(1)
    for good, bad, draws in ((5, 3 * 10 ** 9, 10 ** 9), (2 * 10 ** 9, 2 * 10 ** 9, 10 ** 9), (3 * 10 ** 9, 4, 10 ** 9)):
        x = hypergeometric(rng, good, bad, np.full(4000, draws, dtype=np.int64))
        mean = draws * good / (good + bad)
        sd = math.sqrt(mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1))
        assert (x >= max(0, draws - bad)).all() and (x <= min(good, draws)).all()
        assert abs(x.mean() - mean) < 5 * sd / math.sqrt(4000) and abs(x.std() / sd - 1) < 0.1


def test_simulated_statistics_have_the_exact_mean():
    """E X2 = (r - 1) N / (N - 1), with classes of many single-row levels and margins of billions."""
    rng = np.random.default_rng(2)
    for totals, levels, c1 in (([1], [500], 200), ([1, 2, 7], [50, 20, 5], 60), ([3, 10 ** 9, 2 * 10 ** 9], [2, 1, 1], 10 ** 9)):
        n = sum(t * m for t, m in zip(totals, levels))
        r = sum(levels)
        sims = simulate(rng, totals, levels, c1, n, 4000)
        mean = (r - 1) * n / (n - 1)
        assert abs(sims.mean() - mean) < 6 * max(sims.std(), 1e-9) / math.sqrt(4000) + 1e-9 * mean


def test_ranges_with_infinite_and_missing_values(spark):
    rows = [(float("inf"), 1), (float("-inf"), 2), (1.0, 3), (2.0, 4)]
    ranged, k = add_ranges(spark.createDataFrame(rows, "x double, c int"), "x", 4)
    got = {r.x: r.s for r in running(ranged, "x", [], sums={"s": ranged["c"]}, n_ranges=k).collect()}
    assert got == {float("-inf"): 2, 1.0: 5, 2.0: 9, float("inf"): 10}
    empty, k = add_ranges(spark.createDataFrame([], "x double, c int"), "x", 4)
    assert k == 1 and running(empty, "x", [], sums={"s": empty["c"]}, n_ranges=k).count() == 0


def test_levels_of_a_class_are_dealt_by_halving(monkeypatch):
    rng = np.random.default_rng(1)
    for cells in (1 << 21, 64):
        monkeypatch.setattr(montecarlo, "CELLS", cells)
        drawn = rng.integers(0, 7 * 11, 4000)
        level = np.concatenate(list(montecarlo.halved(rng, 7, 11, drawn)), axis=1)
        assert level.shape == (4000, 11) and (level.sum(axis=1) == drawn).all() and level.min() >= 0 and level.max() <= 7
        # every level has the same share, and that of a hypergeometric draw of its own
        assert abs(level.mean(axis=0) - drawn.mean() / 11).max() < 0.2
        share = drawn / 77
        expected = (7 * share * (1 - share) * 70 / 76).mean() + np.var(drawn / 11)
        assert abs(level.var(axis=0) - expected).max() < 0.35
    monkeypatch.setattr(montecarlo, "CELLS", 1 << 21)
    stat = simulate(np.random.default_rng(2), [2], [10_000_000], 4_000_000, 20_000_000, 1)
    # chi-square of ten million degrees of freedom, within five standard deviations (levels of two have a smaller spread)
    assert abs(stat[0] / 10_000_000 - 1) < 0.01
