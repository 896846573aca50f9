"""p-values from per-covariate summary statistics (math/numpy only).

These act on one row per covariate *after* Spark has aggregated the data; they
never see observations. Formulas are the textbook ones:

* normal tail via ``erfc``;
* Student t and chi-square tails via the regularized incomplete beta / gamma
  functions (continued fractions, as in Press et al., Numerical Recipes ch. 6);
* Wilcoxon rank-sum: exact null distribution of U by polynomial recursion when
  both groups are small and untied, else the normal approximation with tie and
  continuity correction;
* Welch's t-test with Satterthwaite degrees of freedom;
* Fisher's exact test (2x2, two-sided: sum of tables no more likely than the
  observed one, with a relative slack of 1e-7).
"""

from __future__ import annotations

import math

import numpy as np

EPS = 2.220446049250313e-16
# Exact rank-sum below this group size, and the test-selection threshold
# on observed cell counts.
EXACT_RANKSUM_MAX = 50
SMALL_CELL = 5


def _nan(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def norm_two_sided(z: float) -> float:
    """P(|Z| >= |z|), without loss in the far tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


# ------------------------------------------------------------- incomplete gamma / beta
MAX_STEPS = 200_000          # the fractions need about the square root of their largest argument
LARGE_SHAPE = 1e5            # from here on the uniform expansion below is exact to 1e-9


def _gamma_large(a: float, x: float) -> float:
    """Q(a, x) for large a: Temme's uniform expansion, first two terms."""
    mu = x / a - 1.0
    if abs(mu) < 1e-3:       # mu - log(1 + mu) without cancellation
        half = mu * mu * (0.5 - mu * (1 / 3 - mu * (0.25 - mu * (0.2 - mu / 6))))
    else:
        half = mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(2.0 * half), mu)
    first = -1 / 3 + eta / 12 - 2 * eta * eta / 135 + eta ** 3 / 864 if abs(eta) < 0.05 else 1.0 / mu - 1.0 / eta
    return 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + math.exp(-a * half) / math.sqrt(2.0 * math.pi * a) * first


def _gamma_series(a: float, x: float) -> float:
    s = term = 1.0 / a
    ap = a
    for _ in range(MAX_STEPS):
        ap += 1.0
        term *= x / ap
        s += term
        if abs(term) < abs(s) * 1e-16:
            break
    else:
        raise ArithmeticError("incomplete gamma series did not converge")
    return s * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, MAX_STEPS):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 4e-16:
            break
    else:
        raise ArithmeticError("incomplete gamma fraction did not converge")
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if a > LARGE_SHAPE:
        return _gamma_large(a, x)
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chisq_sf(x: float, df: float) -> float:
    if _nan(x) or _nan(df) or df <= 0:
        return float("nan")
    return gamma_q(df / 2.0, x / 2.0)


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, MAX_STEPS):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 4e-16:
            break
    else:
        raise ArithmeticError("incomplete beta fraction did not converge")
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_cf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if _nan(t) or _nan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > 1e9:             # normal up to a relative error of the order t^4 / df
        return norm_two_sided(t)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


# ------------------------------------------------------------- tests
def ranksum_exact_p(w: float, n1: int, n2: int) -> float:
    """Two-sided exact p for the rank-sum statistic W = R1 - n1(n1+1)/2 (no ties)."""
    # counts of U = 0..n1*n2 : coefficients of prod_{i=1..n1} (1 - q^(n2+i)) / (1 - q^i)
    size = n1 * n2 + 1
    poly = np.zeros(size)
    poly[0] = 1.0
    for i in range(1, n1 + 1):
        k = n2 + i
        if k < size:
            poly[k:] -= poly[:size - k].copy()
        for j in range(i, size):  # divide by (1 - q^i): running sum with stride i
            poly[j] += poly[j - i]
    dist = poly / poly.sum()
    cdf = np.cumsum(dist)

    def lower(q: float) -> float:  # P(U <= q)
        qi = int(math.floor(q + 1e-7))
        return 0.0 if qi < 0 else float(cdf[min(qi, size - 1)])

    if w > n1 * n2 / 2.0:
        p = 1.0 - lower(w - 1)
    else:
        p = lower(w)
    return min(2.0 * p, 1.0)


def ranksum_p(n1: int, n2: int, r1: float, tie_sum: float, has_ties: bool) -> float:
    """Two-sided rank-sum p from group sizes, the rank sum of group 1 and sum(t^3 - t) over ties."""
    if not n1 or not n2:
        return float("nan")
    w = r1 - n1 * (n1 + 1) / 2.0
    if n1 < EXACT_RANKSUM_MAX and n2 < EXACT_RANKSUM_MAX and not has_ties:
        return ranksum_exact_p(w, int(n1), int(n2))
    n = n1 + n2
    z = w - n1 * n2 / 2.0
    sigma = math.sqrt((n1 * n2 / 12.0) * ((n + 1) - tie_sum / (n * (n - 1))))
    corr = math.copysign(0.5, z) if z != 0 else 0.0
    if sigma == 0:
        return float("nan")
    z = (z - corr) / sigma
    return norm_two_sided(z)


def welch_p(n1, m1, v1, n2, m2, v2) -> float:
    if any(_nan(x) for x in (n1, m1, v1, n2, m2, v2)) or n1 < 2 or n2 < 2:
        return float("nan")
    se2 = v1 / n1 + v2 / n2
    scale = max(abs(m1), abs(m2))
    if se2 <= (10 * EPS * scale) ** 2:      # no spread beyond rounding: t is undefined
        return float("nan")
    t = (m1 - m2) / math.sqrt(se2)
    df = se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return t_two_sided(t, df)


def _log_weights(start: int, stop: int, m: int, n: int, k: int) -> np.ndarray:
    """Log weights of tables start, start +- 1, ... stop, relative to ``start``, until they underflow."""
    step = 1 if stop >= start else -1
    parts, x, last = [np.zeros(1)], start, 0.0
    while x != stop and last > -745.0:
        size = min(abs(stop - x), 1 << 16)
        at = x + step * np.arange(size, dtype=np.float64)
        up = (m - at) * (k - at), (at + 1) * (n - k + at + 1)               # weight(at + 1) / weight(at)
        down = at * (n - k + at), (m - at + 1) * (k - at + 1)               # weight(at - 1) / weight(at)
        top, bottom = up if step > 0 else down
        logs = last + np.cumsum(np.log(top) - np.log(bottom))
        parts.append(logs)
        x, last = x + step * size, float(logs[-1])
    return np.concatenate(parts)


def fisher_2x2_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p for [[a, b], [c, d]]: tables no likelier than the observed one.

    Weights follow from one another by a ratio, outward from the likeliest table, and stop where they
    underflow: the work grows with the spread of the distribution, not with the margins.
    """
    a, b, c, d = int(a), int(b), int(c), int(d)
    m, n, k = a + c, b + d, a + b                     # column totals, first row total
    lo, hi = max(0, k - n), min(k, m)
    mode = min(max((k + 1) * (m + 1) // (m + n + 2), lo), hi)
    right, left = _log_weights(mode, hi, m, n, k), _log_weights(mode, lo, m, n, k)
    side, at = (right, a - mode) if a >= mode else (left, mode - a)
    if at >= len(side):
        return 0.0
    weights = np.exp(np.concatenate([left[:0:-1], right]))
    return float(min(1.0, weights[weights <= math.exp(side[at]) * (1 + 1e-7)].sum() / weights.sum()))


def chisq_statistic(table: np.ndarray) -> float:
    """Pearson statistic of an r x c table (no continuity correction)."""
    t = np.asarray(table, dtype=float)
    e = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
    return float(((t - e) ** 2 / e).sum())
